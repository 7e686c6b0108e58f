"""Catalog tables: replaced, reloaded in part, described, and built in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe import sinks
from chronoframe.plans import warehouse
from queries.comparing import ANCHOR
from queries.family import Family, r
from queries.mapping import WINDOW, Inputs

FAMILY = Family()


def _table(i: Inputs, name: str) -> str:
    """A name of its own in the silver namespace."""
    sinks.create_namespaces(i.spark)
    return f"silver.{name}_{uuid.uuid4().hex[:12]}"


@FAMILY.query(f"SELECT ticker, trade_date, {r('2 * close_price', 'close_price')}, volume FROM prices WHERE volume > 10", "prices")
def replaced_table(i: Inputs) -> DataFrame:
    """Stored, then replaced twice from its own rows; the table is pointed at each new version in one step."""
    name = _table(i, "prices")
    layout = {"bucket_by": ("ticker",), "sort_by": ("ticker", "trade_date"), "buckets": 4}
    sinks.replace_table(i.prices(), name, **layout)
    sinks.replace_table(i.spark.table(name).filter("volume > 10"), name, **layout)
    sinks.replace_table(i.spark.table(name).withColumn("close_price", 2 * F.col("close_price")), name, **layout)
    return i.spark.table(name)


@FAMILY.query(
    f"""SELECT ticker, trade_date, {r('close_price')},
           CASE WHEN date_trunc('month', trade_date) IN (DATE '1997-03-01', DATE '1998-11-01') AND ticker % 2 = 0 THEN -volume ELSE volume END AS volume
        FROM prices
        UNION ALL SELECT -1, DATE '1998-11-30', 1.0::DOUBLE, 0::BIGINT""",
    "prices",
)
def reloaded_days(i: Inputs) -> DataFrame:
    """A table partitioned by month; corrected rows of two months, and a new one, are put in, and only these months are written."""
    name = _table(i, "by_month")
    month = F.date_format("trade_date", "yyyy-MM")
    prices = i.prices().withColumn("month", month)
    sinks.replace_table(prices.repartition("month"), name, partition_by=("month",))
    wrong = prices.filter(F.col("month").isin("1997-03", "1998-11") & (F.col("ticker") % 2 == 0)).withColumn("volume", -F.col("volume"))
    late = i.spark.sql("SELECT -1L AS ticker, DATE '1998-11-30' AS trade_date, 1.0D AS close_price, 0L AS volume").withColumn("month", month)
    sinks.reload_partitions(wrong.unionByName(late), name, key=("ticker", "trade_date"), partition="month")
    return i.spark.table(name).drop("month")


@FAMILY.query(
    """SELECT * FROM (
        SELECT 'o_orderkey' AS column_name, count(*) AS row_count, 0::BIGINT AS null_count, NULL::BIGINT AS distinct_count, min(o_orderkey)::VARCHAR AS smallest, max(o_orderkey)::VARCHAR AS largest FROM orders
        UNION ALL SELECT 'ordered', count(*), 0, NULL, min(CAST(o_orderdate AS DATE))::VARCHAR, max(CAST(o_orderdate AS DATE))::VARCHAR FROM orders
        UNION ALL SELECT 'o_orderpriority', count(*), 0, count(DISTINCT o_orderpriority), NULL, NULL FROM orders
        UNION ALL SELECT 'open_status', count(*), count(*) FILTER (o_orderstatus = 'F'), count(DISTINCT nullif(o_orderstatus, 'F')), NULL, NULL FROM orders)"""
)
def table_statistics(i: Inputs) -> DataFrame:
    """What the optimizer knows of a table after it was analysed; distinct counts are estimates, so those of keys are left out."""
    name = _table(i, "orders")
    orders = i.table("orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"), "o_orderpriority", F.nullif("o_orderstatus", F.lit("F")).alias("open_status")
    )
    sinks.replace_table(orders, name)
    sinks.analyze(i.spark, name, columns=True)
    few = F.col("column_name").isin("o_orderpriority", "open_status")
    return sinks.column_statistics(i.spark, name).withColumn("distinct_count", F.when(few, F.col("distinct_count")))


@FAMILY.query(
    """SELECT column_name, comment, n AS dimension_rows FROM (VALUES
        ('valid_from', 'First day in force, inclusive; 1900-01-01 on the opening version'), ('valid_to', 'Last day in force, inclusive; NULL on the current version'),
        ('ticker', NULL), ('gics_sector', NULL), ('gics_sub_industry', NULL), ('is_current', NULL), ('version_number', NULL), ('change_reason', NULL)) AS t(column_name, comment),
        (SELECT count(*) AS n FROM dim)""",
    "dim",
)
def described_dimension(i: Inputs) -> DataFrame:
    """The dimension as a table of the silver namespace: its columns and comments as the catalog has them, and its rows."""
    name = _table(i, "dim")
    kept = sinks.materialise(i.dim().select("ticker", "gics_sector", "gics_sub_industry", "valid_from", "valid_to", "is_current", "version_number", "change_reason"), name)
    known = i.spark.sql(f"DESCRIBE {name}").select(F.col("col_name").alias("column_name"), "comment")
    return known.withColumn("dimension_rows", F.lit(kept.count()).cast("bigint"))


@FAMILY.query(f"SELECT {ANCHOR} FROM anchor_rl", "anchor_rl")
def built_anchor(i: Inputs) -> DataFrame:
    """Landed, built in order as catalog tables, and built again, which finds every table unchanged."""
    key = F.concat(F.lit("C"), F.col("ticker").cast("string"))
    text = lambda *names: [F.lit("x").alias(n) for n in names]
    today = i.universe(relabel=True)
    frames = {
        "daily_prices": i.prices().withColumn("ticker", key),
        "current_snapshot": today.select(key.alias("ticker"), "security_name", F.col("current_gics_sector").alias("gics_sector"), F.col("current_sub_industry").alias("gics_sub_industry")),
        "sector_history": i.change_log(relabel=True).withColumn("ticker", key).select("*", *text("company_name", "source_id")),
        "sector_registry": i.registry(),
        "excluded_entities": i.holdouts().limit(0),
    }
    buckets = warehouse.buckets_for(i.table("lineitem").count())  # there are no more prices than lines
    warehouse.load_bronze(i.spark, frames, recreate=True, buckets=buckets)
    warehouse.build_all(i.spark, WINDOW, buckets=buckets)
    again = warehouse.build_all(i.spark, WINDOW, buckets=buckets, resume=True)
    assert not again.seconds, f"built again without a change: {sorted(again.seconds)}"
    return i.spark.table("gold.anchor_metric")
