"""The roles of the engine's inputs, filled from the driver tables.

=============== =============================================================
role            definition
=============== =============================================================
prices          lineitem joined to orders: key = customer, day = ship date,
                close = 100 * (1 - mean discount), volume = sum of quantity
states          label (priority) and finer label (status) of the customer's
                last order of a day
change log      days on which the label differs from the previous state
snapshot        last state per customer
relabelled      the same, with 5-LOW called 5-LEGACY before 1998-07-01 and a
                rename event on that day
=============== =============================================================

Discounts are whole percents, so summing them as integers makes the close an
exactly reproducible number whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.model import RECLASSIFICATION, SECTOR_RENAME, ReportingWindow
from chronoframe.operators import scd2, windows
from queries.storage import stored

WINDOW = ReportingWindow(date(1996, 1, 1), date(2000, 12, 31))
RENAME_DAY = date(1998, 7, 1)


class Inputs:
    """Lazy frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._planned: dict[str, DataFrame] = {}

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Plan a frame once per query; readers of one frame can share its shuffles."""
        if name not in self._planned:
            self._planned[name] = build()
        return self._planned[name]

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """Written to the shared folder and read back, for what several steps read."""
        return stored(df, name.replace(" ", "-"))

    # --- observations -----------------------------------------------------
    def _shipments(self, orders: DataFrame) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", *_shipped())
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def nation_prices(self) -> DataFrame:
        """Prices by the customer's nation: few keys with long series."""
        nations = self.table("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("ticker"))
        orders = self.table("orders").select("o_orderkey", "o_custkey").join(nations, F.col("o_custkey") == F.col("c_custkey"))
        return _daily_close(self._shipments(orders.select("o_orderkey", "ticker")))

    def prices(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("ticker"))
        return _daily_close(self._shipments(orders))

    def named_prices(self) -> DataFrame:
        """Prices under hyphenated customer names, and those of vendors, whom no snapshot knows."""
        named = lambda kind: F.concat(F.lit(f"{kind}-"), F.lpad(F.col("ticker").cast("string"), 9, "0"))
        sold = self.table("lineitem").select(F.col("l_suppkey").alias("ticker"), *_shipped())
        return self.prices().withColumn("ticker", named("Customer")).unionByName(_daily_close(sold).withColumn("ticker", named("Vendor")))

    def returns(self, slice_unit: str | None = None) -> DataFrame:
        return windows.returns(self.prices(), keep=("volume",), slice_unit=slice_unit)

    # --- states and changes -----------------------------------------------
    def states(self, relabel: bool = False) -> DataFrame:
        last = F.max_by(F.struct("o_orderpriority", "o_orderstatus"), F.col("o_orderkey"))
        daily = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"))
            .agg(last.alias("s"))
            .select(
                "ticker",
                "day",
                F.col("s.o_orderpriority").alias("label"),
                F.col("s.o_orderstatus").alias("sub_label"),
                F.lit(RECLASSIFICATION).alias("change_type"),
            )
        )
        if not relabel:
            return daily
        before = F.col("day") < F.lit(RENAME_DAY)
        legacy = daily.withColumn(
            "label", F.when(before & (F.col("label") == "5-LOW"), "5-LEGACY").otherwise(F.col("label"))
        )
        open_then = F.max_by(
            F.when(before, F.struct("label", "sub_label")), F.when(before, F.col("day"))
        )
        renamed = (
            legacy.groupBy("ticker")
            .agg(open_then.alias("s"), F.bool_or(F.col("day") == F.lit(RENAME_DAY)).alias("own_event"))
            .filter((F.col("s.label") == "5-LEGACY") & ~F.col("own_event"))
            .select(
                "ticker",
                F.lit(RENAME_DAY).alias("day"),
                F.lit("5-LOW").alias("label"),
                F.col("s.sub_label").alias("sub_label"),
                F.lit(SECTOR_RENAME).alias("change_type"),
            )
        )
        return legacy.unionByName(renamed)

    def _walked_states(self, relabel: bool) -> DataFrame:
        """States with their neighbours; the change log and the snapshot both read this."""
        history = Window.partitionBy("ticker").orderBy("day")
        return self._once(
            f"walked states, relabelled {relabel}",
            lambda: self.states(relabel).select(
                "*",
                F.lag("label").over(history).alias("old_label"),
                F.lag("sub_label").over(history).alias("old_sub_label"),
                F.lead("day").over(history).isNull().alias("is_last"),
            ),
        )

    def change_log(self, relabel: bool = False) -> DataFrame:
        """Changes; the old finer label counts as unrecorded where it was ``P``."""
        return (
            self._walked_states(relabel)
            .filter(F.col("label") != F.col("old_label"))
            .select(
                "ticker",
                "change_type",
                F.col("old_label").alias("old_gics_sector"),
                F.col("label").alias("new_gics_sector"),
                F.nullif(F.col("old_sub_label"), F.lit("P")).alias("old_gics_sub_industry"),
                F.col("sub_label").alias("new_gics_sub_industry"),
                F.date_sub("day", 1).alias("effective_after_close"),
                F.col("day").alias("first_trading_day"),
            )
        )

    def gapped_log(self) -> DataFrame:
        """Changes to 2-HIGH leave up to two days uncovered before them.

        The closing version keeps at least its first day.
        """
        opened = F.lag("first_trading_day").over(
            Window.partitionBy("ticker").orderBy("first_trading_day")
        )
        early = F.greatest(F.date_sub("first_trading_day", 3), opened)
        late = F.col("new_gics_sector") == "2-HIGH"
        return self.change_log().withColumn(
            "effective_after_close", F.when(late, early).otherwise(F.col("effective_after_close"))
        )

    def universe(self, relabel: bool = False) -> DataFrame:
        return (
            self._walked_states(relabel)
            .filter("is_last")
            .select(
                "ticker",
                F.concat(F.lit("Customer "), F.col("ticker").cast("string")).alias("security_name"),
                F.col("label").alias("current_gics_sector"),
                F.col("sub_label").alias("current_sub_industry"),
            )
        )

    def dim(self, relabel: bool = False) -> DataFrame:
        return self._once(
            f"dimension, relabelled {relabel}",
            lambda: scd2.build_scd2(self.universe(relabel), self.change_log(relabel)),
        )

    def gapped_dim(self) -> DataFrame:
        return scd2.build_scd2(self.universe(), self.gapped_log())

    def broken_dim(self) -> DataFrame:
        """A dimension with every defect the checks look for.

        * second versions run fifteen days too long (overlaps),
        * current 3-MEDIUM versions lost their flag (no current row),
        * first versions of 4-NOT SPECIFIED are flagged current (two current rows),
        * versions opened by a change to 2-HIGH start two days late (gaps).
        """
        version, label = F.col("version_number"), F.col("gics_sector")
        return self.dim().withColumns(
            {
                "valid_from": F.when((version > 1) & (label == "2-HIGH"), F.date_add("valid_from", 2)).otherwise(F.col("valid_from")),
                "valid_to": F.when(version == 2, F.date_add("valid_to", 15)).otherwise(F.col("valid_to")),
                "is_current": F.when(F.col("is_current") & (label == "3-MEDIUM"), False)
                .when((version == 1) & (label == "4-NOT SPECIFIED"), True)
                .otherwise(F.col("is_current")),
            }
        )

    def registry(self) -> DataFrame:
        return self.spark.sql(
            """
            SELECT * FROM VALUES
                ('5-LOW', DATE '1998-07-01', CAST(NULL AS DATE)),
                ('5-LEGACY', DATE '1900-01-01', DATE '1998-06-30'),
                ('1-URGENT', DATE '1996-06-01', CAST(NULL AS DATE))
            AS t(gics_sector, existed_from, existed_to)"""
        )

    # --- named entities for the universe ----------------------------------
    def named_snapshot(self) -> DataFrame:
        """All customers, of whom FURNITURE has no label, and all suppliers, which have no price under their own names."""
        suppliers = self.table("supplier").select(
            F.col("s_name").alias("ticker"),
            F.col("s_name").alias("security_name"),
            F.lit("SUPPLIER").alias("gics_sector"),
            F.col("s_nationkey").cast("string").alias("gics_sub_industry"),
        )
        customers = self.table("customer").select(
            F.col("c_name").alias("ticker"),
            F.col("c_name").alias("security_name"),
            F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("gics_sector"),
            F.col("c_nationkey").cast("string").alias("gics_sub_industry"),
        )
        return customers.unionByName(suppliers)

    def holdouts(self) -> DataFrame:
        """Customers in debt."""
        deep = F.col("c_acctbal") < -500
        return (
            self.table("customer")
            .filter(F.col("c_acctbal") < 0)
            .select(
                F.replace(F.col("c_name"), F.lit("#"), F.lit("-")).alias("ticker"),
                F.when(deep, "entity_discontinuity").otherwise("unverified_sector_history").alias("exclusion_class"),
                F.concat(F.lit("in debt: "), F.col("c_mktsegment")).alias("exclusion_reason"),
            )
        )

    # --- second domain: users and their last action of a day --------------
    def user_states(self) -> DataFrame:
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("day"))
            .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))
        )

    def user_dim(self) -> DataFrame:
        return self._event_dim(self.user_states())

    def crowd_dim(self) -> DataFrame:
        """All users as one key, 0: the last action of each day."""
        one = self.table("events").groupBy(F.lit(0).cast("bigint").alias("ticker"), F.col("ts").cast("date").alias("day"))
        return self._event_dim(one.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label")))

    def _event_dim(self, states: DataFrame) -> DataFrame:
        history = Window.partitionBy("ticker").orderBy("day")
        walked = states.select(
            "*",
            F.lag("label").over(history).alias("old_label"),
            F.lead("day").over(history).isNull().alias("is_last"),
        )
        log = walked.filter(F.col("label") != F.col("old_label")).select(
            "ticker",
            F.lit(RECLASSIFICATION).alias("change_type"),
            F.col("old_label").alias("old_gics_sector"),
            F.col("label").alias("new_gics_sector"),
            F.lit(None).cast("string").alias("old_gics_sub_industry"),
            F.lit(None).cast("string").alias("new_gics_sub_industry"),
            F.date_sub("day", 1).alias("effective_after_close"),
            F.col("day").alias("first_trading_day"),
        )
        today = walked.filter("is_last").select(
            "ticker",
            F.col("label").alias("current_gics_sector"),
            F.lit(None).cast("string").alias("current_sub_industry"),
        )
        return scd2.build_scd2(today, log)

    # --- source states for the forward tracker ----------------------------
    def state_on(self, day: date) -> DataFrame:
        """Last label and finer label of each customer up to a day."""
        last = F.max_by(F.struct("label", "sub_label"), F.col("day"))
        return (
            self.states()
            .filter(F.col("day") <= F.lit(day))
            .groupBy("ticker")
            .agg(last.alias("s"))
            .select(
                "ticker",
                F.col("s.label").alias("current_gics_sector"),
                F.col("s.sub_label").alias("current_sub_industry"),
            )
        )

    def membership(self) -> DataFrame:
        """A customer is a member from each order date for thirty days; several intervals each."""
        return self.table("orders").select(
            F.col("o_custkey").alias("ticker"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("end_date"),
        )


def _shipped() -> tuple[Column, ...]:
    """Day, discount and units of a line."""
    return (
        F.col("l_shipdate").cast("date").alias("trade_date"),
        # Nearest whole percent; ``round`` would go through decimals row by row.
        (F.col("l_discount") * 100 + 0.5).cast("bigint").alias("percent_off"),
        F.col("l_quantity").cast("bigint").alias("units"),
    )


def _daily_close(shipments: DataFrame) -> DataFrame:
    return (
        shipments.groupBy("ticker", "trade_date")
        .agg(
            F.sum("percent_off").alias("off"),
            F.count(F.lit(1)).alias("n"),
            F.sum("units").alias("volume"),
        )
        .select(
            "ticker",
            "trade_date",
            (F.lit(100.0) - F.col("off").cast("double") / F.col("n").cast("double")).alias("close_price"),
            "volume",
        )
    )
