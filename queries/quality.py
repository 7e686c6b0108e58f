"""Checks, run on deliberately broken inputs so that they have something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators import quality as dq
from chronoframe.operators import scd2
from queries.family import Family
from queries.mapping import Inputs

FAMILY = Family()


@FAMILY.query(
    """
SELECT b.ticker, a.valid_from AS version_a_from, a.valid_to AS version_a_to, b.valid_from AS version_b_from, b.valid_to AS version_b_to
FROM dim_broken b JOIN dim_broken a ON a.ticker = b.ticker
 AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.version_number < b.version_number))
WHERE coalesce(a.valid_to, DATE '9999-12-31') >= b.valid_from
QUALIFY row_number() OVER (PARTITION BY b.ticker, b.version_number
                           ORDER BY coalesce(a.valid_to, DATE '9999-12-31') DESC, a.valid_from DESC) = 1""",
    "dim_broken",
)
def dq_overlaps(i: Inputs) -> DataFrame:
    return dq.overlaps(i.broken_dim())


@FAMILY.query(
    "SELECT ticker, sum(is_current::INTEGER)::BIGINT AS current_row_count FROM dim_broken GROUP BY ticker HAVING current_row_count >= 2", "dim_broken"
)
def two_current_today(i: Inputs) -> DataFrame:
    """Keys that carry two labels today; the dual-label join refuses them."""
    return dq.current_row_violations(i.broken_dim()).filter("current_row_count > 1")


@FAMILY.query(
    "SELECT ticker, first_trading_day, 2::BIGINT AS occurrences FROM log WHERE new_gics_sector = '1-URGENT'", "log"
)
def duplicate_events(i: Inputs) -> DataFrame:
    """A log in which the changes to 1-URGENT came twice; the build stops on it."""
    log = i.change_log()
    return dq.unique(log.unionByName(log.filter(F.col("new_gics_sector") == "1-URGENT")), ["ticker", "first_trading_day"])


@FAMILY.query(
    "SELECT ticker, count(*) FILTER (is_current) AS current_row_count FROM dim_broken GROUP BY ticker HAVING count(*) FILTER (is_current) <> 1",
    "dim_broken",
)
def dq_current(i: Inputs) -> DataFrame:
    return dq.current_row_violations(i.broken_dim())


@FAMILY.query(
    """
-- An observed day is orphaned if the last version begun before it has ended and another one follows.
SELECT p.ticker, d.valid_to AS gap_starts_after,
       (SELECT min(n.valid_from) FROM dim_gap n WHERE n.ticker = p.ticker AND n.valid_from > p.trade_date) AS gap_ends_before,
       p.trade_date AS orphaned_trading_day
FROM prices p ASOF JOIN dim_gap d ON d.ticker = p.ticker AND p.trade_date >= d.valid_from
WHERE d.valid_to < p.trade_date AND gap_ends_before IS NOT NULL""",
    "dim_gap",
    "prices",
)
def dq_gaps(i: Inputs) -> DataFrame:
    return dq.gap_days(i.gapped_dim(), i.prices())


@FAMILY.query("SELECT * FROM unresolved", "unresolved")
def dq_integrity(i: Inputs) -> DataFrame:
    return dq.integrity_violations(i.prices(), i.broken_dim())


@FAMILY.query(
    """
-- An opening version alone is left where no change led to 1-URGENT.
SELECT ticker, count(*) FILTER (change_reason = 'initial' OR gics_sector = '1-URGENT') AS dimension_rows
FROM dim WHERE ticker IN (FROM log SELECT ticker INTERSECT FROM universe SELECT ticker)
GROUP BY ticker HAVING dimension_rows < 2""",
    "log",
    "universe",
    "dim",
)
def dq_unapplied(i: Inputs) -> DataFrame:
    """A dimension that only applied changes to 1-URGENT."""
    partial = i.dim().filter((F.col("change_reason") == "initial") | (F.col("gics_sector") == "1-URGENT"))
    return dq.unapplied_changes(i.change_log(), i.universe(), partial)


@FAMILY.query(
    """
SELECT * FROM (SELECT 'gics_sector' AS column_name, count(*) FILTER (gics_sector IS NULL) AS null_rows FROM dim
               UNION ALL SELECT 'gics_sub_industry', count(*) FILTER (gics_sub_industry IS NULL) FROM dim
               UNION ALL SELECT 'valid_to', count(*) FILTER (valid_to IS NULL) FROM dim)
WHERE null_rows > 0""",
    "dim",
)
def dq_not_null(i: Inputs) -> DataFrame:
    return dq.not_null(i.dim(), ["gics_sector", "gics_sub_industry", "valid_to"])


@FAMILY.query(
    "SELECT ticker, valid_from, count(*) AS occurrences FROM dim_broken GROUP BY ALL HAVING count(*) > 1", "dim_broken"
)
def dq_unique_version_start(i: Inputs) -> DataFrame:
    return dq.unique(i.broken_dim(), ["ticker", "valid_from"])


@FAMILY.query(
    "SELECT l_orderkey, l_shipdate, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1"
)
def dq_unique_shipment_day(i: Inputs) -> DataFrame:
    return dq.unique(i.table("lineitem").select("l_orderkey", "l_shipdate"), ["l_orderkey", "l_shipdate"])


@FAMILY.query(
    "SELECT o_orderpriority, count(*) AS occurrences FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL"
)
def dq_accepted(i: Inputs) -> DataFrame:
    return dq.accepted(i.table("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@FAMILY.query(
    "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) + 60 AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 60"
)
def dq_ordered_dates(i: Inputs) -> DataFrame:
    orders = i.table("orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 60).alias("due"))
    shipped = i.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    both = shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return dq.ordered(both, "shipped", "due", strict=False)


_SHAPE = """
SELECT ticker, version_number, valid_from, valid_to, 'current flag and end disagree' AS broken_rule FROM dim_broken WHERE is_current <> (valid_to IS NULL)
UNION ALL SELECT ticker, version_number, valid_from, valid_to, 'ends before it starts' FROM dim_broken WHERE valid_to < valid_from"""


@FAMILY.query(_SHAPE, "dim_broken")
def dq_scd2_shape(i: Inputs) -> DataFrame:
    return dq.scd2_shape(i.broken_dim())


@FAMILY.query(
    "SELECT ticker, count(*) AS group_rows FROM dim GROUP BY ticker HAVING count(*) NOT BETWEEN 2 AND 12", "dim"
)
def dq_group_size(i: Inputs) -> DataFrame:
    return dq.group_size_violations(i.dim(), ["ticker"], least=2, most=12)


_SUITE = f"""
SELECT check_name, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'exactly one current version' AS check_name, count(*) AS violations FROM (SELECT ticker FROM dim_broken GROUP BY ticker HAVING count(*) FILTER (is_current) <> 1)
  UNION ALL SELECT 'every fact resolves to one version', count(*) FROM unresolved
  UNION ALL SELECT 'version rows are well formed', count(*) FROM ({_SHAPE})
  UNION ALL SELECT 'versions do not overlap', count(*) FROM dim_broken b WHERE EXISTS (
    SELECT 1 FROM dim_broken a WHERE a.ticker = b.ticker AND (a.valid_from, a.version_number) < (b.valid_from, b.version_number) AND coalesce(a.valid_to, DATE '9999-12-31') >= b.valid_from)
  UNION ALL SELECT 'no observed day in a gap', count(*) FROM prices p
    -- Of versions that begin on one day, the one with the highest number is the last begun.
    ASOF JOIN (FROM dim_broken QUALIFY version_number = max(version_number) OVER (PARTITION BY ticker, valid_from)) d ON d.ticker = p.ticker AND p.trade_date >= d.valid_from
    WHERE d.valid_to < p.trade_date AND EXISTS (SELECT 1 FROM dim_broken n WHERE n.ticker = p.ticker AND n.valid_from > p.trade_date)
  UNION ALL SELECT 'known reasons', count(*) FROM (SELECT DISTINCT change_reason FROM dim_broken WHERE change_reason NOT IN ('initial', 'sector_rename'))
  UNION ALL SELECT 'one version a start', count(*) FROM (SELECT 1 FROM dim_broken GROUP BY ticker, valid_from HAVING count(*) > 1)
  UNION ALL SELECT 'one version a label', count(*) FROM (SELECT 1 FROM dim_broken GROUP BY ticker, gics_sector HAVING count(*) > 1)
  UNION ALL SELECT 'labels and finer labels present', (SELECT (count(gics_sector) < count(*))::INT + (count(gics_sub_industry) < count(*))::INT FROM dim_broken)
  UNION ALL SELECT 'lasting versions', count(*) FROM dim_broken WHERE valid_to - valid_from < 30
  UNION ALL SELECT 'reconciliation', count(*) FROM universe u JOIN dim d ON d.ticker = u.ticker AND d.is_current WHERE d.gics_sector <> u.current_gics_sector)"""


def _suite(i: Inputs) -> DataFrame:
    """The broken dimension is read twice, for its own rules and for its history; the facts once."""
    broken = i.stored("dim_broken", i.broken_dim())
    own = {
        "known reasons": dq.Accepted("change_reason", ("initial", "sector_rename")),
        "one version a start": dq.Unique(("ticker", "valid_from")),
        "one version a label": dq.Unique(("ticker", "gics_sector")),
        "labels and finer labels present": dq.NotNull(("gics_sector", "gics_sub_industry")),
        "lasting versions": dq.Rows((F.datediff("valid_to", "valid_from") < 30,)),
    }
    between = dq.run_suite({"reconciliation": scd2.reconcile(i.dim(), i.universe())}).drop("status")
    return dq.history_checks(broken, i.prices()).unionByName(dq.table_checks(broken, own)).unionByName(between)


@FAMILY.query(_SUITE, "dim_broken", "unresolved", "universe")
def dq_suite(i: Inputs) -> DataFrame:
    return dq.verdicts(_suite(i))


@FAMILY.query(f"SELECT check_name, violations FROM ({_SUITE}) WHERE violations > 0", "dim_broken", "unresolved", "universe")
def dq_warnings(i: Inputs) -> DataFrame:
    return _suite(i).filter("violations > 0")


@FAMILY.query("SELECT count(*) AS actual_rows FROM region HAVING count(*) <> 1")
def dq_singleton(i: Inputs) -> DataFrame:
    return dq.expect_rows(i.table("region"), 1)
