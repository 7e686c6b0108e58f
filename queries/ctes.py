"""SQL definitions of the same roles, for the oracle: other formulations than those of the operators."""

from __future__ import annotations

WINDOW_SQL = "BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
END = "coalesce(valid_to, DATE '9999-12-31')"
GUARD = "ln(1 + greatest(mean_return, -0.9999))"


def _family(tag: str, states: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """walked states -> log, universe, dimension, for the plain or the relabelled states."""
    return {
        f"walked{tag}": ((states,), f"""
            SELECT *, lag(label) OVER w AS old_label, lag(sub_label) OVER w AS old_sub_label,
                   lead(day) OVER w IS NULL AS is_last
            FROM {states} WINDOW w AS (PARTITION BY ticker ORDER BY day)"""),
        f"log{tag}": ((f"walked{tag}",), f"""
            SELECT ticker, change_type, old_label AS old_gics_sector, label AS new_gics_sector,
                   nullif(old_sub_label, 'P') AS old_gics_sub_industry,
                   sub_label AS new_gics_sub_industry,
                   day - 1 AS effective_after_close, day AS first_trading_day
            FROM walked{tag} WHERE label <> old_label"""),
        f"universe{tag}": ((f"walked{tag}",), f"""
            SELECT ticker, 'Customer ' || CAST(ticker AS VARCHAR) AS security_name,
                   label AS current_gics_sector, sub_label AS current_sub_industry
            FROM walked{tag} WHERE is_last"""),
        **_dimension(tag, f"log{tag}", f"universe{tag}"),
    }


def _dimension(tag: str, log: str, universe: str) -> dict[str, tuple[tuple[str, ...], str]]:
    return {
        f"opening{tag}": ((log, universe), f"""
            SELECT u.ticker,
                   CASE WHEN f.ticker IS NULL THEN u.current_gics_sector ELSE f.old_gics_sector END AS gics_sector,
                   CASE WHEN f.ticker IS NULL THEN u.current_sub_industry ELSE f.old_gics_sub_industry END AS gics_sub_industry
            FROM {universe} u
            LEFT JOIN (SELECT * FROM (
                         SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY first_trading_day) AS nth FROM {log})
                       WHERE nth = 1) f ON f.ticker = u.ticker"""),
        f"dim{tag}": ((f"opening{tag}", log, universe), f"""
            SELECT ticker, gics_sector, gics_sub_industry, valid_from,
                   lead(closes) OVER w AS valid_to, lead(closes) OVER w IS NULL AS is_current,
                   CAST(row_number() OVER w AS INTEGER) AS version_number, change_reason
            FROM (SELECT ticker, gics_sector, gics_sub_industry, DATE '1900-01-01' AS valid_from,
                         CAST(NULL AS DATE) AS closes, 'initial' AS change_reason FROM opening{tag}
                  UNION ALL
                  SELECT ticker, new_gics_sector, new_gics_sub_industry, first_trading_day,
                         effective_after_close, change_type
                  FROM {log} WHERE ticker IN (SELECT ticker FROM {universe}))
            WINDOW w AS (PARTITION BY ticker ORDER BY valid_from)"""),
    }


def _facts(tag: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Dual-label fact, daily series and anchor metric of one dimension."""
    return {
        f"fact{tag}": (("returns", f"dim{tag}"), f"""
            SELECT r.ticker, r.trade_date, r.daily_return, r.log_return,
                   p.version_number, p.gics_sector AS sector_at_trade_date,
                   n.gics_sector AS sector_today, p.gics_sector <> n.gics_sector AS is_misattributed
            FROM returns r
            JOIN dim{tag} p ON p.ticker = r.ticker AND r.trade_date BETWEEN p.valid_from AND coalesce(p.valid_to, DATE '9999-12-31')
            JOIN dim{tag} n ON n.ticker = r.ticker AND n.is_current
            WHERE r.daily_return IS NOT NULL"""),
        # Both roles of an observation as a list, spread once: every later figure is taken from these rows.
        f"roles{tag}": ((f"fact{tag}",), f"""
            SELECT ticker, trade_date, daily_return, is_misattributed,
                   unnest(['point_in_time', 'naive']) AS join_basis,
                   unnest([sector_at_trade_date, sector_today]) AS gics_sector
            FROM fact{tag} WHERE trade_date {WINDOW_SQL}"""),
        f"daily{tag}": ((f"roles{tag}",), f"""
            SELECT join_basis, gics_sector, trade_date, count(*) AS constituent_count,
                   sum(daily_return) / count(daily_return) AS mean_return
            FROM roles{tag} GROUP BY join_basis, gics_sector, trade_date"""),
        f"growth{tag}": ((f"daily{tag}",), f"""
            SELECT gics_sector, join_basis, trade_date, {GUARD} AS g,
                   min(trade_date) FILTER (join_basis = 'naive') OVER label AS naive_from,
                   min(trade_date) FILTER (join_basis <> 'naive') OVER label AS pit_from
            FROM daily{tag} WINDOW label AS (PARTITION BY gics_sector)"""),
        f"labels{tag}": ((f"growth{tag}",), f"""
            SELECT gics_sector, max(greatest(naive_from, pit_from)) AS comparison_start,
                   count(DISTINCT join_basis) AS bases_present,
                   exp(sum(g) FILTER (join_basis = 'naive')) - 1 AS naive_whole,
                   exp(sum(g) FILTER (join_basis = 'naive' AND trade_date >= greatest(naive_from, pit_from))) - 1 AS naive_common,
                   exp(sum(g) FILTER (join_basis <> 'naive' AND trade_date >= greatest(naive_from, pit_from))) - 1 AS pit_common
            FROM growth{tag} GROUP BY gics_sector"""),
        f"days{tag}": ((f"daily{tag}",), f"SELECT DISTINCT trade_date FROM daily{tag}"),
        f"moved{tag}": ((f"roles{tag}",), f"SELECT ticker, gics_sector, join_basis FROM roles{tag} WHERE is_misattributed"),
        f"movers{tag}": ((f"moved{tag}",), f"""
            SELECT gics_sector, sum(times)::BIGINT AS misattributed_observations, count(*) AS reclassified_tickers
            FROM (SELECT gics_sector, ticker, count(*) AS times FROM moved{tag} GROUP BY gics_sector, ticker)
            GROUP BY gics_sector"""),
        f"absent{tag}": ((f"dim{tag}", f"days{tag}"), f"""
            WITH calendar AS (SELECT list(trade_date) AS observed FROM days{tag}),
            born AS (SELECT gics_sector, min(valid_from) AS sector_existed_from FROM dim{tag} GROUP BY gics_sector)
            SELECT gics_sector, sector_existed_from, len(observed) AS trading_days_in_window,
                   len(list_filter(observed, lambda day: day < sector_existed_from)) AS trading_days_sector_absent
            FROM born, calendar"""),
        f"anchor{tag}": ((f"labels{tag}", f"movers{tag}", f"absent{tag}", f"days{tag}"), f"""
            SELECT l.gics_sector, DATE '1996-01-01' AS analysis_start, DATE '2000-12-31' AS analysis_end, comparison_start,
                   100 * naive_common AS naive_cumulative_return, 100 * pit_common AS pit_cumulative_return,
                   100 * naive_common - 100 * pit_common AS difference_pp,
                   abs(100 * naive_common - 100 * pit_common) AS abs_difference_pp,
                   100 * naive_whole AS naive_full_window_return,
                   naive_common IS NOT NULL AS exists_in_naive_basis, pit_common IS NOT NULL AS exists_in_pit_basis,
                   ifnull(reclassified_tickers, 0) AS reclassified_tickers,
                   ifnull(misattributed_observations, 0) AS misattributed_observations,
                   sector_existed_from, observed.n AS trading_days_in_window,
                   ifnull(trading_days_sector_absent, 0) AS trading_days_sector_absent,
                   round(ifnull(trading_days_sector_absent, 0) * 100.0::DOUBLE / observed.n, 4) AS pct_period_sector_absent
            FROM labels{tag} l CROSS JOIN (SELECT count(*) AS n FROM days{tag}) observed
            LEFT JOIN movers{tag} USING (gics_sector) LEFT JOIN absent{tag} USING (gics_sector)"""),
    }


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "prices": ((), """
        SELECT o_custkey AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
               100.0::DOUBLE - CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS close_price,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "nation_prices": ((), """
        SELECT CAST(c_nationkey AS BIGINT) AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
               100.0::DOUBLE - CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS close_price,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "named_prices": ((), """
        SELECT printf('Customer-%09d', o_custkey) AS ticker, CAST(l_shipdate AS DATE) AS trade_date
        FROM lineitem, orders WHERE l_orderkey = o_orderkey
        UNION SELECT printf('Vendor-%09d', l_suppkey), CAST(l_shipdate AS DATE) FROM lineitem"""),
    "chained": (("prices",), """
        SELECT *, lag(close_price) OVER (PARTITION BY ticker ORDER BY trade_date) AS prev_close FROM prices"""),
    "returns": (("chained",), """
        SELECT ticker, trade_date, close_price, prev_close,
               close_price / nullif(prev_close, 0) - 1 AS daily_return,
               CASE WHEN close_price / nullif(prev_close, 0) > 0 THEN ln(close_price / nullif(prev_close, 0)) END AS log_return,
               volume
        FROM chained"""),
    "states": ((), """
        SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS day,
               arg_max(o_orderpriority, o_orderkey) AS label, arg_max(o_orderstatus, o_orderkey) AS sub_label,
               'reclassification' AS change_type
        FROM orders GROUP BY 1, 2"""),
    "legacy": (("states",), """
        SELECT ticker, day, sub_label, change_type,
               CASE WHEN label = '5-LOW' AND day < DATE '1998-07-01' THEN '5-LEGACY' ELSE label END AS label
        FROM states"""),
    "states_rl": (("legacy",), """
        SELECT ticker, day, label, sub_label, change_type FROM legacy
        UNION ALL
        SELECT ticker, DATE '1998-07-01', '5-LOW', sub_label, 'sector_rename'
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS nth
              FROM legacy WHERE day < DATE '1998-07-01') l
        WHERE nth = 1 AND label = '5-LEGACY'
          AND NOT EXISTS (SELECT 1 FROM legacy x WHERE x.ticker = l.ticker AND x.day = DATE '1998-07-01')"""),
    "log_gap": (("log",), """
        SELECT * REPLACE (CASE WHEN new_gics_sector = '2-HIGH' THEN greatest(first_trading_day - 3,
                              lag(first_trading_day) OVER (PARTITION BY ticker ORDER BY first_trading_day)) ELSE effective_after_close END
                          AS effective_after_close) FROM log"""),
    "dim_broken": (("dim",), """
        SELECT ticker, gics_sector, gics_sub_industry,
               CASE WHEN version_number > 1 AND gics_sector = '2-HIGH' THEN valid_from + 2 ELSE valid_from END AS valid_from,
               CASE WHEN version_number = 2 THEN valid_to + 15 ELSE valid_to END AS valid_to,
               CASE WHEN is_current AND gics_sector = '3-MEDIUM' THEN FALSE
                    WHEN version_number = 1 AND gics_sector = '4-NOT SPECIFIED' THEN TRUE
                    ELSE is_current END AS is_current,
               version_number, change_reason
        FROM dim"""),
    # Covered days spelled out one by one within the calendar of the prices, then looked up.
    "covered": (("prices", "dim_broken"), """
        SELECT ticker, unnest(range(greatest(valid_from, low), least(ifnull(valid_to, high), high) + 1, INTERVAL 1 DAY))::DATE AS trade_date
        FROM dim_broken, (SELECT min(trade_date) AS low, max(trade_date) AS high FROM prices)"""),
    "unresolved": (("prices", "covered"), """
        SELECT ticker, trade_date, ifnull(n, 0) AS matching_dimension_rows
        FROM prices LEFT JOIN (SELECT ticker, trade_date, count(*) AS n FROM covered GROUP BY ALL) USING (ticker, trade_date) WHERE n IS DISTINCT FROM 1"""),
    "registry": ((), """
        SELECT * FROM (VALUES ('5-LOW', DATE '1998-07-01', CAST(NULL AS DATE)),
                              ('5-LEGACY', DATE '1900-01-01', DATE '1998-06-30'),
                              ('1-URGENT', DATE '1996-06-01', CAST(NULL AS DATE)))
        AS t(gics_sector, existed_from, existed_to)"""),
    "named_snapshot": ((), """
        SELECT c_name AS ticker, nullif(c_mktsegment, 'FURNITURE') AS gics_sector, CAST(c_nationkey AS VARCHAR) AS gics_sub_industry
        FROM customer
        UNION ALL SELECT s_name, 'SUPPLIER', CAST(s_nationkey AS VARCHAR) FROM supplier"""),
    "holdouts": ((), """
        SELECT replace(c_name, '#', '-') AS ticker,
               CASE WHEN c_acctbal < -500 THEN 'entity_discontinuity' ELSE 'unverified_sector_history' END AS exclusion_class,
               'in debt: ' || c_mktsegment AS exclusion_reason
        FROM customer WHERE c_acctbal < 0"""),
    "named_universe": (("named_prices", "named_snapshot", "holdouts"), """
        SELECT p.ticker, s.ticker AS snapshot_ticker, s.ticker AS security_name,
               s.gics_sector AS current_gics_sector, s.gics_sub_industry AS current_sub_industry,
               min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, count(*) AS trading_days
        FROM named_prices p JOIN named_snapshot s ON replace(s.ticker, '#', '-') = p.ticker
        WHERE s.gics_sector IS NOT NULL AND p.ticker NOT IN (SELECT ticker FROM holdouts)
        GROUP BY ALL"""),
    "user_states": ((), """
        SELECT user_id AS ticker, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS label
        FROM events GROUP BY 1, 2"""),
    "user_walked": (("user_states",), """
        SELECT *, lag(label) OVER w AS old_label, lead(day) OVER w IS NULL AS is_last
        FROM user_states WINDOW w AS (PARTITION BY ticker ORDER BY day)"""),
    "log_user": (("user_walked",), """
        SELECT ticker, 'reclassification' AS change_type, old_label AS old_gics_sector, label AS new_gics_sector,
               CAST(NULL AS VARCHAR) AS old_gics_sub_industry, CAST(NULL AS VARCHAR) AS new_gics_sub_industry,
               day - 1 AS effective_after_close, day AS first_trading_day
        FROM user_walked WHERE label <> old_label"""),
    "universe_user": (("user_walked",), """
        SELECT ticker, label AS current_gics_sector, CAST(NULL AS VARCHAR) AS current_sub_industry
        FROM user_walked WHERE is_last"""),
    "crowd_walked": ((), """
        SELECT *, lag(label) OVER (ORDER BY day) AS old_label, day = max(day) OVER () AS is_last
        FROM (SELECT 0::BIGINT AS ticker, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY 2)"""),
    "log_crowd": (("crowd_walked",), """
        SELECT ticker, 'reclassification' AS change_type, old_label AS old_gics_sector, label AS new_gics_sector,
               CAST(NULL AS VARCHAR) AS old_gics_sub_industry, CAST(NULL AS VARCHAR) AS new_gics_sub_industry,
               day - 1 AS effective_after_close, day AS first_trading_day
        FROM crowd_walked WHERE label <> old_label"""),
    "universe_crowd": (("crowd_walked",), """
        SELECT ticker, label AS current_gics_sector, CAST(NULL AS VARCHAR) AS current_sub_industry
        FROM crowd_walked WHERE is_last"""),
    "membership": ((), """
        SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 30 AS end_date
        FROM orders"""),
    **_family("", "states"),
    **_family("_rl", "states_rl"),
    **_dimension("_gap", "log_gap", "universe"),
    **_dimension("_user", "log_user", "universe_user"),
    **_dimension("_crowd", "log_crowd", "universe_crowd"),
    **_facts(""),
    **_facts("_rl"),
    "dim_held": (("dim_rl",), """
        SELECT * FROM dim_rl WHERE ticker NOT IN (
            SELECT ticker FROM dim_rl
            WHERE gics_sector = '5-LOW' AND greatest(valid_from, DATE '1996-01-01') < DATE '1998-07-01'
              AND coalesce(valid_to, DATE '9999-12-31') >= DATE '1996-01-01')"""),
    **_facts("_held"),
}


def with_ctes(select: str, *names: str, recursive: bool = False) -> str:
    """Prefix a SELECT with the named definitions and all they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in CTES[name][0]:
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select
    # A recursive walk reads its input once per step: compute that input once.
    how = "MATERIALIZED " if recursive else ""
    body = ",\n".join(f"{name} AS {how}({CTES[name][1]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"
