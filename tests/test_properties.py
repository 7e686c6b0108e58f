"""Random histories against brute force, with one key holding a third of the rows."""

import random
from datetime import date, timedelta

import pytest

from chronoframe.operators import joins, scd2
from chronoframe.operators import quality as dq

LABELS = ["A", "B", "C", "D"]
START = date(2019, 11, 1)
LOG = (
    "ticker:s change_type:s old_gics_sector:s new_gics_sector:s old_gics_sub_industry:s "
    "new_gics_sub_industry:s effective_after_close:d first_trading_day:d"
)


def history(seed, keys=12, days=420, gaps=False):
    """Change log, end state, and each key's label per day worked out by hand."""
    rng = random.Random(seed)
    log, today, by_day = [], [], {}
    for k in range(keys):
        key = f"K{k}"
        changes = sorted(rng.sample(range(5, days), rng.randint(0, 60 if k == 0 else 6)))
        label = rng.choice(LABELS)
        spans, since = [], None
        for offset in changes:
            new = rng.choice([x for x in LABELS if x != label])
            last = offset - 1 - (rng.randint(0, 2) if gaps else 0)
            last = max(last, since if since is not None else last)
            log.append((key, "reclassification", label, new, None, None,
                        START + timedelta(days=last), START + timedelta(days=offset)))
            spans.append((since, last, label))
            label, since = new, offset
        spans.append((since, None, label))
        today.append((key, key, label, None))
        for d in range(days):
            hits = [lab for lo, hi, lab in spans if (lo is None or d >= lo) and (hi is None or d <= hi)]
            by_day[key, START + timedelta(days=d)] = hits
    rng.shuffle(log)
    return log, today, by_day


@pytest.fixture(params=[(1, False), (2, False), (3, True)], ids=["seed1", "seed2", "gaps"])
def world(request, frame):
    seed, gaps = request.param
    log, today, by_day = history(seed, gaps=gaps)
    rng = random.Random(seed)
    # K0 is seen every day, the others now and then.
    seen = [kd for kd in by_day if kd[0] == "K0" or rng.random() < 0.12]
    universe = frame("ticker:s security_name:s current_gics_sector:s current_sub_industry:s", today)
    dim = scd2.build_scd2(universe, frame(LOG, log)).cache()
    facts = frame("ticker:s trade_date:d", seen).cache()
    yield dim, facts, {kd: by_day[kd] for kd in seen}, universe, gaps
    dim.unpersist()
    facts.unpersist()


def test_every_strategy_finds_the_label_of_the_day(world):
    dim, facts, expected, _, _ = world
    wanted = sorted((k, d, labels[0]) for (k, d), labels in expected.items() if labels)
    for options in (
        {"strategy": "range"}, {"strategy": "asof"},
        {"strategy": "sliced", "slice_unit": "month"}, {"strategy": "sliced", "slice_unit": "quarter"},
        {"strategy": "sliced", "slice_unit": "year"},
    ):
        joined = joins.pit_join(facts, dim, **options)
        got = sorted((r.ticker, r.trade_date, r.gics_sector) for r in joined.collect())
        assert got == wanted, options


def test_match_counts_agree_with_the_join(world):
    dim, facts, expected, _, _ = world
    got = {(r.ticker, r.trade_date): r.matching_dimension_rows for r in joins.match_counts(facts, dim).collect()}
    assert got == {kd: len(labels) for kd, labels in expected.items()}


def test_replay_lands_on_todays_state_and_stays_well_formed(world):
    dim, facts, expected, universe, gaps = world
    assert scd2.reconcile(dim, universe).isEmpty()
    for check in (dq.overlaps(dim), dq.current_row_violations(dim), dq.scd2_shape(dim)):
        assert check.isEmpty()
    orphans = {(r.ticker, r.orphaned_trading_day) for r in dq.gap_days(dim, facts).collect()}
    assert orphans == {kd for kd, labels in expected.items() if not labels}
    assert bool(orphans) == gaps
