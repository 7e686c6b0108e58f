"""Conversation repair against plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from chronoframe.llm import queries, repair

SPACES = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")
INITIALS = {"system": "s", "user": "u", "assistant": "a"}


def carried_out(audit, rows):
    """Cost and resulting rows, or None where the audit does not fit; the roles of R and I follow from the pattern."""
    cost, out, waiting = 0, [], list(rows)
    for edit in audit:
        expected = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            cost += 5
            out.append((expected, ""))
            continue
        if not waiting:
            return None
        role, text, fault = waiting.pop(0)
        if edit == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (5 if fault == "truncated" else 0) + (edit == "R")
        out.append((expected, text) if edit == "R" else (role, text))
    if waiting or not PATTERN.fullmatch("".join(role[:1] or "?" for role, _ in out)):
        return None
    return cost, out


def searched(rows):
    best = None
    for length in range(len(rows), len(rows) + 3):
        for audit in map("".join, itertools.product("DIKR", repeat=length)):
            if audit.count("I") == length - len(rows):
                got = carried_out(audit, rows)
                if got and (best is None or (got[0], audit) < best[:2]):
                    best = (got[0], audit, got[1])
    return best


def marked(rows):
    """(role, text, fault) of (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(conversation):
    """The contract's row for (turn, role, text) rows after damage."""
    rows = sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    faulty = marked([r[1:] for r in rows])
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(faulty)]
    cost, audit, out = searched(faulty)
    counts = [sum(f == kind for *_, f in faulty) for kind in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    left = plain_damage(rows)
    return sorted(((conv, *plain([r[1:] for r in left if r[0] == conv])) for conv in {r[0] for r in rows}), key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_symbols_match_search():
    known = repair.matrices([])
    rng = random.Random(1)
    letters = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for length in range(5):
        for symbols in rng.sample(list(itertools.product(repair.SYMBOLS, repeat=length)), min(60, 9**length)):
            rows = [("user", " ", "blank") if c == "x" else (letters[c.lower()], f"{k}", "truncated" if c.isupper() else "") for k, c in enumerate(symbols)]
            assert repair.cheapest("".join(symbols), known) == searched(rows)[:2]


def test_rules_do_not_change_the_result():
    rng = random.Random(2)
    rules = ["ua", "Ā" * 2, "āā", "xU", "aĀ"]  # Ā is the first rule, ā the second
    known, single = repair.matrices(rules), repair.matrices([])
    for _ in range(200):
        symbols = "".join(rng.choices("suauauaUAxo", k=rng.randint(0, 60)))
        assert repair.cheapest(repair.compressed([symbols], rules), known) == repair.cheapest(symbols, single)


def test_ropes_compare_as_texts():
    rng = random.Random(3)

    def grown(text):
        if len(text) < 2 or rng.random() < 0.2:
            return text
        cut = rng.randint(0, len(text))
        return (grown(text[:cut]), grown(text[cut:])) if 0 < cut < len(text) else ("", grown(text))

    for _ in range(500):
        x, y = ("".join(rng.choices("DI", k=rng.randint(0, 6))) for _ in range(2))
        a, b = grown(x), grown(y)
        assert repair.before(a, b) == (x < y) and repair.text_of(a) == x
        shared = grown("KKR")
        assert repair.before((shared, a), (shared, b)) == (x < y)


def test_long_conversations_stay_quick():
    symbols = "suaUAoxaau" * 3000
    cost, audit = repair.cheapest(symbols, repair.matrices([]))
    assert len(audit) >= len(symbols) and cost > 0
    rules = ["ua", "su", "UA"]
    assert repair.cheapest(repair.compressed([symbols], rules), repair.matrices(rules)) == (cost, audit)


TEXTS = ["Yes.", "no", "", " \n", "What?", "é!", None, "cut off ", "end.  \t"]
ROLES = ["system", "user", "assistant", "tool", "", None, "User"]


@pytest.mark.parametrize("many", [0, 60])
def test_query_matches_search(spark, tmp_path, many):
    rng = random.Random(4)
    rows = []
    for conv in [*range(many), None] if many else []:
        for turn in [None, *range(rng.randint(0, 4))][rng.randint(0, 1) :]:
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.7 else rng.choice(ROLES)
            rows += [(conv, turn, role, rng.choice(TEXTS))] * (2 if rng.random() < 0.1 else 1)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, present string, kind int")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_ties_of_a_turn_and_text_ids(spark):
    rows = [("a", 1, "user", "b."), ("a", 1, "user", "a."), ("a", 1, "assistant", "c."), ("b", None, "user", "x"), ("b", None, "user", "x")]
    found = repair.Repair(spark.createDataFrame(rows, "c string, t int, r string, x string"), "c", "t", "r", "x")
    plans = {r.conv: r for r in found.plans.collect()}
    assert {k: (r.duplicate, r.audit) for k, r in plans.items()} == {
        "a": (0, searched(marked([("assistant", "c."), ("user", "a."), ("user", "b.")]))[1]),
        "b": (1, searched(marked([("user", "x"), ("user", "x")]))[1]),
    }
    result = found.repaired().where("conv = 'a'").orderBy("place").collect()
    assert PATTERN.fullmatch("".join(r.role[0] for r in result))
