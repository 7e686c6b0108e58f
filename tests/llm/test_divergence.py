"""Source divergence against a plain count."""

import random
import re
from collections import Counter

import pytest

from chronoframe.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, most):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    rows = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= 3)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = Counter(t for d in mine for t in d[2] if t in set(kept))

        def p(counter, term):
            return 1 + 10**9 * (counter[term] + 1) // (sum(counter.values()) + len(kept))

        for s, counter in counts.items():
            pairs = [(o, sum((p(counter, t) - p(c, t)) ** 2 // p(c, t) for t in kept)) for o, c in counts.items() if o != s]
            terms = [(t, (p(counter, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if counter[t] and p(counter, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < most]
    return sorted(rows)


@pytest.mark.parametrize("blocks", [{}, {"block_cells": 5, "products": 3}])
def test_against_a_plain_count(spark, blocks):
    rng = random.Random(1)
    words = ["the", "The", "Éa", "éa", "x1y", "z_z", "漢字", "𝒳", "don't", " ", *(f"w{chr(97 + k)}" for k in range(12))]
    docs = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "", None, "ü"]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(80)]
    docs += [("en", "d", None), ("en", "e", ""), ("xx", "a", "once only"), ("xx", "b", None), ("yy", "a", "one " * 3000), *[("en", "a", "the copy")] * 4]
    table = spark.createDataFrame([(*d, 1, "t") for d in docs], "lang string, source string, text string, n int, term string")
    got = divergence.audit(table, most=5, **blocks)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == plain(docs, 5)
    assert divergence.audit(table.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Wort ÄÖ, x" * 500 + "q" * 300 + " ende").encode()
    whole = divergence.words_of(text)
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert divergence.words_of(text) == whole and whole[b"wort"] == 1 and whole[b"xwort"] == 499


def test_counters_are_sent_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    rows = [("l", "s", f"a b{chr(97 + k)} a") for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2].encode() for r in rows])], names=["l", "s", "t"])
    sent = list(divergence._count([batch]))
    total, docs = Counter(), Counter()
    for part in sent:
        for r in part.to_pylist():
            total[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert len(sent) > 3 and total["a"] == 40 and docs["a"] == 20 and total["bc"] == 1


def test_slices_and_texts_longer_than_a_slice(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SLICE", 64)
    rng = random.Random(3)
    texts = ["ab", "cd", "", None, "Ä", "ä b", " x ", "no gap at the end", "same " * 40, "Langes Wort " * 30, *(" ".join(rng.choices(["Aa", "aA", "漢字", "b1c", "-"], k=rng.randint(0, 25))) for _ in range(60))]
    docs = [(rng.choice(["en", ""]), rng.choice(["a", "b", "ü"]), t) for t in texts]
    columns = [pa.array([d[k] for d in docs], pa.string()) for k in range(3)]
    batch = pa.RecordBatch.from_arrays([*columns[:2], columns[2].cast(pa.binary())], names=["l", "s", "t"])
    total, seen = Counter(), Counter()
    for part in divergence._count([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)]):
        for r in part.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            seen[r["lang"], r["source"], r["term"]] += r["docs"]
    words = [(lang, source, TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    assert total == Counter((lang, source, w) for lang, source, ws in words for w in ws)
    assert seen == Counter((lang, source, w) for lang, source, ws in words for w in set(ws))


def test_texts_are_counted_in_a_fraction_of_the_time_of_counters():
    import time

    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(20_000)]
    texts = [" ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(400)).encode() for _ in range(1500)]
    langs, sources = ["en", "de", "fr"] * 500, [f"s{k % 7}" for k in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array(texts)], names=["l", "s", "t"])

    def plain():
        groups: dict = {}
        for lang, source, text in zip(langs, sources, texts):
            counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            found = divergence.words_of(text)
            counts.update(found)
            docs.update(found.keys())
        return groups

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: list(divergence._count([batch]))) < 0.6 * seconds(plain)


def test_counts_of_a_word_meet_in_one_shuffle(spark, monkeypatch):
    plans = {}

    def kept(df, name, store=divergence.stored):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(divergence, "stored", kept)
    docs = spark.createDataFrame([("en", "a", "one two"), ("en", "b", "two")] * 3, "lang string, source string, text string")
    levels = divergence.Levels(docs, "lang", "source", "text", 3)
    assert plans["kept"].count("Exchange") == 1 and "Join" not in plans["kept"] and "terms" not in plans
    assert sorted(tuple(r) for r in levels.cells.select("source", "term", "n", "lang_n").collect()) == [("a", "one", 3, 3), ("a", "two", 3, 6), ("b", "two", 3, 6)]
    assert [r[0] for r in levels.groups.select("kept").collect()] == [2, 2]


def test_a_term_of_many_sources_and_pieces_of_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BLOCK_CELLS", 2)
    rng = random.Random(5)
    rows = [(lang, block, f"t{t}", f"s{s:02}", rng.randint(1, 3)) for block in range(2) for lang in ("de", "en") for t in range(6) for s in rng.sample(range(30), 29 if t == 2 else 4)]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[low : low + 7]], kind) for k, kind in enumerate(kinds)], names=list("lbtsn")) for low in range(0, len(rows), 7)]
    got, want = Counter(), Counter()
    for part in divergence._products(50)(batches):
        for r in part.to_pylist():
            got[r["lang"], r["a"], r["an"], r["b"], r["bn"]] += r["terms"]
    terms = {}
    for lang, block, term, source, n in rows:
        terms.setdefault((lang, block, term), []).append((source, n))
    for (lang, _, _), cells in terms.items():
        cells.sort()
        for i, a in enumerate(cells):
            for b in cells[i:]:
                want[(lang, *a, *b)] += 1
    assert got == want


def test_probabilities_are_exact_for_small_and_enormous_counts(spark):
    from pyspark.sql import functions as F

    rows = [(n, total, kept) for n in (0, 1, 8_999_999_999, 9_000_000_000, 10**13) for total, kept in ((0, 0), (n, 1), (3 * n + 7, 12345))]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select("n", "total", "kept", divergence.smoothed("n", "total", "kept").alias("p"), divergence.smoothed(F.col("n"), "total", "kept").alias("q"))
    for r in got.collect():
        want = 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["kept"]) if r["total"] + r["kept"] else None
        assert r["p"] == r["q"] == want
