"""Similarity join over word n-grams against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.llm import ngramjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def plain(texts, percent, size=3):
    sets = [plain_set(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(rng, families, members, long=60):
    """Families of texts with a few changed words each, with and without the text that they come from."""
    texts = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 9, 10, 12, 20, long, 3 * long]))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 5)}"
            texts.append(" ".join(words) + rng.choice(["", " ", " The end of all lines."]))
    return texts


@pytest.mark.parametrize(("percent", "options"), [(90, {}), (90, {"rare": 2, "common": 5, "cap": 7, "crowd": 3}), (70, {"rare": 1, "common": 3})])
def test_components_are_those_of_all_pairs(spark, percent, options):
    rng = random.Random(percent)
    texts = corpus(rng, 12, 12)
    texts += ["", None, " \t\n", "one", "ONE", "one two", "One\x0btwo", "É é", "é é", "a b c d e", "a b c d e", *["same text in many rows here"] * 5, "w " * 3000, "w " * 2000]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int")
    got = ngramjoin.similar_documents(docs, percent=percent, **options).collect()
    assert sorted(tuple(r) for r in got) == plain(texts, percent)


def test_ids_may_be_null_or_repeat(spark):
    rows = [(None, "a b c d"), (5, "A b c d"), (None, "x y z"), (None, "x y z"), (5, "a b c d"), (3, None), (3, ""), (None, "")]
    got = ngramjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 1, None), (None, 1, None), (3, 0, 3), (3, 0, 3), (None, 0, None)], key=repr
    )
    assert ngramjoin.similar_documents(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(9, 400))
        universe = rng.integers(1, 1 << 62, n * 2).astype(np.uint64)
        sets = rng.choice([1, 2, 10, 17, 500, 5000, 9000], n * 2)
        change = int(rng.integers(0, max(1, n // 19) + 1))
        one, two = np.arange(n), np.arange(change, n + int(rng.integers(0, change + 1)))
        both = len(np.intersect1d(one, two))
        if 100 * both < 90 * (len(one) + len(two) - both):
            continue
        # What both have is in two sets at least.
        sets = np.where(np.isin(np.arange(n * 2), np.intersect1d(one, two)) & (sets == 1), 2, sets)
        found = [ngramjoin.signatures(len(x), sets[x][sets[x] > 1], universe[x][sets[x] > 1]) for x in (one, two)]
        assert len(np.intersect1d(*found)), (n, change)


def test_combinations_do_not_follow_the_length_of_a_text():
    rng = np.random.default_rng(2)
    for n in (100, 1000, 20_000):
        for sets in (100, 10_000):
            made = ngramjoin.signatures(n, np.full(n, sets), rng.integers(1, 1 << 62, n).astype(np.uint64))
            assert 0 < len(made) < 6 * n


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        bits = int(np.bitwise_count(ngramjoin.sketch(a) ^ ngramjoin.sketch(b)).sum())
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("cap", [1, 2, 3, 100])
def test_tokens_are_counted_over_any_batches(cap):
    rng = random.Random(cap)
    for _ in range(100):
        rows = sorted((rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), rng.randint(0, 8)) for _ in range(rng.randint(0, 40)))
        batches, at = [], 0
        while at < len(rows):
            step = rng.randint(1, 6)
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + step]]) for k in (0, 1)], names=["token", "key"]))
            at += step
        got = sorted(tuple(r.values()) for b in ngramjoin._shared(max(cap, 2))(batches) for r in b.to_pylist())
        pairs = set(rows)
        size = {t: len([1 for x, _ in pairs if x == t]) for t, _ in pairs}
        assert got == sorted((k, t, min(size[t], max(cap, 2))) for t, k in pairs if size[t] > 1)


def test_words_of_any_length(monkeypatch):
    from chronoframe.llm import text as texts

    texts_ = ["ab " + "x" * 500 + " cd ef", "ab " + "x" * 501 + " cd ef", "y" * 300, "a b"]
    def keys(list_):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(list_))), pa.array(list_)], names=["doc_id", "text"])
        return [(r["key"], r["n"]) for b in ngramjoin._marks(3)([batch]) for r in b.to_pylist()]

    monkeypatch.setattr(texts, "PIECE", 64)
    got = keys(texts_)
    assert [n for _, n in got] == [2, 2, 1, 1] and len({k for k, _ in got}) == 4
    assert got == keys(texts_[:1]) + keys(texts_[1:2]) + keys(texts_[2:])
