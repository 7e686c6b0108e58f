"""Near and exact duplicates: SimHash, suffixes, paragraphs."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from chronoframe.llm import resemblance, simhash, substring, suffixes
from chronoframe.llm.graph import components


def groups_of(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", " \t", "One", "one TWO", "Éa É b\x0bc\x1cd e", " ".join(rng.choices("abcdefg", k=500))]:
        assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)
    old, simhash.PIECE = simhash.PIECE, 50
    try:
        text = " ".join(f"w{rng.random()}" for _ in range(300))
        assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)
    finally:
        simhash.PIECE = old


@pytest.mark.parametrize("split", [200_000, 20])
def test_links_connect_what_is_near(spark, split):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres[:12]:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split=split)
    found = {r.node: r.root for r in components(links).collect()}
    want = groups_of(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert groups_of(len(signed), lambda i, j: found.get(signed[i], i) == found.get(signed[j], j)) == want


def test_dense_bucket_is_connected_without_all_pairs():
    rest = np.arange(1 << 12, dtype=np.uint64)
    member, lowest = simhash.bucket_links(np.zeros(len(rest), np.int64), rest, 39, 3)
    assert len(member) == len(rest) - 1 and set(lowest.tolist()) == {0}


def test_near_duplicates(spark):
    rows = [(5, "a b c d"), (3, "A b  c\nd"), (9, None), (8, ""), (1, "q w e r t"), (1, "q w e r t"), (None, "z y x"), (4, "x " * 40)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = groups_of(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    first = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in groups}
    assert got == sorted((str(i), f"{p:016x}", first[g]) for (i, _), p, g in zip(rows, prints, groups))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 1), (60, 1), (200, 2), (500, 3), (400, 200)):
        data = rng.integers(0, letters, size).astype(np.uint8)
        raw = data.tobytes()
        assert suffixes.suffix_order(data, 600).tolist() == sorted(range(size), key=lambda i: raw[i:])
    data = np.frombuffer(b"banana banana", np.uint8)
    words, order = suffixes.words_at(data, 32), suffixes.suffix_order(data, 32)
    raw = data.tobytes() + bytes(32)
    for k, n in enumerate(suffixes.adjacent_prefixes(order, words, 32)):
        a, b = raw[order[k] :][:32], raw[order[k + 1] :][:32]
        assert n == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), 32)


def plain_removed(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [40_000, 2])
def test_repeated_strings_go(spark, hot, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abé", k=4))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(shared)[rng.randint(0, 40) :], word()]) for _ in range(60)]
    texts += ["a" * 300, "ab" * 200, None, "", texts[0], texts[0], "short", "c" * 60]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, texts[1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    if hot == 2:
        sample = type(docs).sample
        monkeypatch.setattr(type(docs), "sample", lambda self, *a, **b: sample(self, 1.0))
    found = suffixes.deduplicate(docs, length=40, gram=8, hot=hot).collect()
    want = plain_removed([r[1] for r in rows], 40)
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in found) == sorted((str(i), w) for (i, _, _), w in zip(rows, want))
    assert all(r.text_bytes - sum(s.end - s.start for s in r.removed_spans) == len(r.kept) for r in found)
    assert suffixes.deduplicate(docs.limit(0), length=40, gram=8).count() == 0


def test_many_stretches_of_one_gram_are_judged_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    length, anchor = 40, b"ANCHORED"
    bodies = [bytes(rng.choices(b"xy", k=20)) + anchor + bytes(rng.choices(b"xy", k=25)) for _ in range(300)]
    counts = [len(b) - length + 1 for b in bodies]
    batch = pa.RecordBatch.from_pydict({"gram": [1] * 300, "dk": list(range(300)), "th": pa.array([0] * 300, pa.int32()), "packed": [(0 << 17) | (20 << 9) | (c << 1) for c in counts], "body": bodies})
    whole = [r for b in suffixes._settle(length)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 2000)
    parts = [r for b in suffixes._settle(length)(iter([batch])) for r in b.to_pylist()]
    assert whole == parts


def test_paragraphs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(80)) for i in range(20)]
    rows += [(30 + i, f"{prose(25)} {passage} {prose(15)}") for i in range(5)]
    rows += [(50, None), (51, ""), (52, "one two"), (53, rows[0][1]), (53, rows[0][1]), (54, f"{prose(200_000)} {passage}")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    for crowd in (500, 1):
        found = substring.repeated_paragraphs(docs, crowd=crowd).collect()
        assert {r.doc_id for r in found} == {30, 31, 32, 33, 34, 54, 0, 53}
        assert {r.component_id for r in found if r.doc_id in (0, 53)} == {0}
        # A passage's ends may be cut in some of the documents only; its middle is cut alike in all.
        assert {r.doc_id for r in found if r.component_id == 30} == {30, 31, 32, 33, 34, 54}
        assert all(r.removed == (r.doc_id not in (0, 30)) for r in found if r.component_id in (0, 30))
        texts = dict(rows)
        assert all(texts[r.doc_id].encode()[r.start : r.end].decode() in passage for r in found if r.doc_id in range(31, 35))
    assert substring.repeated_paragraphs(docs.limit(0)).count() == 0


def test_similar_paragraphs_are_linked_and_others_not(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    far = rng.sample(words, 60)
    sets = {1: frozenset(range(40)), 2: frozenset(range(4, 44)), 3: frozenset(range(20, 60)), 4: frozenset(range(8, 48))}
    rows = [(7, 0, k, sorted(v)) for k, v in sets.items()]
    frame = spark.createDataFrame(rows, "band long, part long, key long, shingles array<long>").coalesce(1)
    links = frame.mapInArrow(substring._verified(0.8), "a long, b long").collect()
    assert {frozenset((r.a, r.b)) for r in links} == {frozenset((1, 2)), frozenset((2, 4))} and far


def plain_jaccard(a, b):
    def shingles(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similar_documents_are_grouped_down_to_a_jaccard_of_four_fifths(spark):
    rng = random.Random(10)
    texts = []
    for n in (30, 64, 127, 248) * 6:
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
        texts.append(" ".join(words))
        for edits in (1, 1 + n // 100, 1 + n // 50, 1 + n // 20):
            for at in rng.sample(range(n), edits):
                words[at] = "edited" + str(rng.random())[2:]
            texts.append(" ".join(words))
    texts += ["one two", "One, two!", "two one", "?", "!", " ! ", "", "x y z v w " * 2000, "x y z v w " * 1999]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    alike = lambda i, j: plain_jaccard(texts[i], texts[j]) >= 0.8 if any(map(str.isalnum, texts[i])) and any(map(str.isalnum, texts[j])) else texts[i].strip() == texts[j].strip()
    groups = groups_of(len(texts), alike)
    assert sum(plain_jaccard(a, b) < 0.9 for i, a in enumerate(texts[:120]) for b in texts[:i] if plain_jaccard(a, b) >= 0.8) > 10
    first = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in groups}
    got = resemblance.similar_documents(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")).collect()
    want = [(i, first[g]) for (i, _), g in zip(rows, groups)] + [(None, first[groups[texts.index("")]])]
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, want))
    assert resemblance.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_similar_sets_of_a_band_are_connected():
    rng = random.Random(11)
    for size in (2, 40, 300):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(18, 30))), np.int64) for _ in range(size)]
        near = lambda i, j: (n := len(set(sets[i]) & set(sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)
        links = resemblance.similar(list(range(size)), sets, 0.8)
        assert all(near(i, j) for i, j in links) and len(links) == size - len(set(groups_of(size, near)))


def test_the_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(127)]
    edited = [w if k not in (30, 90) else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    assert plain_jaccard(" ".join(words), " ".join(edited)) >= 0.8
    assert [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()] == [1]


def test_the_pipeline_drops_what_simhash_links(spark):
    """Copies within three bits of each other, though more than a fifth of their five-word shingles differ; ids may be strings."""
    import corpus_pipeline

    rng = random.Random(14)
    while True:
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]
        at = set(rng.sample(range(0, 800, 20), 22))
        a, b = " ".join(words), " ".join("edited" if k in at else w for k, w in enumerate(words))
        if (simhash.fingerprint_of(a.encode()) ^ simhash.fingerprint_of(b.encode())).bit_count() <= 3:
            break
    assert plain_jaccard(a, b) < 0.8
    other = " ".join(reversed(words))
    for kind, ids in (("long", (3, 2, 1)), ("string", ("c", "b", "a"))):
        docs = spark.createDataFrame([(ids[0], a), (ids[1], b), (ids[1], b), (ids[2], other)], f"doc_id {kind}, text string")
        assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == sorted(ids[1:])


def test_copies_of_short_texts_are_reported(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    short = [prose(n) for n in range(5, 40) for _ in range(2)]
    alone = [prose(n) for n in range(1, 40) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(short)] + [(1000 + i, t) for i, t in enumerate(short)] + [(5000 + i, t) for i, t in enumerate(alone)]
    found = substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows if i < 5000}
    assert all(r.component_id == r.doc_id % 1000 and r.removed == (r.doc_id >= 1000) for r in found)
    texts = dict(rows)
    assert all((r.start, r.end) == (0, len(texts[r.doc_id])) for r in found if r.words < 20)
    assert len(found) == len({r.doc_id for r in found})


def test_texts_without_ids_are_told_apart_by_more_than_a_short_hash(spark):
    """Two different texts that agree in a 32-bit hash: what goes from one stays in the other."""
    from pyspark.sql import functions as F

    texts = spark.range(400_000).select(F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(6)]).alias("text"))
    pair = texts.groupBy(F.hash("text", F.lit(None).cast("long"))).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first().t
    docs = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, pair[0])], "doc_id long, text string")
    got = sorted((r.text, bytes(r.kept).decode()) for r in suffixes.deduplicate(docs).collect())
    assert got == sorted([(pair[0], ""), (pair[0], ""), (pair[1], pair[1])])


@pytest.mark.parametrize("few", [0, 10**9])
def test_both_ways_of_comparing_paragraphs_connect_the_same(few, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring, "FEW", few)
    rng = random.Random(12)
    for _ in range(20):
        centres = [rng.sample(range(200), 20) for _ in range(5)]
        sets = [sorted({*rng.sample(c, rng.randint(15, 20)), *rng.sample(range(200), rng.randint(0, 3))}) for c in centres for _ in range(8)]
        batch = pa.RecordBatch.from_arrays([pa.array([1] * 40), pa.array([0] * 40), pa.array(range(40)), pa.array(sets, pa.list_(pa.int64()))], names=["band", "part", "key", "shingles"])
        pairs = {(x["a"], x["b"]) for b in substring._verified(0.8)([batch]) for x in b.to_pylist()}
        near = lambda i, j: 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))
        assert all(near(a, b) for a, b in pairs)
        assert groups_of(40, lambda i, j: (i, j) in pairs or (j, i) in pairs) == groups_of(40, near)
