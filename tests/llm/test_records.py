"""Archives, packing, search, decontamination, tokenizer, pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import bpe, contamination, packing, queries, topk, warc

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n</p>" * 5
    rows = [(4, "http://a/x?y=1#z", body), (2, "http://a/", body), (2, "http://a/", body), (7, None, None), (8, "x\r\ny", ""), (9, "http://b", "short"), (10, "http://b", "short"), (None, "http://c/", body), (11, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.transactions(warc.read(spark, warc.write(pages, str(tmp_path / "a")))).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    found = sorted((r.metadata.fields.get("page-id") or "", r.response.type, r.response.refers_to_page or "", bytes(r.response.payload).decode()) for r in got)
    assert found == sorted([
        ("4", "revisit", "2", ""), ("2", "response", "", body), ("2", "response", "", body), ("", "revisit", "2", ""), ("7", "response", "", ""),
        ("8", "response", "", ""), ("9", "response", "", "short"), ("10", "response", "", "short"), ("11", "response", "", "z" * 3_000_000),
    ])
    for r in got:
        if r.response.type == "response":
            assert r.response.stated_digest == r.response.payload_digest == hashlib.sha256(bytes(r.response.payload)).hexdigest()
    assert warc.read(spark, warc.write(pages.limit(0), str(tmp_path / "b"))).count() == 0


def test_requests_without_response_are_left_out(spark, tmp_path):
    records = warc.read(spark, warc.write(spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string"), str(tmp_path / "a")))
    only = warc.transactions(records.where("type <> 'metadata'")).collect()
    assert len(only) == 1 and only[0].request and only[0].metadata is None
    assert warc.transactions(records.where("type = 'request'")).count() == 0


def test_best_fit_takes_the_least_room():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(80)]
        rooms, plain = [], []
        for i in sorted(range(80), key=lambda i: -sizes[i]):
            fit = min((r for r in rooms if r >= sizes[i]), default=None)
            rooms += [50 - sizes[i]] if fit is None else [fit - sizes[i]]
            if fit is not None:
                rooms.remove(fit)
            plain.append(fit is None)
        rows = packing.best_fit(sizes, 50)
        assert len(rows) == sum(plain) and sorted(i for r in rows for i in r) == list(range(80))
        assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_is_lossless(spark):
    import tiktoken

    ranks = queries.vocabulary_file("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "cde", "it's", "über", "  ", "12"], k=rng.randint(1, 300))) for _ in range(40)] + [None, "", "x", "word " * 30_000]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "null id")], "doc_id long, text string").withColumn("ids", F.lit(1)).coalesce(2)
    got, rows = {}, packing.pack(docs, ranks, public.PATTERN, length=64, shard_tokens=5000).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1]
        assert packing.positions(r.resets, r.n_tokens, 64).tolist() == [i - a for a, b in zip(r.resets, r.cu_seqlens[1:]) for i in range(a, b)] + [0] * (64 - r.n_tokens)
        for doc, offset, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            got.setdefault((doc, offset), []).append(ids[a:b].tolist())
    for doc, text in [*enumerate(texts), (None, "null id")]:
        want = plain.encode_ordinary(text) + [packing.END_ID] if text else []
        parts = [want[k : k + 64] for k in range(0, len(want), 64)]
        assert [got.pop((doc, 64 * k)) for k in range(len(parts))] == [[p] * (2 if doc == 0 else 1) for p in parts]
    assert not got and packing.pack(docs.limit(0), ranks, public.PATTERN).count() == 0


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    import tiktoken

    ranks = queries.vocabulary_file("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    text = " ".join(random.Random(3).choices(["ab", "it's  x", "1 2", "\n", "é!", "z"], k=2000))
    monkeypatch.setattr(packing, "CHARS", 50)
    assert packing.tokens_of(plain, text).tolist() == plain.encode_ordinary(text)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_top_k(spark, parts, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 30)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5]) for _ in range(rng.choice([4, 5]))]) for i in range(120)]
    rows += [(300, []), (0, [0.5] * 5), (0, rows[0][1]), (7, rows[7][1])]  # ids may repeat
    usable = list(rows)
    rows += [(200, None), (210, [1.0, None]), (220, [float("nan")]), (None, [1.0]), (230, [float("inf")]), (240, [1.0, -1e30]), (250, [16384.0])]
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in usable]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, row int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, F.col("id") % 10 == 0, parts=parts).collect())
    want = []
    for place, (q, v) in enumerate(ints):
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), x) for other, (x, w) in enumerate(ints) if other != place)[:10]
            want += [(q, k, x, -s) for k, (s, x) in enumerate(scores, 1)]
    assert got == sorted(want)
    few = topk.search(frame.where("vec_id between 1 and 3"), F.col("id") == 1, parts=parts).collect()
    assert len(few) == 2 and topk.search(frame.limit(0), F.col("id") == 0).count() == 0


def test_top_k_shuffles_vectors_once_in_each_layout(spark, monkeypatch):
    """Rows of the blocks are exchanged once by part and once in full; pairs carry no vector."""
    kept, store = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, name: kept.append(name) or store(df, name))
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "vec_id long, embedding array<float>")
    found = topk.search(frame, F.col("id") % 10 == 0)
    assert found.count() == 200 and len(found.collect()) == 200
    plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert kept == ["vectors"]
    assert plan.count("ReusedExchange") == 2
    assert "zip_with" not in plan


@pytest.mark.parametrize("size", [0.2, 100.0, 16000.0])
def test_top_k_is_exact_in_each_number_type(spark, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size) for _ in range(48)]) for i in range(150)]
    ints = np.array([[int(np.floor(1024 * x)) for x in v] for _, v in rows])
    assert topk.exact(ints, ints)[0].dtype == {0.2: np.float32, 100.0: np.float64, 16000.0: np.int64}[size]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).collect())
    want = []
    for q in range(0, 150, 10):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(ints[q], ints[x])), x) for x in range(150) if x != q)[:10]
        want += [(q, k, x, -s) for k, (s, x) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_top_k_of_equal_vectors_takes_the_smallest_ids(spark, monkeypatch):
    """Every pair ties, so every entry is sent, over several blocks and pieces."""
    for name, few in (("VECTORS", 40), ("QUERIES", 3), ("SCORES", 100), ("PAIRS", 7), ("TASKS", 5)):
        monkeypatch.setattr(topk, name, few)
    frame = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(150)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, F.col("id") % 10 == 0).collect())
    assert got == [(q, k, x, 512**2 + 256**2) for q in range(0, 150, 10) for k, x in enumerate([x for x in range(11) if x != q][:10], 1)]


def test_contamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = {i: " ".join(word() for _ in range(n)) for i, n in enumerate([5, 6, 9, 14, 30, 60, 200, 3])}
    docs = {i: " ".join(word() for _ in range(rng.randint(0, 300))) for i in range(60)}
    for i in range(0, 60, 2):
        piece = items[i % 8].split()
        start = rng.randint(0, len(piece) // 4)
        docs[i] = f"{docs[i]} {' '.join(piece[start:])}. {docs[i + 1]}"
    docs[70] = ", ".join(items[i].upper() for i in items)
    docs[71] = " ".join(items[5].split()[:30]) + " gap " + " ".join(items[5].split()[30:])
    docs[72], docs[73], docs[74] = None, "", f"{'x ' * 600_000} {items[4]}"
    rows = [*docs.items(), (70, docs[70]), (None, items[4])]

    def shingles(text):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    want = set()
    for d, text in rows:
        own = shingles(text)
        for i, item in items.items():
            s = shingles(item)
            if s and len(s & own) >= 0.8 * len(s):
                want.add((d, i, len(s & own), len(s)))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()] + [(0, items[0], "y"), (90, None, "x"), (91, "", "x")], "item_id long, text string, doc_id string")
    for most in (64, 0):
        got = contamination.find(frame, bench, max_bands=most).collect()
        assert sorted(map(str, {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got})) == sorted(map(str, want)) and len(got) == len(want)
    kept = contamination.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(docs) - {d for d, *_ in want}
    assert contamination.find(frame.limit(0), bench).count() == 0 and contamination.decontaminate(frame, bench.limit(0)).count() == len(rows)


TEXTS = [
    "Hello <|endoftext|>World<|startoftext|>x <|ENDOFTEXT|> <|endoftext", "ΣΑΣ ΟΔΟΣ", "don't 'start ''s it'S we'LL", "áÉᲉ\U00010d50\U00011de0x 12³ ½", "日本語 テスト がが",
    "x" * 300 + "ab" * 200, "\x85\x1c nbsp\xa0x​﻿", "👍🏽é é é\r\n\t", "", " ", "the the theory", "İstanbul ǅ",
]


def test_bpe_is_the_librarys(spark):
    file = queries.vocabulary_file()
    library = tokenizers.Tokenizer.from_str(file.decode())
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choices("abcdeé 'st1.", k=200)) for _ in range(40)] + ["the cat " * 200_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(90, None, "x"), (0, texts[0], "x")], "doc_id long, text string, ids string")
    name = bpe.build_lexicon(docs, file, lexicon_words=50)
    got = bpe.decode(bpe.encode(docs, file, name), file).collect()
    assert len(got) == len(texts) + 2 and got[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    empty = bpe.build_lexicon(docs.limit(0), file)
    assert bpe.encode(docs.limit(0), file, empty).count() == 0
    odd = bpe.decode(spark.createDataFrame([([-1, 10**6, 320],), (None,)], "ids array<int>"), file).collect()
    assert [r.decoded for r in odd] == [library.decode([320], skip_special_tokens=False), ""]


def test_lexicon(tmp_path):
    rng = random.Random(7)
    words = sorted({bytes(rng.choices(b"abc\xc3", k=rng.randint(1, 7))) for _ in range(500)})
    ids = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in words}
    (tmp_path / "l").write_bytes(bpe.compile_lexicon([(w, ids[w]) for w in words]))
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    assert all(lexicon.find(w) == ids[w] for w in words)
    assert all(lexicon.find(w) is None for w in (w + b"z" for w in words)) and lexicon.find(b"") is None
    # Words that end alike share their states: as few as there are different sets of endings.
    endings = {frozenset(w[k:] for w in words if w[:k] == p) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(lexicon.final) == len(endings)


def test_both_ways_of_merging_agree():
    vocabulary, rng = bpe.Vocabulary(queries.vocabulary_file()), random.Random(8)
    for _ in range(300):
        word = bytes(rng.choices(b"theinganorx", k=rng.randint(1, 40)))
        ids = [vocabulary.inner[b] for b in word[:-1]] + [vocabulary.final[word[-1]]]
        assert vocabulary._merge_short(list(ids)) == vocabulary._merge_long(list(ids))


def test_new_words_are_merged_together(tmp_path, monkeypatch):
    """Words that a slice brings anew take no merge of their own, and those of the lexicon outlast the others."""
    file, rng = queries.vocabulary_file(), random.Random(9)
    vocabulary, library = bpe.Vocabulary(file), tokenizers.Tokenizer.from_str(file.decode())
    words = ["".join(rng.choices("theinganorxé漢'", k=rng.choice([1, 2, 3, 8, 9, 16, 17, 32, 33, 100]))).encode()[:100] for _ in range(3000)]
    words += [b"x", b"a" * 101, b"ab" * 5000]
    ids, counts = vocabulary.merge_all(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [vocabulary.merge(w) for w in words]
    assert [x.tolist() for x in vocabulary.merge_all([])] == [[], []]

    frequent = sorted({b"the", b"cat", "für".encode()})
    (tmp_path / "l").write_bytes(bpe.compile_lexicon([(w, vocabulary.merge(w)) for w in frequent]))
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, word: pytest.fail("merged by itself"))
    encoder = bpe.Encoder(vocabulary, bpe.Lexicon(str(tmp_path / "l")))
    for _ in range(5):
        texts = ["the cat <|endoftext|> für " + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(3)] + [None, "", "the"]
        ids, ends = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder.forget()
    assert sorted(w.encode() for w in encoder.number) == frequent
    plain = bpe.Encoder(vocabulary, None)
    assert plain.encode(["the cat"])[0].tolist() == library.encode("the cat", add_special_tokens=False).ids


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda n, letters="abcdefgh": " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    item, passage = prose(30), prose(60)
    rows = [(i, prose(60), "en", "s", 0) for i in range(10)]
    rows += [(20, rows[3][1], "en", "s", 0), (20, rows[3][1], "en", "s", 0), (21, f"{prose(20)} {passage} {prose(20)}", "en", "s", 0), (22, f"{prose(20)} {passage} {prose(20)}", None, "s", 0)]
    rows += [(30, f"{prose(40)} {item} {prose(9)}", "en", "s", 0), (40, None, None, None, None), (41, "", "en", "s", 0), (42, "12 34", "en", "s", 0), (None, prose(50), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, extra string"
    spark.createDataFrame([(*r, "x") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
        assert name == "BPE encoding and decoding" or docs.columns == columns
        if name == "suffix-array dedup":
            texts = {r.doc_id: r for r in docs.collect()}
            assert passage[30:-30] not in texts[21].text and passage[30:-30] not in texts[22].text and texts[1].text == rows[1][1] and texts[21].n_chars == len(texts[21].text)
    all_ids = [str(r[0]) for r in rows]
    first = sorted(set(all_ids) - {"40", "41", "42"})
    second = sorted(set(first) - {"20"})
    assert kept == [sorted([*first, "20"]), second, second, sorted(set(second) - {"30"}), sorted(set(second) - {"30"})]


def test_pipeline_hands_texts_over_in_small_batches(spark, monkeypatch):
    """A partition of 20 MB of texts; a size that the session names is kept."""
    import corpus_pipeline
    from chronoframe.llm import language

    def small(batch, size, most=6 << 20, slices=language.slices):
        assert batch.nbytes <= most, batch.nbytes
        return slices(batch, size)

    monkeypatch.setattr(language, "slices", small)
    before = spark.conf.get(corpus_pipeline.BATCH_BYTES, None)
    try:
        spark.conf.unset(corpus_pipeline.BATCH_BYTES)
        docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 900).alias("text"), F.lit("en").alias("lang"))
        assert corpus_pipeline.known_language(spark, docs, "").select("text").distinct().count() == 1
        spark.conf.set(corpus_pipeline.BATCH_BYTES, "5m")
        corpus_pipeline.known_language(spark, docs.limit(1), "")
        assert spark.conf.get(corpus_pipeline.BATCH_BYTES) == "5m"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BYTES, before) if before else spark.conf.unset(corpus_pipeline.BATCH_BYTES)


def test_pipeline_encodes_and_decodes_in_tasks_of_their_own(spark):
    """One Python worker for each task; the ids are stored in between."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    made = corpus_pipeline.token_ids(spark, docs, "")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.n_tokens == len(r.ids) for r in made.collect()} == {1: True, 2: True}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pipeline_carries_columns_of_any_name(spark, tmp_path, kind):
    import corpus_pipeline

    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = prose(60)
    texts = [prose(50), f"{prose(20)} {passage}", f"{prose(20)} {passage} {prose(5)}", prose(50)]
    names = ["dk", "th", "spans", "kept", "__dk", "__th", "a.b", "removed_spans", "text_bytes", "carried", "lang_pred", "score", "row", "__row", "key", "component_id", "own_dk"]
    rows = [(k if kind == "long" else f"id{k}", t, "en", *[f"{n}-{k}" for n in names]) for k, t in enumerate([*texts, texts[0]])] + [(None, prose(30), "en", *names)]
    schema = f"doc_id {kind}, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(0, prose(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    carried = {r[0]: r[3:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", *names]
        assert all(tuple(r)[3:] == carried[r.doc_id] for r in docs.collect())
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([r[0] for r in rows if r[0] not in (4, "id4")], key=str)
    assert all(passage[30:-30] not in r.text for r in docs.collect())


def test_operators_run_where_tasks_lack_the_package(tmp_path):
    """Tasks get code by value: the driver alone has the repository on its path."""
    import os
    import subprocess
    import sys
    import textwrap

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
        import sys
        sys.path.insert(0, {repo!r})
        import random
        from chronoframe.session import local_session
        from chronoframe.llm import queries
        spark = local_session("2", "bare", **{{"spark.checkpoint.dir": "shared", "spark.sql.shuffle.partitions": "2"}})
        def lacking(batches):
            import importlib.util
            for b in batches:
                assert importlib.util.find_spec("chronoframe") is None
                yield b
        spark.range(1).mapInArrow(lacking, "id long").collect()
        rng = random.Random(1)
        text = lambda: " ".join(rng.choices(["the", "very", "bad", "word", "of", "no", "use"], k=40))
        spark.createDataFrame([(k, text() + (" bad" * (k % 2)), "en", f"s{k % 2}") for k in range(60)], "doc_id long, text string, lang string, source string").write.parquet("documents.parquet")
        spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int").write.parquet("labels.parquet")
        spark.createDataFrame([(k, t, "user", text()) for k in range(5) for t in range(3)], "conv_id long, turn long, role string, text string").write.parquet("conversations.parquet")
        for name in ("op2_toxic_passages", "op7_language_id", "op11_conversation_repair", "op12_source_divergence", "op13_ngram_jaccard_join"):
            assert queries.QUERIES[name](spark, ".").count() > 0, name
        print("all ran")
    """
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_latin_letters_are_split_as_by_the_pattern():
    """The quick way for Latin texts, over every code point that it takes and those around it."""
    import unicodedata

    vocabulary = bpe.Vocabulary(queries.vocabulary_file())
    for c in map(chr, range(0x20, 0x260)):
        for text in (c, f"a{c}B", f"1{c}.", f"{c}'s {c}{c}", f"É{c}é'll"):
            plain = vocabulary.pattern.findall(unicodedata.normalize("NFC", text).lower())
            assert vocabulary.words(text) == plain, text
    rng = random.Random(11)
    for _ in range(500):
        text = "".join(rng.choices("aé ÑZ'.s1²½ \x1c\x85-_İẞ́漢", k=20))
        assert vocabulary.words(text) == vocabulary.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
