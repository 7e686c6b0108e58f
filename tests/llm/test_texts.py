"""Words, languages and toxic passages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoframe.llm import language, toxicity
from chronoframe.llm.text import Words, shingle_hashes, text_buffer


def hashes_of(texts, finder=None):
    finder, out = finder or Words(), []
    for first, last, at, starts, ends, hashes in finder.groups(*text_buffer(pa.array(texts, pa.string()))):
        out += [hashes[..., at[k] : at[k + 1]] for k in range(last - first)]
    return out


def test_words_do_not_depend_on_where_a_text_stands():
    texts = ["one two", None, "", "two,one", "x" * 70, "onetwo one", "é ü-ß 12"]
    together = hashes_of(texts)
    for text, found in zip(texts, together):
        assert np.array_equal(hashes_of([text])[0], found)
    assert [len(x) for x in together] == [2, 0, 0, 2, 1, 2, 4]
    assert together[0][0] == together[3][1] and together[0][1] == together[3][0]


def test_a_text_longer_than_a_piece_is_read_whole():
    words = [f"w{i}" for i in range(400_000)]
    (long,) = hashes_of([" ".join(words)])
    assert len(long) == 400_000 and len(np.unique(long)) == 400_000
    assert np.array_equal(long[399_990:], hashes_of([" ".join(words[399_990:])])[0])
    assert len(shingle_hashes(long[:4], 5)) == 0


def test_heads_of_words_are_shared():
    (found,) = hashes_of(["playing player play"], Words((4,)))
    assert found.shape == (2, 3) and len(set(found[0])) == 3 and len(set(found[1])) == 1


LETTERS = {"xx": "abcde", "yy": "fghij"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 6))) for _ in range(n))


def test_languages(spark):
    rows = [(i, prose(lang, 30, i), lang, "clash") for i, lang in enumerate(["xx", "yy"] * 10)]
    rows += [(90, None, "xx", "a"), (91, "", "yy", "b"), (92, "12 !?", None, "c"), (93, "abc " * 400_000, None, "d"), (0, rows[0][1], "xx", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    names, prototypes = language.learn(docs)
    assert names == ["xx", "yy"]
    found = {r.doc_id: r for r in language.identify(docs, names, prototypes).collect()}
    assert len(found) == len(rows) - 1 and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == found[i].lang for i in range(20)) and found[93].lang_pred == "xx"
    assert {found[i].lang_pred for i in (90, 91, 92)} == {"und"}
    names, prototypes = language.learn(docs.limit(0))
    assert names == [] and {r.lang_pred for r in language.identify(docs, names, prototypes).collect()} == {"und"}


def test_bundle_in_pieces_equals_one_sum():
    grams = language.LetterGrams(3, 128)
    text = prose("xx", 3000, 1) + " äöü日本"
    owner, which, rows, _ = grams.count([text])
    whole = grams.bundle(owner, which, rows, None, 1)
    plain = sum(grams.vectors(rows)[which])
    assert np.allclose(whole[0], plain)


def brute_segments(s):
    """Maximal segments by the recursive definition."""
    if not len(s):
        return []
    total = np.concatenate(([0], np.cumsum(s)))
    best = max(((total[b] - total[a], -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    if best[0] <= 1e-9:
        return []
    a, b = best[3], best[4]
    return sorted(brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])])


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.choice([3.0, 1.5, -1.0, -2.0], 14) + rng.random(14) * 1e-3
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"wo{i}rd" for i in range(300)]

    def text(toxic):
        out = rng.choices(words, k=80)
        for _ in range(6 * toxic):
            out[rng.randrange(20, 50)] = rng.choice(["scoundrel", "rascal", "villain"])
        return " ".join(out)

    rows = [(i, text(i % 4 == 0), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (902, "wo1rd " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 403 and all(0 <= r.score <= 1 for r in found.values())
    right = sum((found[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert right >= 97
    assert found[900].score == found[901].score < 0.5 and found[300].passages
    assert 20 <= found[300].passages[0].first and found[300].passages[0].last <= 50
    empty = toxicity.learn(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
