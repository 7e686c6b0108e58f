"""Toxic passages as maximum-scoring segments.

The tokens of a word are the word itself and its first 4, 6 and 8 bytes, so compounds
share what is known of their heads. Texts with a token are counted over the whole corpus and over toxic and clean labelled texts; the
log-odds of a word are estimated with a Dirichlet prior whose shape is the corpus itself
(Monroe et al., 2008). A word scores the best of its tokens' log-odds, each lowered by
``doubt`` standard errors, if that is above log 3; all other words share the rest of the
mass, so the scores are like log-likelihood ratios and their mean is negative on clean text. A linear scan (Ruzzo and Tompa, 1999) finds every maximal segment
of positive score. A segment's score is judged by extreme-value statistics (Karlin and
Altschul, 1990) whose constants are fitted on the best segments of clean labelled texts;
the segments of a text are combined by the sum statistic, and a logistic curve turns the
evidence into a probability.

Tokens are hashed into ``2**BITS`` places, so the tables sent to all tasks have a fixed
size; tokens that share a place share a score.

The prior weighs as much as the share ``prior`` of the labelled counts.

The classifier is fitted on at most ``max_labelled`` labelled rows, those with the smallest
hash of the id; the corpus counts cover all texts.

Defined cases: a null or empty text has no segment and gets the score of no evidence;
labels other than 0 and 1 are not used; an id labelled both ways counts as toxic; rows
without any label of one kind get the score 0.5. Repeated rows each count.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored
from chronoframe.llm.text import Words, text_buffer

BITS = 22  # a quarter for each kind of token
HEADS = (4, 6, 8)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, past the last, score), in linear time."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    right = total[places].tolist()
    left = (total[places] - scores[places]).tolist()
    found: list[list] = []  # first, past the last, sum before, sum at the end, the last earlier one with a smaller sum before
    for place, low, high in zip(places.tolist(), left, right):
        item = [place, place + 1, low, high, -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3], -1]
            before = found[j][4]
            del found[j:]
            j = before
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    """What scoring needs: log-odds of each place (0 where not toxic), and the calibration."""

    odds: np.ndarray
    rest: float = -1e-3
    decay: float = 1.0
    chance: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def of(self, places: np.ndarray) -> np.ndarray:
        """Scores of words; ``places`` has a row for each kind of token."""
        odds = self.odds[places].max(axis=0)
        return np.where(odds > 0, odds, np.float32(self.rest))

    def evidence(self, found: list[float], words: int) -> float:
        """-log of the smallest p-value over the sums of the best segments."""
        best, total = 0.0, 0.0
        base = math.log(self.chance * max(words, 1))
        for r, s in enumerate(sorted(found, reverse=True), 1):
            x = self.decay * s - base
            total += x
            if x <= 0 or total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def probability(self, evidence: float) -> float:
        x = self.slope * math.log1p(evidence) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _place(hashes: np.ndarray) -> np.ndarray:
    share = (1 << BITS) // len(hashes)
    return (hashes % np.uint64(share)).astype(np.int64) + share * np.arange(len(hashes))[:, None]


def _places(finder: Words, column: pa.Array):
    """(row, places of the tokens of its words) of each text."""
    data, offsets = text_buffer(column)
    for first, last, at, _, _, hashes in finder.groups(data, offsets):
        places = _place(hashes)
        for k in range(last - first):
            yield first + k, places[:, at[k] : at[k + 1]]


def _count(batches):
    finder, size = Words(HEADS), 1 << BITS
    schema = pa.schema([("place", pa.int32()), ("every", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts = np.zeros((3, size), np.int32)

    def flush():
        used = np.flatnonzero(counts[0])
        for low in range(0, len(used), 100_000):
            some = used[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c[some].astype(np.int64)) for c in counts]], schema=schema)
        counts[:] = 0

    words = 0
    for batch in batches:
        labels = batch.column(0).to_pylist()
        data, offsets = text_buffer(batch.column(1))
        for first, last, at, _, _, hashes in finder.groups(data, offsets):
            places = _place(hashes)
            for k in range(last - first):
                own = np.unique(places[:, at[k] : at[k + 1]])  # once for each text: a text that repeats itself weighs no more
                counts[0, own] += 1
                if (label := labels[first + k]) in (0, 1):
                    counts[1 if label else 2, own] += 1
            words += places.shape[1]
            if words > 1 << 29:  # long before a count is full
                yield from flush()
                words = 0
    yield from flush()


def token_odds(place: np.ndarray, counts: np.ndarray, totals: np.ndarray, prior: float, doubt: float) -> Model:
    """Lowered log-odds of toxic against clean by place; rows of ``counts`` and ``totals``: every text, toxic, clean."""
    prior = prior * (totals[1] + totals[2])
    alpha = prior * (counts[0] + 0.5) / (totals[0] + 0.5)
    odds = lambda y, n: np.log(y + alpha) - np.log(n + prior - y - alpha)
    delta = odds(counts[1], totals[1]) - odds(counts[2], totals[2])
    low = delta - doubt * np.sqrt(1 / (counts[1] + alpha + 1) + 1 / (counts[2] + alpha + 1))
    kept = low > math.log(3)
    kinds = 1 + len(HEADS)
    kind = place[kept] // ((1 << BITS) // kinds)
    taken, mass = (np.bincount(kind, y[kept], kinds).max() / n for y, n in ((counts[1], totals[1]), (counts[2], totals[2])))
    table = np.zeros(1 << BITS, np.float32)
    table[place[kept]] = low[kept]
    return Model(table, min(math.log((1 - min(taken, 0.5)) / (1 - min(mass, 0.49))), -1e-3))


def fit_extremes(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Decay and chance of P(best >= s) = 1 - exp(-chance * words * exp(-decay * s)) by maximum likelihood."""
    if len(best) < 20 or best.max() <= best.min():
        return 1.0, 1.0
    low, high = 1e-3, 50.0
    logs = np.log(np.maximum(words, 1))

    def slope(decay: float) -> float:
        w = logs - decay * best
        weight = np.exp(w - w.max())
        return 1 / decay - best.mean() + (weight * best).sum() / weight.sum()

    for _ in range(80):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    decay = (low * high) ** 0.5
    w = logs - decay * best
    return decay, float(len(best) / np.exp(w - w.max()).sum() / math.exp(w.max()))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, slightly regularised."""
    features = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - y) + np.array([1e-2, 1e-4]) * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", prior: float = 0.1, doubt: float = 2.0, max_labelled: int = 200_000) -> Model:
    """Fit on ``labels`` (all of them may train) and the texts of ``docs``."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = usable.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    known = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("__id"), "left")
    counted = known.select("label", F.lower(text)).mapInArrow(_count, "place int, every long, toxic long, clean long")
    by_place = stored(counted.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("every", "toxic", "clean")]), "tokens")
    totals = np.array([x or 0 for x in by_place.agg(*[F.sum(c) for c in ("every", "toxic", "clean")]).first()], float) / (1 + len(HEADS))
    if not totals[1] or not totals[2]:
        return Model(np.zeros(1 << BITS, np.float32))
    table = by_place.where("toxic > 1").toArrow()  # at most 2**BITS rows
    counts = np.stack([table.column(c).to_numpy().astype(float) for c in ("every", "toxic", "clean")])
    model = token_odds(table.column("place").to_numpy(), counts, totals, prior, doubt)
    fitted = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("__id")).select("label", F.lower(text)).mapInArrow(_passages(model), "label int, words long, scores array<double>").toArrow()  # a row for each of the sample
    truth, words = fitted.column("label").to_numpy().astype(float), fitted.column("words").to_numpy()
    found = fitted.column("scores").to_pylist()
    best = np.array([max(s, default=0.0) for s in found])
    some = (truth == 0) & (best > 0)
    model.decay, model.chance = fit_extremes(best[some], words[some])
    evidence = np.log1p([model.evidence(s, int(n)) for s, n in zip(found, words)])
    model.slope, model.offset = fit_curve(evidence, truth)
    return model


def _passages(model: Model):
    def run(batches):
        finder = Words(HEADS)
        for batch in batches:
            words, scores = [], []
            for _, places in _places(finder, batch.column(1)):
                words.append(places.shape[1])
                scores.append([s for _, _, s in segments(model.of(places))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["label", "words", "scores"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``passages``: (first word, past the last word, score) of each significant segment.

    A segment is significant when it beats the expected best of its text's length.
    Existing columns of these names are replaced; all others are kept.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name not in ("score", "passages")]
    # Of fixed size; as bytes by value, for a broadcast refers to classes by name, which executors may lack.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        model, finder = pickle.loads(shared.value), Words(HEADS)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            values, passages = [], []
            for _, places in _places(finder, batch.column(0)):
                found = segments(model.of(places))
                base = math.log(model.chance * max(places.shape[1], 1))
                values.append(model.probability(model.evidence([s for _, _, s in found], places.shape[1])))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found if model.decay * s > base])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.float64()), pa.array(passages, kind)], names=[*batch.schema.names[1:], "score", "passages"])

    passage = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("score", DoubleType())])
    out = StructType([*kept, StructField("score", DoubleType()), StructField("passages", ArrayType(passage))])
    return docs.select(F.lower(text).alias("__text"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, out)
