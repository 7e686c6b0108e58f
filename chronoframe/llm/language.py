"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, kept as bits and derived from its
code point. A letter n-gram is the product (XOR of bits) of its letters' vectors,
each permuted by a cyclic shift that depends on its place. A text's profile is
the sum of its n-gram vectors, a language's prototype the mean of the profiles of
its training texts. A text gets the language whose prototype has the largest
cosine with its profile, both taken relative to the mean of the prototypes.

Everything a task emits in training is a partial sum of fixed size per language;
prototypes are the only thing sent to all tasks: ``max_languages`` vectors at most.

Defined cases: a null, empty or letterless text is ``und`` with score 0; rows with
a null text, a null language or no letter do not train; repeated rows each count;
equal cosines go to the language first in order of its name; without any training
row every text is ``und``. Texts are read whole, long ones in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.text import slices

GRAM = 3
DIMENSIONS = 512
UNKNOWN = "und"
CHARS = 1 << 19
BLOCK = 8192


class LetterGrams:
    """Turns texts into sparse n-gram counts, and n-grams into hypervectors."""

    def __init__(self, gram: int, dimensions: int) -> None:
        self.gram, self.words = gram, dimensions // 64
        self.letters: dict[int, bool] = {}

    def is_letter(self, codes: np.ndarray) -> np.ndarray:
        present = np.flatnonzero(np.bincount(codes, minlength=1))
        table = np.zeros(int(codes.max(initial=0)) + 1, bool)
        for c in present.tolist():
            if c not in self.letters:
                self.letters[c] = chr(c).isalpha()
            table[c] = self.letters[c]
        return table[codes]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram number) of each n-gram; the n-grams as rows of code points; letters per text."""
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        letter = self.is_letter(codes)
        letters = np.bincount(owner[letter], minlength=len(texts))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one break after each word
        keep[0] = True
        codes, owner = np.where(letter, codes, 0)[keep], owner[keep]
        n = max(0, len(codes) - self.gram + 1)
        symbols = np.flatnonzero(np.bincount(codes, minlength=1))
        number = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
        number[symbols] = np.arange(len(symbols))
        dense, base = number[codes], len(symbols)
        value = np.zeros(n, np.int64)
        for k in range(self.gram):
            value = value * base + dense[k : k + n]
        same = owner[:n] == owner[self.gram - 1 : self.gram - 1 + n]
        value, owner = value[same], owner[:n][same]
        if base**self.gram <= 1 << 22:
            seen = np.flatnonzero(np.bincount(value, minlength=1))
            lookup = np.zeros(int(seen.max(initial=0)) + 1, np.int64)
            lookup[seen] = np.arange(len(seen))
            which = lookup[value]
        else:
            seen, which = np.unique(value, return_inverse=True)
        parts = [symbols[seen // base ** (self.gram - 1 - k) % base] for k in range(self.gram)]
        return owner, which, np.stack(parts, axis=1), letters

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 for each n-gram."""
        lanes = np.arange(1, self.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.zeros((len(grams), self.words), np.uint64)
        for k in range(self.gram):
            h = (grams[:, k].astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0xBF58476D1CE4E5B9) + lanes
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits ^= np.roll(h ^ (h >> np.uint64(31)), self.gram - 1 - k, axis=1)
        return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * np.float32(2) - np.float32(1)

    def bundle(self, rows: np.ndarray, which: np.ndarray, grams: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
        """Sums of n-gram vectors for ``n`` rows, a block of n-grams at a time."""
        out = np.zeros((n, self.words * 64), np.float32)
        order = np.argsort(which, kind="stable") if len(grams) > BLOCK else np.arange(len(which))
        rows, which = rows[order], which[order]
        weight = weight[order] if weight is not None else None
        for low in range(0, len(grams), BLOCK):
            a, b = (np.searchsorted(which, (low, low + BLOCK)) if len(grams) > BLOCK else (0, len(which)))
            size = min(BLOCK, len(grams) - low)
            cells = rows[a:b].astype(np.int64) * size + which[a:b] - low
            counts = np.bincount(cells, None if weight is None else weight[a:b], n * size).reshape(n, size)
            out += counts.astype(np.float32) @ self.vectors(grams[low : low + size])
        return out


def text_pieces(texts: list[str | None], rows: int = 256):
    """Lists of (text number, piece) of bounded size."""
    out, size = [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), CHARS):
            part = text[max(0, at - GRAM + 1) : at + CHARS]
            out.append((i, part))
            size += len(part)
            if size >= CHARS or len(out) >= rows:
                yield out
                out, size = [], 0
    if out:
        yield out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, gram: int = GRAM, dimensions: int = DIMENSIONS, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and their prototypes as rows of unit length.

    Every training text has the same weight, whatever its length. More than
    ``max_languages`` different labels are an error: labels are not languages then.
    """
    train = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if where is not None:
        train = train.where(where)
    schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))])

    def partial(batches):
        grams = LetterGrams(gram, dimensions)
        for batch in (part for whole in batches for part in slices(whole, 1 << 23)):
            names = batch.column(1).to_pylist()
            known = sorted(set(names))
            number = {name: k for k, name in enumerate(known)}
            sums = np.zeros((len(known), dimensions))
            for pieces in text_pieces(batch.column(0).to_pylist()):
                owner, which, rows, letters = grams.count([p for _, p in pieces])
                per_text = np.bincount(owner, minlength=len(pieces))
                weight = np.where(letters > 0, 1.0 / np.maximum(per_text, 1), 0.0)
                langs = np.array([number[names[i]] for i, _ in pieces])
                sums += grams.bundle(langs[owner], which, rows, weight[owner], len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()), pa.array(sums.tolist(), schema.field(1).type)], schema=schema)

    parts = train.select(F.lower(text).alias("t"), F.col(lang).alias("l")).mapInArrow(partial, "lang string, sums array<double>")
    total = (
        parts.select("lang", F.posexplode("sums").alias("place", "value"))
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
        .select("lang", "v.value").orderBy("lang").limit(max_languages + 1)
    )
    found = total.collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} different values in {lang}")
    vectors = np.array([r["value"] for r in found]).reshape(len(found), dimensions)
    sizes = np.linalg.norm(vectors, axis=1)
    usable = sizes > 0
    return [r["lang"] for r, ok in zip(found, usable) if ok], vectors[usable] / sizes[usable, None]


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", predicted: str = "lang_pred", score: str = "score", gram: int = GRAM, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with the language of each text and (1 + cosine) / 2 as its score.

    Existing columns of those two names are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (predicted, score)]
    centre = prototypes.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    relative = prototypes - centre
    relative = (relative / np.maximum(np.linalg.norm(relative, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    centre = centre.astype(np.float32)

    def predict(batches):
        grams = LetterGrams(gram, dimensions)
        for batch in (part for whole in batches for part in slices(whole, 1 << 22)):
            lowered = batch.column(0).to_pylist()
            best, value = np.full(len(lowered), -1), np.zeros(len(lowered))
            for pieces in joined_pieces(lowered, grams, dimensions):
                ids, vectors, letters = pieces
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                moved = vectors / np.maximum(size, 1e-12) - centre
                cosines = moved @ relative.T / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
                if len(names):
                    ok = letters > 0
                    best[ids[ok]] = cosines.argmax(axis=1)[ok]
                    value[ids[ok]] = np.clip((1 + cosines.max(axis=1)) / 2, 0, 1)[ok]
            named = [names[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            rest = [batch.column(k) for k in range(1, batch.num_columns)]
            fields = [batch.schema.field(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(named, pa.string()), pa.array(value)], schema=pa.schema([*fields, (predicted, pa.string()), (score, pa.float64())]))

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*kept, StructField(predicted, StringType()), StructField(score, DoubleType())])
    return docs.select(F.lower(text).alias("__text"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(predict, out)


def joined_pieces(texts: list[str | None], grams: LetterGrams, dimensions: int):
    """(text numbers, summed vectors, letters) with every text whole; a long text's pieces are added up."""
    waiting: tuple[int, np.ndarray, int] | None = None
    for pieces in text_pieces(texts):
        owner, which, rows, letters = grams.count([p for _, p in pieces])
        ids, place = np.unique([i for i, _ in pieces], return_inverse=True)
        vectors = grams.bundle(place[owner], which, rows, None, len(ids))
        letters = np.bincount(place, letters, len(ids))
        if waiting is not None and waiting[0] == ids[0]:
            vectors[0] += waiting[1]
            letters[0] += waiting[2]
        elif waiting is not None:
            yield np.array([waiting[0]]), waiting[1][None], np.array([waiting[2]])
        waiting = (int(ids[-1]), vectors[-1], int(letters[-1]))
        if len(ids) > 1:
            yield ids[:-1], vectors[:-1], letters[:-1]
    if waiting is not None:
        yield np.array([waiting[0]]), waiting[1][None], np.array([waiting[2]])
