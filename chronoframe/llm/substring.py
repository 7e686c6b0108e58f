"""Substring deduplication by MinHash banding over paragraphs.

Shared passages sit in the middle of other text, so paragraphs are cut by content: after
a word whose pair with the next has the smallest hash among ``reach`` words to either
side. A passage is then cut alike wherever it stands.

1. Each paragraph gets ``count`` bands of one MinHash value over its five-word shingles;
   a pair of similarity s meets with probability 1 - (1 - s) ** count (0.992 at 0.8 for
   three). Equal paragraphs of a batch go out once, with their number.
2. Paragraphs that collide are joined by band. Their shingles are fetched, and exact
   Jaccard similarity decides; a pair that is in one component already needs no look.
   A band with more than ``crowd`` different paragraphs is divided by the shingles of a
   prefix, one of which a similar pair must share besides the band's own.
3. Components of the verified pairs are the classes. Where a document has paragraphs of
   classes with several members side by side and they make ``least_words`` words or more,
   these are reported; all but the first place of a class (by id, then position) are marked
   as removed. Texts too short for that are compared as wholes too, and reported from five words on.

What a batch must look up goes through a bit table of fixed size, which loses nothing; the
exact join follows.

Defined cases: null and empty texts, and paragraphs of fewer than five words, have nothing
to report; rows with equal id and text count as documents of their own, but share their
rows here; ids may be null; whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.graph import components
from chronoframe.llm.storage import stored
from chronoframe.llm.text import Words, mix, shingle_hashes, text_buffer

WORDS, SIMILARITY = 5, 0.8
REACH, BANDS = 5, 3
FILTER_BITS = 24
FEW = 24
FAR = np.iinfo(np.uint64).max
WHOLE = np.uint64(0x2545F4914F6CDD1D)


def cut_after(hashes: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Which words end a paragraph; ``at`` has where the words of each text begin, then the end."""
    n, texts = len(hashes), len(at) - 1
    if not n:
        return np.zeros(0, bool)
    pair = np.append(mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]), hashes[-1])
    place = np.arange(n) + reach * (1 + np.repeat(np.arange(texts), np.diff(at)))
    wide = np.full(n + reach * (texts + 1), FAR)
    wide[place] = pair
    left, right = np.full(n, FAR), np.full(n, FAR)
    for k in range(1, reach + 1):
        np.minimum(left, wide[place - k], out=left)
        np.minimum(right, wide[place + k], out=right)
    out = (pair < left) & (pair <= right)
    out[at[1:][np.diff(at) > 0] - 1] = True
    return out


class Paragraphs:
    """The paragraphs of a group of texts with at least one shingle, then the texts of fewer than ``whole`` words as they are."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, words: int, reach: int, whole: int) -> None:
        ends = np.flatnonzero(cut_after(hashes, at, reach)) + 1
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        keep = ends - starts >= words
        size = np.diff(at)
        short = np.flatnonzero((size >= words) & (size < whole))
        self.whole = np.repeat([False, True], (int(keep.sum()), len(short)))
        self.starts, self.ends = np.concatenate((starts[keep], at[short])), np.concatenate((ends[keep], at[short + 1]))
        self.text = np.searchsorted(at, self.starts, "right") - 1
        plain = np.append(shingle_hashes(hashes, words), np.uint64(0))
        # Whole texts have shingles of their own, or one would be similar to a paragraph of itself.
        self.shingles = np.concatenate((plain, mix(plain + WHOLE))) if len(short) else plain
        self.first = self.starts + self.whole * len(plain)
        self.last = self.first + (self.ends - self.starts) - words + 1
        self.edges = np.stack([self.first, self.last], axis=1).ravel()
        self.key = np.add.reduceat(mix(self.shingles), self.edges)[::2] if len(self.starts) else np.zeros(0, np.uint64)

    def minima(self, band: int) -> np.ndarray:
        seed = np.uint64((2 * band + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
        low = np.minimum.reduceat(mix(self.shingles ^ seed), self.edges)[::2] if len(self.starts) else np.zeros(0, np.uint64)
        return mix(low + np.uint64(band))


def _bands(words: int, reach: int, count: int, whole: int):
    schema = pa.schema([("band", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        finder = Words()
        waiting: list[np.ndarray] = []
        held = 0

        def send():
            rows = np.concatenate(waiting, axis=1)
            _, first, n = np.unique(rows[0], return_index=True, return_counts=True)
            for band in range(count):
                yield pa.RecordBatch.from_arrays([pa.array(rows[1 + band, first].view(np.int64)), pa.array(rows[0, first].view(np.int64)), pa.array(n if band == 0 else np.zeros(len(n), np.int64))], schema=schema)

        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for _, _, at, _, _, hashes in finder.groups(data, offsets):
                found = Paragraphs(hashes, at, words, reach, whole)
                waiting.append(np.stack([found.key, *[found.minima(b) for b in range(count)]]))
                held += len(found.key)
                if held > 500_000:
                    yield from send()
                    waiting, held = [], 0
        if held:
            yield from send()

    return run


def _colliding(batches):
    """Over rows sorted by (band, key): kind 0 for paragraphs that occur twice, kind 1 for those of a band with several."""
    schema = pa.schema([("kind", pa.int32()), ("band", pa.int64()), ("key", pa.int64())])

    def finish(rows: list[np.ndarray]) -> pa.RecordBatch:
        band, key, n = np.concatenate(rows, axis=1)
        new = np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
        total = np.bincount(np.cumsum(new) - 1, n)
        band, key = band[new], key[new]
        group = np.concatenate(([0], np.cumsum(band[1:] != band[:-1])))
        several = np.bincount(group)[group] > 1
        twice = total > 1
        kind = np.repeat(np.array([0, 1], np.int32), (int(twice.sum()), int(several.sum())))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((band[twice], band[several]))), pa.array(np.concatenate((key[twice], key[several])))], schema=schema)

    kept: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        if not rows.shape[1]:
            continue
        other = np.flatnonzero(rows[0] != rows[0, -1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (kept and kept[-1][0, -1] != rows[0, 0]):
            yield finish([*kept, rows[:, :cut]])
            kept = []
        kept.append(rows[:, cut:])
    if kept:
        yield finish(kept)


def bit_table(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of ``2**bits`` bits, packed, with those set that a key points to."""
    size, part = 1 << bits, 1 << 13
    place = F.shiftrightunsigned("key", 64 - bits)

    def pack(batches):
        for batch in batches:
            for block, inside in zip(batch.column(0).to_pylist(), batch.column(1)):
                flags = np.zeros(part, np.uint8)
                flags[inside.values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    blocks = keys.select(F.shiftright(place, 13).alias("block"), place.bitwiseAND(part - 1).alias("inside")).distinct().groupBy("block").agg(F.collect_list("inside").alias("inside"))
    out = np.zeros(size // 8, np.uint8)
    for row in blocks.mapInArrow(pack, "block long, bits binary").collect():  # 2**bits / 8 bytes at most
        out[row["block"] * part // 8 : (row["block"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _looked_up(docs: DataFrame, table: np.ndarray, bits: int, words: int, reach: int, whole: int, of_shingles: bool, kind: str):
    """Paragraphs whose key may be in the table: their shingles, or where they stand."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches):
        finder, present = Words(), np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for first, _, at, starts, ends, hashes in finder.groups(data, offsets):
                found = Paragraphs(hashes, at, words, reach, whole)
                hit = np.flatnonzero(present[found.key >> np.uint64(64 - bits)])
                if not len(hit):
                    continue
                key = pa.array(found.key[hit].view(np.int64))
                if of_shingles:
                    _, one = np.unique(found.key[hit], return_index=True)
                    rows = [np.unique(found.shingles[found.first[i] : found.last[i]]).view(np.int64) for i in hit[one]]
                    column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(one)), column], names=["key", "shingles"])
                else:
                    text = found.text[hit]
                    take, begin = pa.array(first + text), offsets[first + text]
                    place = [pa.array(x) for x in (found.starts[hit] - at[text], found.ends[hit] - at[text], starts[found.starts[hit]] - begin, ends[found.ends[hit] - 1] - begin)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), key, pa.array(found.whole[hit]), *place], names=["doc_id", "th", "key", "whole", "first_word", "last_word", "start", "end"])

    out = "key long, shingles array<long>" if of_shingles else f"doc_id {kind}, th long, key long, whole boolean, first_word long, last_word long, start long, end long"
    return docs.mapInArrow(run, out)


def _verified(similarity: float):
    """Over rows sorted by (band, part): links that connect similar paragraphs of each group.

    A few are compared as sets, pair by pair; many in a search from paragraph to similar
    paragraph, a whole row of comparisons at once. Both connect the same.
    """
    from chronoframe.llm.resemblance import similar

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(members: dict[int, frozenset]) -> list[tuple[int, int]]:
        if len(members) > FEW:
            return similar(list(members), [np.array(sorted(m), np.int64) for m in members.values()], similarity)
        order = sorted(members, key=lambda k: (len(members[k]), k))
        root = {k: k for k in order}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for i, a in enumerate(order):
            one = members[a]
            for b in order[i + 1 :]:
                if len(one) < similarity * len(members[b]):
                    break
                if find(a) != find(b):
                    both = len(one & members[b])
                    if both >= similarity * (len(one) + len(members[b]) - both):
                        root[find(b)] = find(a)
                        out.append((a, b))
        return out

    def run(batches):
        group, members = None, {}
        for batch in batches:
            out = []
            for band, part, key, shingles in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if group != (band, part):
                    out += links(members)
                    group, members = (band, part), {}
                members[key] = frozenset(shingles.values.to_numpy().tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*links(members))) or [[], []])], schema=schema)

    return run


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, reach: int = REACH, count: int = BANDS, least_words: int = 20, crowd: int = 500, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, component_id, start, end, words, removed): repeated paragraphs, by byte offsets.

    ``component_id`` is the smallest id with a paragraph of the class; adjacent paragraphs
    of one document and component come as one row.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = least_words + 2 * (words - 1)  # from here on the paragraphs of a copy make least_words, without its ends
    bands = docs.select(F.lower(text)).mapInArrow(_bands(words, reach, count, whole), "band long, key long, n long")
    met = stored(bands.repartition("band").sortWithinPartitions("band", "key").mapInArrow(_colliding, "kind int, band long, key long"), "colliding")
    pairs = met.where("kind = 1").select("band", "key")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("th"), F.lower(text).alias("t"))

    fetched = _looked_up(keyed, bit_table(pairs, filter_bits), filter_bits, words, reach, whole, True, kind).groupBy("key").agg(F.first("shingles").alias("shingles"))
    crowds = pairs.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("band", F.lit(True).alias("crowd"))
    size = F.size("shingles")
    prefix = F.slice(F.sort_array("shingles"), F.lit(1), F.least(size, (size - F.ceil(F.lit(similarity) * size) + 2).cast("int")))
    part = F.explode(F.when(F.col("crowd"), prefix).otherwise(F.array(F.lit(0).cast("long")))).alias("part")
    gathered = pairs.join(fetched, "key").join(crowds, "band", "left").select("band", part, "key", "shingles")
    links = gathered.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(_verified(similarity), "a long, b long")
    near = components(links)
    classes = met.where("kind = 0").select(F.col("key").alias("node"), F.col("key").alias("root")).join(near.select("node"), "node", "left_anti").unionByName(near)
    classes = stored(classes.select(F.col("node").alias("key"), "root"), "classes")

    found = _looked_up(keyed, bit_table(classes.select("key"), filter_bits), filter_bits, words, reach, whole, False, kind).join(classes, "key")
    own = Window.partitionBy("doc_id", "th", "whole").orderBy("first_word")
    gap = F.coalesce(F.col("first_word") != F.lag("last_word").over(own), F.lit(True)).cast("int")
    island = found.distinct().withColumn("island", F.sum(gap).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(F.col("last_word") - F.col("first_word")).over(Window.partitionBy("doc_id", "th", "whole", "island"))
    long_enough = stored(island.withColumn("total", total).where(F.col("whole") | (F.col("total") >= least_words)).select("doc_id", "th", "whole", "root", "start", "end", "first_word", "last_word", "island"), "paragraphs")
    firsts = long_enough.groupBy("root").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    named = long_enough.join(firsts, "root").select("*", F.col("first.doc_id").alias("component_id"))
    removed = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("start") == F.col("first.start")))
    # A text that is reported as a whole needs no rows for its parts, unless these go and it stays.
    of_text = F.max(F.when(F.col("whole"), F.col("removed").cast("int"))).over(Window.partitionBy("doc_id", "th"))
    return (
        named.groupBy("doc_id", "th", "whole", "component_id", "island", removed.alias("removed"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("last_word") - F.col("first_word")).alias("words"))
        .withColumn("of_text", of_text)
        .where(F.col("whole") | F.col("of_text").isNull() | (F.col("removed").cast("int") > F.col("of_text")))
        .select("doc_id", "component_id", "start", "end", "words", "removed")
    )
