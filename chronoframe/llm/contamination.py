"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is in a document when at least ``threshold`` of its distinct five-word shingles
are. Words are runs of letters and digits without case.

A document's shingles that occur in no item cannot matter, so each document is reduced
to those that may: a bit table of fixed size over all item shingles, sent to all tasks,
sorts them out without losing one. Reduced documents are partitioned by size, and within
a partition containment turns into a bound on Jaccard similarity, from which the number
of MinHash bands follows that misses a qualifying pair with probability ``miss`` at most
(Zhu et al., 2016). Items and documents that agree in a band are candidates; these are
verified by exact containment. Where the sizes are so far apart that more than
``max_bands`` bands were needed, every shingle is a key of its own, which misses nothing.

Defined cases: null texts are empty; an item of fewer than five words has no shingle and
is never found; repeated items (same id) are one item with the shingles of all; repeated
documents (same id and text) are reported once; ids may be null; empty tables give no
rows. Whole texts are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored
from chronoframe.llm.text import Words, mix, shingle_hashes, text_buffer

WORDS, THRESHOLD = 5, 0.8
FILTER_BITS = 22


def bands(size_class: int, item_class: int, threshold: float, miss: float, max_bands: int) -> tuple[int, int] | None:
    """(bands, rows in each) for reduced documents of up to 2**size_class shingles and items above 2**(item_class - 1).

    None: take every shingle as a key. An empty pairing has no bands.
    """
    upper, smallest = 1 << size_class, (1 << item_class >> 1) + 1 if item_class else 1
    if threshold * smallest > upper:
        return 0, 1
    jaccard = threshold * smallest / (upper + (1 - threshold) * smallest)
    rows = 2 if jaccard >= 0.5 else 1
    chance = min(jaccard, 1.0) ** rows
    count = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log(1 - chance))
    return (count, rows) if count <= max_bands else None


def minhash_keys(shingles: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One key for each band."""
    out = np.arange(1, count + 1, dtype=np.uint64)
    for row in range(rows):
        seeds = [np.uint64((2 * (band * rows + row) + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) for band in range(count)]
        lowest = np.array([mix(shingles ^ seed).min() for seed in seeds], np.uint64)
        out = out * np.uint64(0xBF58476D1CE4E5B9) + lowest
    return mix(out)


def class_of(n: int) -> int:
    """The smallest c with n <= 2**c."""
    return max(0, int(n - 1).bit_length())


def _shingles(words: int):
    """Distinct shingle hashes of each text, as a list."""

    def run(batches):
        finder = Words()
        for batch in batches:
            rows = []
            data, offsets = text_buffer(batch.column(1))
            for first, last, at, _, _, hashes in finder.groups(data, offsets):
                for k in range(last - first):
                    rows.append(np.unique(shingle_hashes(hashes[at[k] : at[k + 1]], words)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], names=["id", "shingles"])

    return run


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _reduced(words: int, table: np.ndarray, bits: int, least: int):
    """Rows with the shingles that may be in an item, where there are at least ``least``."""

    def run(batches):
        finder = Words()
        present = np.unpackbits(table, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            picked, rows = [], []
            for first, last, at, _, _, hashes in finder.groups(data, offsets):
                all_ = shingle_hashes(hashes, words)
                hit = np.flatnonzero(present[all_ >> np.uint64(64 - bits)])
                if not len(hit):
                    continue
                doc = np.searchsorted(at, hit, "right") - 1
                inside = hit + words <= at[doc + 1]  # no shingle crosses from one text to the next
                hit, doc = hit[inside], doc[inside]
                for d, begin, size in zip(*np.unique(doc, return_index=True, return_counts=True)):
                    some = np.unique(all_[hit[begin : begin + size]])
                    if len(some) >= least:
                        picked.append(first + int(d))
                        rows.append(some.view(np.int64))
            if picked:
                take = pa.array(picked)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _lists(rows)], names=["row", "doc", "shingles"])

    return run


def _keys(classes: list[int], of_items: bool, threshold: float, miss: float, max_bands: int, largest: int):
    """(id, pairing, key): the keys of an item for all size classes of documents, or of a document for all classes of items."""
    schema = pa.schema([("id", pa.int64()), ("pairing", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            out: list[pa.RecordBatch] = []
            ids = batch.column(0).to_pylist()
            for k, value in enumerate(batch.column(1)):
                shingles = value.values.to_numpy().view(np.uint64)
                if not len(shingles):
                    continue
                own = class_of(len(shingles))
                for other in range(largest + 1) if of_items else classes:
                    size_class, item_class = (other, own) if of_items else (own, other)
                    plan = bands(size_class, item_class, threshold, miss, max_bands)
                    keys = shingles if plan is None else minhash_keys(shingles, *plan)
                    n = len(keys)
                    if n:
                        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[k], np.int64)), pa.array(np.full(n, size_class * 64 + item_class, np.int32)), pa.array(keys.view(np.int64))], schema=schema))
            yield from out

    return run


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, miss: float = 1e-4, max_bands: int = 64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every item in every document, and ``row``, a hash of id and text."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    sets = items.select(F.col(item_id).alias("id"), F.lower(item_text)).mapInArrow(_shingles(words), f"id {item_kind}, shingles array<long>")
    sets = stored(sets.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles")).withColumn("n", F.size("shingles")).where("n > 0").withColumn("item", F.xxhash64("id")), "items")
    bits = sets.select(F.explode("shingles").alias("s")).select(F.shiftrightunsigned("s", 64 - filter_bits).alias("bit")).distinct()
    positions = bits.toArrow().column("bit").to_numpy()  # 2**filter_bits of them at most
    table = np.zeros(1 << filter_bits, np.uint8)
    table[positions] = 1
    table = np.packbits(table, bitorder="little")
    sizes = sorted({class_of(r["n"]) for r in sets.select("n").distinct().collect()})
    least = sets.agg(F.min("n")).first()[0] or 1

    row = F.xxhash64(doc_id, text)
    reduced = docs.select(row.alias("row"), F.col(doc_id).alias("doc"), F.lower(text)).mapInArrow(_reduced(words, table, filter_bits, math.ceil(threshold * least)), f"row long, doc {kind}, shingles array<long>")
    reduced = stored(reduced, "reduced")
    largest = class_of(reduced.agg(F.max(F.size("shingles"))).first()[0] or 1)
    schema = "id long, pairing int, key long"
    asked = sets.select("item", "shingles").mapInArrow(_keys(sizes, True, threshold, miss, max_bands, largest), schema).withColumnRenamed("id", "item")
    given = reduced.select("row", "shingles").mapInArrow(_keys(sizes, False, threshold, miss, max_bands, largest), schema).withColumnRenamed("id", "row")
    candidates = given.join(asked, ["pairing", "key"]).select("row", "item").distinct()
    unique = reduced.dropDuplicates(["row"])
    shared = F.size(F.array_intersect("shingles", "wanted"))
    return (
        candidates.join(unique, "row").join(sets.select("item", F.col("id").alias("item_id"), F.col("shingles").alias("wanted"), "n"), "item")
        .select(F.col("doc").alias("doc_id"), "item_id", shared.alias("shared"), F.col("n").alias("item_shingles"), (shared / F.col("n")).alias("containment"), "row")
        .where(F.col("containment") >= threshold)
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    found = find(docs, items, doc_id, text, **how).select(F.col("row").alias("__row")).distinct()
    return docs.join(found, F.xxhash64(doc_id, text) == F.col("__row"), "left_anti")
