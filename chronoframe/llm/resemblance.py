"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more, whole texts compared.

A 64-bit SimHash puts such pairs 10 to 18 bits apart, where unrelated texts lie too, so
candidates come from MinHash here, and exact similarity decides.

1. Each text gets a key over its shingles and ``bands`` values over ``rows`` MinHash values
   each; a pair of similarity s meets with probability 1 - (1 - s ** rows) ** bands (0.9998
   at 0.8). Equal keys are one text from here on.
2. Shingles of the texts that meet another in a band are fetched through a bit table of fixed
   size and joined. Within a band a search goes from text to similar text; who was reached is
   not compared again, so a dense group costs about one comparison a member.
3. Components of the links are the groups.

Words are runs of letters and digits, case aside. A text of fewer words than a shingle is one
shingle; one without words equals those with the same bytes inside its outer white space, null
counting as empty. The texts of one band are held by one task, 8 bytes a shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronoframe.llm.graph import components
from chronoframe.llm.storage import stored
from chronoframe.llm.substring import FILTER_BITS, SIMILARITY, WORDS, bit_table
from chronoframe.llm.text import Words, mix, shingle_hashes, text_buffer

BANDS, ROWS = 12, 3
EMPTY = np.uint64(0x5851F42D4C957F2D)


class Texts:
    """Shingles of a group of texts, one text after the other, and a key for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, hashes: np.ndarray, words: int) -> None:
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        last = np.flatnonzero(np.arange(len(hashes)) + words <= at[1:][owner])
        # Each value goes to the text that holds its first word; short texts have one.
        short = np.flatnonzero((size > 0) & (size < words))
        single = np.array([shingle_hashes(hashes[at[t] : at[t + 1]], int(size[t]))[0] + np.uint64(size[t]) for t in short], np.uint64)
        all_, own = np.concatenate((shingle_hashes(hashes, words)[last], mix(single))), np.concatenate((owner[last], short))
        order = np.argsort(own, kind="stable")
        self.shingles, own = all_[order], own[order]
        self.count = np.bincount(own, minlength=len(size))
        self.text = np.flatnonzero(self.count)
        self.first = np.searchsorted(own, self.text)
        self.key = np.empty(len(size), np.uint64)
        if len(self.text):
            self.key[self.text] = mix(np.add.reduceat(mix(self.shingles), self.first) + self.count[self.text].astype(np.uint64))
        for t in np.flatnonzero(self.count == 0):
            self.key[t] = np.uint64(xxh64_intdigest(data[offsets[t] : offsets[t + 1]].tobytes().strip())) ^ EMPTY

    def minima(self, band: int, rows: int) -> np.ndarray:
        """A value of each text with shingles."""
        out = np.full(len(self.text), np.uint64(band + 1))
        for k in range(rows if len(self.text) else 0):
            seed = np.uint64((2 * (band * rows + k) + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(self.shingles ^ seed), self.first))
        return out


def _marks(kind: str, words: int, bands: int, rows: int):
    def run(batches):
        finder = Words()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last, at, _, _, hashes in finder.groups(data, offsets):
                found = Texts(data, offsets[first : last + 1], at, hashes, words)
                values = np.zeros((len(found.key), bands), np.uint64)
                for b in range(bands):
                    values[found.text, b] = found.minima(b, rows)
                sizes = np.where(found.count > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values[found.count > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(found.key.view(np.int64)), lists], names=["doc_id", "key", "bands"])

    return run, f"doc_id {kind}, key long, bands array<long>"


def _shingles(docs: DataFrame, table: np.ndarray, bits: int, words: int) -> DataFrame:
    """(key, shingles) of the texts whose key may be in the table, each shingle once."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches):
        finder, present = Words(), np.unpackbits(shared.value, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last, at, _, _, hashes in finder.groups(data, offsets):
                found = Texts(data, offsets[first : last + 1], at, hashes, words)
                key = found.key[found.text]
                hit = np.flatnonzero(present[key >> np.uint64(64 - bits)])
                hit = hit[np.unique(key[hit], return_index=True)[1]]
                if len(hit):
                    sets = [np.unique(found.shingles[found.first[i] : found.first[i] + found.count[found.text[i]]]).view(np.int64) for i in hit]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), lists], names=["key", "shingles"])

    return docs.mapInArrow(run, "key long, shingles array<long>")


def similar(keys: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of similar sets."""
    order = sorted(range(len(keys)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
    parts = [parts[k] for k in order]
    marked = np.zeros(len(ids), bool)
    left, reached, out = np.arange(len(order)), [], []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        one = reached.pop()
        n = sizes[one]
        low, high = np.searchsorted(sizes[left], (similarity * n - 1e-9, n / similarity + 1e-9))
        others = left[low:high]
        if not len(others):
            continue
        marked[parts[one]] = True
        begins = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        both = np.add.reduceat(marked[np.concatenate([parts[k] for k in others])], begins, dtype=np.int64)
        marked[parts[one]] = False
        near = both >= similarity * (n + sizes[others] - both) - 1e-9
        found = others[near].tolist()
        out += [(keys[order[one]], keys[order[k]]) for k in found]
        reached += found
        left = np.concatenate((left[:low], others[~near], left[high:]))
    return out


def _linked(similarity: float):
    """Over rows (band, key, shingles) sorted by band: links that connect the similar texts of each band."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches):
        band, keys, sets = None, [], []
        for batch in batches:
            out = []
            for this, key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if this != band:
                    out += similar(keys, sets, similarity) if keys else []
                    band, keys, sets = this, [], []
                keys.append(key)
                sets.append(row.values.to_numpy().copy())
            yield table(out)
        if keys:
            yield table(similar(keys, sets, similarity))

    return run


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, filter_bits: int = FILTER_BITS, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of every row; the component id is the smallest id that can be reached over similar pairs.

    ``also`` has (doc_id, component_id) of groups found otherwise, for ids that each name one text:
    rows of one such group are linked too.
    """
    lower = F.lower(text).alias("t")
    run, schema = _marks(docs.schema[doc_id].dataType.simpleString(), words, bands, rows)
    marked = stored(docs.select(F.col(doc_id), lower).mapInArrow(run, schema), "marks")
    distinct = marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    met = distinct.select("key", F.explode("bands").alias("band"))
    several = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    pairs = stored(met.join(several, "band"), "meeting")
    fetched = _shingles(docs.select(lower), bit_table(pairs, filter_bits), filter_bits, words).groupBy("key").agg(F.first("shingles").alias("shingles"))
    gathered = pairs.join(fetched, "key").select("band", "key", "shingles")
    linked = gathered.repartition("band").sortWithinPartitions("band").mapInArrow(_linked(similarity), "a long, b long")
    if also is not None:
        given = also.select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_group")).distinct()
        grouped = stored(marked.join(given, F.col("doc_id") == F.col("_id")).select("_group", F.col("key").alias("a")).distinct(), "groups")
        apart = grouped.groupBy("_group").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("_group", "b")
        linked = linked.unionByName(grouped.join(apart, "_group").select("a", "b"))
    near = components(linked)
    labelled = distinct.select("key", "first").join(near.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select("doc_id", "key").join(labelled.join(lowest, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
