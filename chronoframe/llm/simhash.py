"""Near duplicates by SimHash, joined with a binary trie.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most
``budget`` bits. Only distinct fingerprints are joined, so copies cost nothing.

The 64 bits are cut into five blocks. Of five blocks at most three can hold a
difference, hence two are equal: each fingerprint goes to the ten tables "these two
blocks first", and every linked pair meets in one bucket. There the remaining bits
form a binary trie which is joined with itself: pairs of nodes go down together,
carry the number of differing bits, and are dropped beyond the budget. Pairs of
nodes whose leaves are all in one component already are dropped too, so a dense
group of near copies is connected without visiting all of its pairs. A bucket emits
a spanning forest of its links; components of the whole follow from those.

Buckets of more than ``split`` fingerprints are dealt out once more by four blocks
of their remaining bits, of which one at least is equal. All members then share 35
of the 64 bits or more.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.graph import components
from chronoframe.llm.storage import stored

BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
PAIRS = 1 << 18
PIECE = 1 << 20


def fingerprint_of(data: bytes, size: int = 3) -> int:
    """The unsigned fingerprint of one text, read in pieces."""
    import re

    from xxhash import xxh64_intdigest

    space = re.compile(rb"[\x20\x09-\x0D]")
    bits, shingles, tail, at = np.zeros(64, np.int64), 0, [], 0

    def add(joined: bytes, starts: list[int], ends: list[int]) -> None:
        digests = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(starts))
        for low in range(0, len(digests), 1 << 16):
            part = digests[low : low + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            np.add(bits, np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64), out=bits)

    while at < len(data):
        end = len(data)
        if end - at > PIECE and (found := space.search(data, at + PIECE)):
            end = found.start()
        words = tail + data[at:end].lower().split()
        at = end
        if len(words) >= size:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            add(b" ".join(words), starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
            shingles += len(words) - size + 1
        tail = words[1 - size :]
    if not shingles and tail:
        joined = b" ".join(tail)
        add(joined, [0], [len(joined)])
        shingles = 1
    return int.from_bytes(np.packbits(2 * bits > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed integer.

    A null, empty or blank text has fingerprint zero and is linked like any other;
    fewer words than ``size`` make one shingle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint_of(x.as_py() or b"", size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id), F.col(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


class Trie:
    """A binary trie over sorted distinct integers; a node is a range of them."""

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        self.keys, self.bits = keys, bits
        self.label = np.arange(len(keys))
        self._mark()

    def _mark(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Give linked keys the same label."""
        a, b = self.label[i], self.label[j]
        while len(a):
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(parent, upper := parent[parent]):
                parent = upper
            self.label = parent[self.label]
            a, b = parent[a], parent[b]
            a, b = a[a != b], b[a != b]
        self._mark()

    def _one(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether all keys of a node have one label."""
        return self.changes[high - 1] == self.changes[low]

    def link(self, roots: np.ndarray, budget: int) -> None:
        """Join each subtrie with itself; ``roots`` has where each begins, then the end."""
        low, high = roots[:-1], roots[1:]
        zero = np.zeros(len(low), np.int8)
        waiting = [(self.bits - 1, low, high, low, high, zero)]
        while waiting:
            bit, alow, ahigh, blow, bhigh, err = waiting.pop()
            if len(alow) > PAIRS:
                for k in range(0, len(alow), PAIRS):
                    waiting.append((bit, *(x[k : k + PAIRS] for x in (alow, ahigh, blow, bhigh, err))))
                continue
            open_ = ~((self.label[alow] == self.label[blow]) & self._one(alow, ahigh) & self._one(blow, bhigh))
            single = (ahigh - alow == 1) & (bhigh - blow == 1)
            at_end = open_ & single
            if at_end.any():
                i, j = alow[at_end], blow[at_end]
                near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= budget
                if near.any():
                    self.connect(i[near], j[near])
            go = open_ & ~single
            if not go.any():
                continue
            alow, ahigh, blow, bhigh, err = (x[go] for x in (alow, ahigh, blow, bhigh, err))
            shift = np.uint64(bit)
            amid = np.searchsorted(self.keys, ((self.keys[alow] >> shift) | np.uint64(1)) << shift)
            bmid = np.searchsorted(self.keys, ((self.keys[blow] >> shift) | np.uint64(1)) << shift)
            other = alow != blow
            step = err + np.int8(1)
            pairs = [
                (alow, amid, blow, bmid, err),
                (amid, ahigh, bmid, bhigh, err),
                (alow, amid, bmid, bhigh, step),
                tuple(x[other] for x in (amid, ahigh, blow, bmid, step)),
            ]
            alow, ahigh, blow, bhigh, err = (np.concatenate(x) for x in zip(*pairs))
            keep = (ahigh > alow) & (bhigh > blow) & (err <= budget)
            waiting.append((bit - 1, *(x[keep] for x in (alow, ahigh, blow, bhigh, err))))


def bucket_links(group: np.ndarray, rest: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, lowest member of its component) over buckets given by number; keys are distinct in a bucket."""
    keys = (group.astype(np.uint64) << np.uint64(bits)) | rest
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    owner = keys >> np.uint64(bits)
    roots = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(keys)]))
    trie = Trie(keys, bits)
    if np.diff(roots).max(initial=0) > 64:  # connect what is closest first: the rest of a dense group is then passed over
        for least in range(1, budget):
            trie.link(roots, least)
    trie.link(roots, budget)
    member = np.flatnonzero(trie.label != np.arange(len(keys)))
    return order[member], order[trie.label[member]]


def block_value(fp: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1)


def without(fp: Column, taken: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` outside of the taken ranges, moved together."""
    out, at = F.lit(0).cast("long"), 0
    edges = sorted(taken) + [(64, 64)]
    low = 0
    for begin, end in edges:
        if begin > low:
            out = out.bitwiseOR(F.shiftleft(block_value(fp, low, begin), at))
            at += begin - low
        low = end
    return out


def links(distinct: DataFrame, fp: str = "fp", budget: int = 3, split: int = 200_000) -> DataFrame:
    """(a, b): links that connect all fingerprints within the budget. ``fp`` is unique and not null."""
    if not 0 <= budget <= 3:
        raise ValueError("two of five blocks are equal for up to three differing bits only")
    col = F.col(fp)
    entries = F.array(
        *[
            F.struct(
                F.lit(k).cast("long").alias("tab"),
                F.shiftleft(block_value(col, *BLOCKS[i]), 13).bitwiseOR(block_value(col, *BLOCKS[j])).alias("prefix"),
                without(col, [BLOCKS[i], BLOCKS[j]]).alias("rest"),
            )
            for k, (i, j) in enumerate(TABLES)
        ]
    )
    rows = distinct.select(col.alias("fp"), F.explode(entries).alias("e")).select("fp", "e.*")
    hot = rows.groupBy("tab", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("tab", "prefix", F.lit(True).alias("hot"))
    rest = F.col("rest")
    parts = [F.struct(F.lit(k).cast("long").alias("part"), block_value(rest, low, high).alias("value")) for k, (low, high) in enumerate(((0, 9), (9, 18), (18, 27), (27, 39)))]
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("value")))
    dealt = rows.join(hot, ["tab", "prefix"], "left").select("fp", "tab", "prefix", "rest", F.explode(F.when(F.col("hot"), F.array(*parts)).otherwise(whole)).alias("p")).select("fp", "tab", "prefix", "p.part", "p.value", "rest")
    keys = ["tab", "prefix", "part", "value"]

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def finish(rows: list[np.ndarray]) -> pa.RecordBatch:
            table = np.concatenate(rows, axis=1)
            new = np.any(table[2:6, 1:] != table[2:6, :-1], axis=0)
            group = np.concatenate(([0], np.cumsum(new)))
            member, lowest = bucket_links(group, table[1].view(np.uint64), 39, budget)
            return pa.RecordBatch.from_arrays([pa.array(table[0][member]), pa.array(table[0][lowest])], schema=schema)

        kept: list[np.ndarray] = []
        for batch in batches:
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
            if not table.shape[1]:
                continue
            last = np.any(table[2:6] != table[2:6, -1:], axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut or (kept and np.any(kept[-1][2:6, -1] != table[2:6, 0])):
                yield finish([*kept, table[:, :cut]])
                kept = []
            kept.append(table[:, cut:])
        if kept:
            yield finish(kept)

    return dealt.select("fp", "rest", *keys).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    The component id is the smallest id among all rows that can be reached over
    links. Rows with a null id take part; ids repeat where rows do. Other columns of
    the input play no role. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, doc_id, text, size), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), budget=budget)).withColumnRenamed("node", "fp")
    labelled = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
