"""Documents whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more, and their components.

The join is exact and works with combinations of tokens, where a token is one n-gram:

1. Equal sets are one set from here on, told by a 64-bit sum over their tokens. A similar set
   lacks a bounded number of a set's tokens; if more than so many are in no other set already
   among the tokens whose hash is divisible by ``SAMPLE``, the set is linked with nothing. Only
   the sets that are left are looked at any more, and all of their tokens are counted; the rarest
   come first in the order of all tokens, and those of one set only are merely numbered.
2. Tokens are of three classes by their number of sets. A class asks for k = 1, 2 or 3 shared
   tokens, and is dealt into buckets by hash so that long texts have no more combinations than
   short ones. If the tokens of a prefix in some bucket are a, it can lack a - k + 1 of them
   before fewer than k are shared. So the prefix is extended until the sum of these numbers is
   above what a similar set may lack at most. Two similar sets then share k tokens of one bucket
   within both prefixes: rare tokens alone, frequent ones in combinations, are the index.
   Buckets depend on the size of the set, by powers of two; a set near the next one is indexed
   under both, which tells sizes apart as well.
3. Sets of one signature are first held against one of them, the one with the fewest tokens of
   its own, and verified; components follow. What is then still apart is compared within its
   signature, the closest pair of two components first, then all pairs. Bit sketches of the sets
   bound their difference from below, so that few pairs that fail are verified. Signatures of
   more than ``crowd`` sets are compared in blocks.
4. Verification counts shared tokens. The smallest id of a component names it.

Defined cases: A-Z alone are lower-cased; words are runs of anything but white space
(``[^\\x20\\x09-\\x0D]+``); a text of fewer words than ``size`` is one token, one without words
or null has the empty set and is linked with nothing; rows that repeat id and text are rows of
their own; ids may be null, and name a component only if all of its ids are; an empty table gives
no rows; other columns are ignored; whole texts and words of any length are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.graph import components
from chronoframe.llm.storage import stored
from chronoframe.llm.substring import bit_table
from chronoframe.llm.text import BASE, Words, mix, shingle_hashes, text_buffer

SIZE, PERCENT = 3, 90
RARE, COMMON = 16, 4096  # up to so many sets a token counts alone, then in pairs, then in threes
PER_BUCKET = (0, 8, 4)  # lacking tokens that a bucket stands for, by class
SMALL = 16  # sets below this size are indexed by single tokens
CAP = 1 << 20  # tokens of more sets than this are of one frequency
CROWD = 4096
SKETCH = 4  # words of 64 bits
SEEN = 1 << 20
SAMPLE = 4
LEAST_BITS, MOST_BITS = 20, 28  # of the table that spares the tokens of sets that are out; what it lets through costs work only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- sets of tokens ----------------------------------------------------------------------


class Spaced(Words):
    """Words between white space, of any length."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.ones(256, bool)
        self.table[[32, *range(9, 14)]] = False

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, past the last, where each text's words begin, hashes), group by group."""
        for first, last, at, starts, ends, hashes in self.groups(data, offsets):
            if last - first == 1 and len(starts) > 1 and (starts[1:] == ends[:-1]).any():
                # A word over several pieces: its parts touch.
                word = np.concatenate(([0], np.cumsum(starts[1:] != ends[:-1])))
                begin = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]))
                hashes = np.array([self._joined(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])], np.uint64)
                at = np.array([0, len(hashes)])
            yield first, last, at, hashes

    @staticmethod
    def _joined(parts: np.ndarray) -> np.uint64:
        out = int(parts[0])
        for part in parts[1:].tolist():
            out = (out * BASE + part + 1) & ((1 << 64) - 1)
        return np.uint64(out)


def token_sets(at: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens, text after text; their number by text; a key by text, 0 for the empty set."""
    words = np.diff(at)
    owner = np.repeat(np.arange(len(words)), words)
    whole = np.flatnonzero(np.arange(len(hashes)) + size <= at[1:][owner])
    short = np.flatnonzero((words > 0) & (words < size))
    single = np.array([shingle_hashes(hashes[at[t] : at[t + 1]], int(words[t]))[0] + np.uint64(words[t]) for t in short], np.uint64)
    tokens = np.concatenate((shingle_hashes(hashes, size)[whole], mix(single)))
    own = np.concatenate((owner[whole], short))
    order = np.lexsort((tokens, own))
    tokens, own = tokens[order], own[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
    tokens, own = tokens[new], own[new]
    count = np.bincount(own, minlength=len(words))
    key = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        begin = np.cumsum(count[full]) - count[full]
        key[full] = mix(np.add.reduceat(mix(tokens ^ np.uint64(BASE)), begin) + count[full].astype(np.uint64)) | np.uint64(1)
    return tokens, count, key


def _each(batches, size: int):
    finder = Spaced()
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.num_columns - 1))
        for first, last, at, hashes in finder.texts(LOWER[data], offsets):
            yield batch, first, last, *token_sets(at, hashes, size)


def _marks(size: int):
    def run(batches):
        for batch, first, last, tokens, count, key in _each(batches, size):
            sampled = np.bincount(np.repeat(np.arange(len(count)), count)[tokens % np.uint64(SAMPLE) == 0], minlength=len(count))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *[pa.array(x.astype(np.int64, copy=False)) for x in (key.view(np.int64), count, sampled)]], names=["doc_id", "key", "n", "sampled"])

    return run


def _tokens(size: int, table: Broadcast | None = None, bits: int = 0):
    """(token, key) of every set, sampled tokens alone or those of sets in the table; sets that a task has just seen are not sent again."""

    def run(batches):
        seen: set[int] = set()
        present = None if table is None else np.unpackbits(table.value, bitorder="little").view(bool)
        for _, _, _, tokens, count, key in _each(batches, size):
            fresh = np.zeros(len(key), bool)
            open_ = key != 0 if present is None else (key != 0) & present[key >> np.uint64(64 - bits)]
            for t in np.flatnonzero(open_).tolist():
                if (k := int(key[t])) not in seen:
                    seen.add(k)
                    fresh[t] = True
            seen = set() if len(seen) > SEEN else seen
            send = np.repeat(fresh, count)
            if present is None:
                send &= tokens % np.uint64(SAMPLE) == 0
            yield pa.RecordBatch.from_arrays([pa.array(x[send].view(np.int64)) for x in (tokens, np.repeat(key, count))], names=["token", "key"])

    return run


def _shared(cap: int):
    """Over (token, key) in order: (key, token, sets) of the tokens of several sets; ``sets`` ends at ``cap``.

    Holds at most ``cap`` rows of a token: beyond, its frequency is settled, and rows go on at once.
    """

    def table(key: np.ndarray, token: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(token), pa.array(sets)], names=["key", "token", "sets"])

    def run(batches):
        tokens, keys, busy = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # busy: the one row held is out already
        for batch in batches:
            tokens = np.concatenate((tokens, batch.column(0).to_numpy(zero_copy_only=False)))
            keys = np.concatenate((keys, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(tokens):
                continue
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
            tokens, keys = tokens[new], keys[new]
            begin = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1))
            size = np.diff(np.concatenate((begin, [len(tokens)])))
            if busy:
                size[0] += cap
            sets = np.minimum(np.repeat(size, np.diff(np.concatenate((begin, [len(tokens)])))), cap).astype(np.int64)
            send = sets > 1
            send[0] &= not busy
            last = int(begin[-1])
            full = sets[last] >= cap
            if not full:
                send[last:] = False
            yield table(keys[send], tokens[send], sets[send])
            low = len(tokens) - 1 if full else last
            tokens, keys, busy = tokens[low:], keys[low:], bool(full)
        if len(tokens) > 1:
            yield table(keys, tokens, np.full(len(tokens), len(tokens), np.int64))

    return run


# --- signatures --------------------------------------------------------------------------


def lacking(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set can lack."""
    return n * (100 - percent) // 100


def combinations(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k of the tokens, which are in order."""
    if k == 1:
        return mix(tokens)
    if len(tokens) < k:
        return np.zeros(0, np.uint64)
    i, j = np.triu_indices(len(tokens), 1)
    pair = mix(mix(tokens[i]) * np.uint64(BASE) + tokens[j])
    if k == 2:
        return pair
    third = np.arange(len(tokens))[None, :] > j[:, None]
    at, last = np.nonzero(third)
    return mix(pair[at] * np.uint64(BASE) + tokens[last])


def signatures(n: int, sets: np.ndarray, tokens: np.ndarray, percent: int = PERCENT, rare: int = RARE, common: int = COMMON) -> np.ndarray:
    """Signatures of a set of n tokens, of which ``tokens`` are in several sets."""
    order = np.lexsort((tokens, sets))
    sets, tokens = sets[order], tokens[order]
    need = lacking(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)  # it lacks too much already
    out = []
    for band in range(n.bit_length() - 1, (100 * n // percent).bit_length()):
        small = 1 << band < SMALL
        kind = np.zeros(len(tokens), np.int64) if small else (sets > rare).astype(np.int64) + (sets > common)
        number = np.array([1, *(max(1, lacking(1 << band, percent) // PER_BUCKET[c]) for c in (1, 2))])[kind]
        bucket = (mix(tokens + np.uint64(band)) % number.astype(np.uint64)).astype(np.int64) * 3 + kind
        # The rank of a token within its bucket: from the k-th on, each is one that may not be lacking.
        by = np.argsort(bucket, kind="stable")
        sorted_ = bucket[by]
        begin = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1)) if len(by) else np.zeros(0, np.int64)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(by)]))))
        covered = np.cumsum(rank >= kind)
        end = int(np.searchsorted(covered, need)) + 1
        for b in np.unique(bucket[:end]).tolist():
            chosen = np.sort(tokens[:end][bucket[:end] == b])
            out.append(mix(combinations(chosen, b % 3 + 1) + np.uint64(band << 40 | b)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Two sketches differ in no more bits than their sets in tokens."""
    place = (mix(tokens * np.uint64(BASE)) % np.uint64(64 * SKETCH)).astype(np.int64)
    bits = np.bincount(place, minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


SIGNED = "key long, n long, own long, tokens array<long>, signatures array<long>, " + ", ".join(f"s{k} long" for k in range(SKETCH))


def _sign(percent: int, rare: int, common: int):
    """Over (key, n, tokens, sets): the sets that have a signature."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, tokens, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                tokens = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = signatures(n, sets.values.to_numpy(zero_copy_only=False), tokens, percent, rare, common)
                if len(found):
                    rows.append((key, n, n - len(tokens), tokens.view(np.int64), found.view(np.int64), *sketch(tokens).view(np.int64).tolist()))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64()] * SKETCH
            names = ["key", "n", "own", "tokens", "signatures", *(f"s{k}" for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


# --- candidates --------------------------------------------------------------------------


def _close(percent: int):
    """Over (signature, block, side, root, key, n, own, sketch) by signature and block: pairs of two components that may be similar.

    With ``best`` set, of two components the closest pair alone.
    """

    def pairs(rows: list[tuple], best: bool) -> list[tuple[int, int]]:
        table = np.array([r[2:7] for r in rows], np.int64)
        side, root, key, n, own = table.T
        bits = np.array([r[7:] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(n, kind="stable")
        side, root, key, n, own, bits = (x[order] for x in (side, root, key, n, own, bits))
        found: dict = {}
        out = []
        for i in range(len(n)):
            high = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
            others = np.arange(i + 1, high)
            others = others[(root[others] != root[i]) & ((side[others] != side[i]) | (side[i] < 0))]
            if not len(others):
                continue
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) + own[others] + own[i]
            near = (100 + percent) * apart <= (100 - percent) * (n[others] + n[i])
            if not best:
                out += [(int(key[i]), k) for k in key[others[near]].tolist()]
                continue
            for j, d in zip(others[near].tolist(), apart[near].tolist()):
                two = (min(root[i], root[j]), max(root[i], root[j]))
                if two not in found or d < found[two][0]:
                    found[two] = (d, int(key[i]), int(key[j]))
        return out + [x[1:] for x in found.values()]

    def task(best: bool):
        def run(batches):
            at, rows = None, []
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[:2] != at:
                        out += pairs(rows, best) if len(rows) > 1 else []
                        at, rows = row[:2], []
                    rows.append(row)
                yield table(out)
            if len(rows) > 1:
                yield table(pairs(rows, best))

        return run

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return task


class Join:
    """The sets of a corpus and the links that connect the similar ones."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int, percent: int, rare: int, common: int, cap: int, crowd: int) -> None:
        if not 70 <= percent <= 100:
            raise ValueError("a similarity of 70 to 100 per cent")
        self.percent, self.crowd = percent, crowd
        source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()
        self.marks = stored(source.mapInArrow(_marks(size), f"doc_id {kind}, key long, n long, sampled long"), "sets")
        self.distinct = self.marks.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sampled").alias("sampled"), F.min("doc_id").alias("first"))

        def shared(tokens: DataFrame) -> DataFrame:
            return tokens.repartition("token").sortWithinPartitions("token", "key").mapInArrow(_shared(cap), "key long, token long, sets long")

        texts = source.select("text")
        in_others = shared(texts.mapInArrow(_tokens(size), "token long, key long")).groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
        own = F.col("sampled") - F.coalesce("shared", F.lit(0))
        left = stored(self.distinct.join(in_others, "key", "left").where(100 * own <= (100 - percent) * F.col("n")).select("key"), "left")
        bits = min(MOST_BITS, max(LEAST_BITS, (8 * left.count()).bit_length()))
        table = docs.sparkSession.sparkContext.broadcast(bit_table(left, bits))
        shared = shared(texts.mapInArrow(_tokens(size, table, bits), "token long, key long"))
        gathered = shared.groupBy("key").agg(F.collect_list("token").alias("tokens"), F.collect_list("sets").alias("sets"))
        sized = gathered.join(self.distinct.select("key", "n"), "key").where((100 - percent) * F.col("n") >= 100 * (F.col("n") - F.size("tokens")))
        self.sets = stored(sized.select("key", "n", "tokens", "sets").mapInArrow(_sign(percent, rare, common), SIGNED), "signed")
        signed = self.sets.select("key", F.explode("signatures").alias("signature"))
        several = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        self.index = stored(signed.join(several, "signature"), "index")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""
        a = self.sets.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
        b = self.sets.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
        both = F.size(F.array_intersect("at", "bt"))
        return pairs.join(a, "a").join(b, "b").where(100 * both >= self.percent * (F.col("an") + F.col("bn") - both)).select("a", "b")

    def hubs(self) -> DataFrame:
        """Pairs of each set with the set of its signatures that has the fewest tokens of its own."""
        bits = [f"s{k}" for k in range(SKETCH)]
        facts = self.sets.select("key", "n", "own", *bits)
        members = self.index.join(facts, "key")
        hub = members.groupBy("signature").agg(F.min(F.struct("own", "key", "n", *bits)).alias("hub"))
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub.{b}"))) for b in bits), F.col("own") + F.col("hub.own"))
        near = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("n") + F.col("hub.n"))
        return members.join(hub, "signature").where((F.col("key") != F.col("hub.key")) & near).select(F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct()

    def apart(self, roots: DataFrame, best: bool) -> DataFrame:
        """Pairs of one signature, of components that are still apart."""
        bits = [f"s{k}" for k in range(SKETCH)]
        facts = self.sets.select("key", "n", "own", *bits).join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
        members = self.index.join(facts.drop("node"), "key")
        open_ = members.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("signature")
        # Blocks of a crowded signature meet two by two; sides tell the two apart.
        number = F.ceil(F.col("members") / self.crowd)
        part = F.pmod(F.xxhash64("key"), number)
        meets = F.transform(F.sequence(F.lit(0).cast("long"), number - 1), lambda k: F.struct((F.least(k, F.col("part")) * number + F.greatest(k, F.col("part"))).alias("block"), F.when(k == F.col("part"), -1).otherwise(F.col("part")).alias("side")))
        dealt = members.join(open_, "signature").withColumn("part", part).withColumn("meet", F.explode(meets))
        columns = dealt.select("signature", "meet.block", "meet.side", "root", "key", "n", "own", *bits)
        found = columns.repartition("signature", "block").sortWithinPartitions("signature", "block").mapInArrow(_close(self.percent)(best), "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(node, root) of the linked sets."""
        links = stored(self.verified(self.hubs()), "links")
        roots = stored(components(links), "roots")
        for best in (True, False):
            more = stored(self.verified(self.apart(roots, best)), "more")
            if more.isEmpty():
                continue
            links = stored(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "links")
            roots = stored(components(links), "roots")
        return roots


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, rare: int = RARE, common: int = COMMON, cap: int = CAP, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    join = Join(docs, doc_id, text, size, percent, rare, common, cap, crowd)
    labelled = join.distinct.select("key", "first").join(join.components(), F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(lowest, "root").select("key", "component_id")
    linked = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return join.marks.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))
