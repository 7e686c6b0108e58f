"""Removal of repeated byte strings by suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that starts anywhere else
too. The work is to find the windows of that length that occur twice.

1. Every window has an anchor: the run of ``gram`` bytes in it with the smallest hash,
   the leftmost of equals. Equal windows have equal anchors at equal places, so they
   meet under the anchor's bytes. One anchor serves about (length - gram) / 2 windows.
2. Anchors are brought together by those bytes. Where the stretch of text that an anchor
   serves is equal as a whole, all of its windows are repeats, and one copy stands for
   all. What remains are anchors that agree while their stretches differ.
3. Those stretches are fetched and suffix-sorted in two stages: suffixes smaller than
   their successors are sorted directly (to ``length`` bytes), the others follow from
   scans over the buckets of first bytes. Neighbours with a common prefix of ``length``
   bytes are repeated windows.

Copies within a batch collapse before the shuffle. An anchor that more than ``hot``
stretches share is dealt out by stretch, and its windows are counted one by one under a
128-bit hash instead, with sums before the shuffle; which anchors those are is estimated
from a sample of the anchors, which decides on the way only, not on the result.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; rows
with equal id and text are documents of their own and lose all windows; ids may be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from chronoframe.llm.storage import stored
from chronoframe.llm.text import BASE, mix, powers

LENGTH, GRAM = 200, 32
PIECE = 1 << 20
SORTED_BYTES = 1 << 20
WIDE = 17  # bits below the start in a packed stretch: anchor's place 8, windows 8, doubled 1


# --- anchors ---------------------------------------------------------------------------


class Anchors:
    """The anchors of a text: place, first window, number of windows."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        self.up = powers(BASE, PIECE + length + 1)
        self.down = powers(pow(BASE, -1, 1 << 64), PIECE + length + 1)

    def _minima(self, data: np.ndarray) -> np.ndarray:
        n, width = len(data), self.length - self.gram + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        grams = n - self.gram + 1
        key = mix((total[self.gram :] - total[:grams]) * self.down[:grams])
        key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        rest = width - step
        return ((np.minimum(key[: len(key) - rest], key[rest:]) if rest else key) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = len(data) - self.length + 1
        if windows <= 0:
            return (np.zeros(0, np.int64),) * 3
        found, starts = [], []
        for low in range(0, windows, PIECE):
            high = min(windows, low + PIECE)
            at = self._minima(data[low : high + self.length - 1]) + low
            new = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
            found.append(at[new])
            starts.append(new + low)
        at, start = np.concatenate(found), np.concatenate(starts)
        keep = np.concatenate(([True], at[1:] != at[:-1]))  # a stretch may cross the border of two pieces
        at, start = at[keep], start[keep]
        return at, start, np.diff(np.concatenate((start, [windows])))


ANCHOR = "kind int, dk long, th long, gram long, stretch long, packed long"


def _anchor_rows(length: int, gram: int):
    schema = pa.schema([("kind", pa.int32()), ("dk", pa.int64()), ("th", pa.int64()), ("gram", pa.int64()), ("stretch", pa.int64()), ("packed", pa.int64())])

    def collapse(parts: list[tuple]) -> pa.RecordBatch:
        dk, th, grams, stretches, packed = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((stretches, grams))
        dk, th, grams, stretches, packed = (x[order] for x in (dk, th, grams, stretches, packed))
        same = (grams[1:] == grams[:-1]) & (stretches[1:] == stretches[:-1])
        after, before = np.concatenate((same, [False])), np.concatenate(([False], same))
        packed = packed | (after & ~before)  # the first of several is marked as doubled
        return pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(dk), pa.array(th), pa.array(grams), pa.array(stretches), pa.array(packed)], schema=schema)

    def run(batches):
        from xxhash import xxh3_64_intdigest as digest

        anchors = Anchors(length, gram)
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, value in enumerate(batch.column(2)):
                buffer = value.as_buffer()
                if buffer is None or buffer.size < length:
                    continue
                view = memoryview(buffer)
                at, start, count = anchors.of(np.frombuffer(buffer, np.uint8))
                a, s, e = at.tolist(), start.tolist(), (start + count + length - 1).tolist()
                grams = np.array([digest(view[x : x + gram]) for x in a], np.uint64).view(np.int64)
                stretches = np.array([digest(view[x:y]) for x, y in zip(s, e)], np.uint64).view(np.int64)
                packed = (start << WIDE) | ((at - start) << 9) | (count << 1)
                parts.append((np.full(len(at), ids[k]), np.full(len(at), marks[k], np.int64), grams, stretches, packed))
                held += len(at)
                if held > 400_000:
                    yield collapse(parts)
                    parts, held = [], 0
        if parts:
            yield collapse(parts)

    return run


# --- anchors that agree ----------------------------------------------------------------

AGREED = "kind int, dk long, th long, gram long, packed long"


def _agreed(batches):
    """Over rows sorted by (gram, stretch): kind 1 for stretches that occur twice, kind 0 for one of each stretch of a
    gram with several; of those the doubled bit says that all of its windows are known to be repeats."""

    schema = pa.schema([("kind", pa.int32()), ("dk", pa.int64()), ("th", pa.int64()), ("gram", pa.int64()), ("packed", pa.int64())])

    def finish(rows: list[np.ndarray]) -> pa.RecordBatch:
        hot, dk, th, gram, stretch, packed = np.concatenate(rows, axis=1)
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])))
        number = np.cumsum(new) - 1
        total = np.bincount(number, 1 + (packed & 1)).astype(np.int64)
        first = np.flatnonzero(new)
        group = np.concatenate(([0], np.cumsum(gram[first][1:] != gram[first][:-1]))) if len(first) else first
        several = np.bincount(group)[group] > 1 if len(first) else first
        repeated = total[number] > 1
        picked = first[several | (hot[first] > 0)]
        packed = packed & ~np.int64(1)
        rows_out = np.concatenate((np.flatnonzero(repeated), picked))
        kind = np.concatenate((np.ones(int(repeated.sum()), np.int32), np.where(hot[picked] > 0, 2, 0).astype(np.int32)))
        packed = packed[rows_out] | np.where(kind == 1, 0, repeated[rows_out])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(dk[rows_out]), pa.array(th[rows_out]), pa.array(gram[rows_out]), pa.array(packed)], schema=schema)

    kept: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
        if not rows.shape[1]:
            continue
        other = np.flatnonzero(rows[3] != rows[3, -1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (kept and kept[-1][3, -1] != rows[3, 0]):
            yield finish([*kept, rows[:, :cut]])
            kept = []
        kept.append(rows[:, cut:])
    if kept:
        yield finish(kept)


# --- suffix sorting --------------------------------------------------------------------


def words_at(data: np.ndarray, room: int) -> np.ndarray:
    """Eight bytes from each place on as an integer that sorts like them; zeros follow the text."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(room + 8, np.uint8)))
    out = np.zeros(n + room, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + n + room]
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix after them; the last is not."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    rising = np.zeros(len(change) + 1, bool)
    rising[:-1] = data[change + 1] > data[change]
    return rising[np.searchsorted(change, np.arange(n))]


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes."""
    places = places[np.argsort(words[places], kind="stable")]
    key = words[places]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(places) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        alone = new & np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        some, key = places[tied], words[places[tied] + d]
        order = np.lexsort((key, group))
        places[tied] = some[order]
        key = key[order]
        new[tied[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return places


def suffix_order(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in the order of (at least) their first ``depth`` bytes, in two stages."""
    n = len(data)
    words = words_at(data, depth) if words is None else words
    direct = smaller_than_successor(data)
    sizes = np.bincount(data, minlength=256)
    ends = np.cumsum(sizes)
    front = ends - sizes
    order = np.full(n, -1, np.int64)
    chosen = sort_directly(np.flatnonzero(direct), words, depth)
    tail = np.bincount(data[chosen], minlength=256)
    first_direct = ends - tail
    at = np.cumsum(tail) - tail
    order[np.repeat(first_direct - at, tail) + np.arange(len(chosen))] = chosen
    order[front[data[-1]]] = n - 1  # larger than the empty suffix after it
    begin = front.copy()
    front[data[-1]] += 1
    for c in np.flatnonzero(sizes):
        low = begin[c]
        while low < front[c]:  # runs of one byte induce within their own bucket
            before = order[low : front[c]] - 1
            low = front[c]
            before = before[before >= 0]
            before = before[(data[before] == c) & ~direct[before]]
            order[low : low + len(before)] = before
            front[c] += len(before)
        before = order[begin[c] : ends[c]] - 1
        before = before[before >= 0]
        value = data[before]
        before, value = before[value > c], value[value > c]
        before = before[np.argsort(value, kind="stable")]
        count = np.bincount(value, minlength=256)
        at = np.cumsum(count) - count
        order[np.repeat(front - at, count) + np.arange(len(before))] = before
        front += count
    return order


def adjacent_prefixes(order: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the next one in order, up to ``limit`` bytes."""
    common = np.zeros(max(0, len(order) - 1), np.int64)
    open_ = np.arange(len(common))
    for d in range(0, limit, 8):
        if not len(open_):
            break
        differ = words[order[open_] + d] ^ words[order[open_ + 1] + d]
        equal = differ == 0
        head = differ[~equal]
        high = np.zeros(len(head), np.int64)
        for k in range(7):
            high += head < (np.uint64(1) << np.uint64(56 - 8 * k))
        common[open_[~equal]] = d + high
        open_ = open_[equal]
        common[open_] = d + 8
    return np.minimum(common, limit)


def repeated_windows(stretches: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """For each window of each stretch in turn, whether it occurs twice among them all."""
    data = np.frombuffer(b"".join(stretches), np.uint8)
    counts = np.asarray(counts, np.int64)
    begin = np.cumsum([0, *map(len, stretches)])[:-1]
    ends = np.cumsum(counts)
    starts = np.repeat(begin - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
    words = words_at(data, length)
    if 8 * len(starts) < len(data):  # too few suffixes matter for induction to pay
        order = sort_directly(starts.copy(), words, length)
    else:
        is_start = np.zeros(len(data), bool)
        is_start[starts] = True
        order = suffix_order(data, length, words)
        order = order[is_start[order]]
    same = adjacent_prefixes(order, words, length) >= length
    twice = np.zeros(len(data), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return twice[starts]


# --- fetching and settling what differs ------------------------------------------------


def _fetch(length: int):
    """Stretches of text for the open anchors of each document; kind 2 gives windows under a hash instead."""

    schema = pa.schema([("gram", pa.int64()), ("other", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("packed", pa.int64()), ("body", pa.binary())])

    def run(batches):
        from xxhash import xxh3_128_intdigest as digest

        for batch in batches:
            out: list[tuple] = []
            held = 0
            for dk, th, text, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                view = memoryview(text.as_buffer())
                for one in stretches.as_py():
                    packed = one["packed"]
                    start, count = packed >> WIDE, (packed >> 1) & 255
                    if one["kind"] == 2:
                        for w in range(start, start + count):
                            h = digest(view[w : w + length])
                            out.append((h >> 64, h & ((1 << 64) - 1), dk, th, (w << WIDE) | (1 << 1) | (packed & 1), None))
                    else:
                        out.append((one["gram"], 0, dk, th, packed, bytes(view[start : start + count + length - 1])))
                    held += count + length
                if held > 4 << 20:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        gram, other, dk, th, packed, body = zip(*out)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        return pa.RecordBatch.from_arrays([pa.array(map(signed, gram), pa.int64()), pa.array(map(signed, other), pa.int64()), pa.array(dk, pa.int64()), pa.array(th, pa.int64()), pa.array(packed, pa.int64()), pa.array(body, pa.binary())], schema=schema)

    return run


FETCHED = "gram long, other long, dk long, th long, packed long, body binary"
SPAN = "dk long, th long, start long, windows long"


def _settle(length: int):
    """Over stretches sorted by gram: runs of repeated windows in those that are not known yet."""

    schema = pa.schema([("dk", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])

    def judge(rows: list[tuple]) -> list[tuple[int, np.ndarray]]:
        """(row, which of its windows are repeated)."""
        bodies, counts = [r[4] for r in rows], np.array([(r[3] >> 1) & 255 for r in rows])
        if sum(map(len, bodies)) <= 2 * SORTED_BYTES:
            return list(enumerate(np.split(repeated_windows(bodies, counts, length), np.cumsum(counts)[:-1])))
        # One gram with very many stretches: windows meet at one distance from the anchor only, so take some distances at a time.
        place = np.array([(r[3] >> 9) & 255 for r in rows])
        width = max(1, 2 * SORTED_BYTES // len(rows) - length)
        out = [np.zeros(c, bool) for c in counts]
        for near in range(0, int(place.max()) + 1, width):
            first, past = np.maximum(0, place - near - width + 1), np.minimum(counts, place - near + 1)
            some = np.flatnonzero(past > first)
            if len(some):
                parts = [bodies[i][first[i] : past[i] + length - 1] for i in some]
                sizes = (past - first)[some]
                for i, flags in zip(some, np.split(repeated_windows(parts, sizes, length), np.cumsum(sizes)[:-1])):
                    out[i][first[i] : past[i]] = flags
        return list(enumerate(out))

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        spans: list[tuple] = []
        for i, flags in judge(rows):
            gram, dk, th, packed, _ = rows[i]
            if packed & 1 or not flags.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            spans += [(dk, th, (packed >> WIDE) + int(a), int(b - a)) for a, b in edge.reshape(-1, 2)]
        columns = zip(*spans) if spans else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held >= SORTED_BYTES and row[0] != rows[-1][0]:
                    yield finish(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield finish(rows)

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 40_000) -> DataFrame:
    """(dk, th, start, windows): runs of repeated windows of the texts of (dk, th, data)."""
    spark = keyed.sparkSession
    anchors = stored(keyed.mapInArrow(_anchor_rows(length, gram), ANCHOR), "anchors")
    share = 16
    busy = (
        anchors.where("kind = 0").select("gram").sample(1 / share, seed=1).groupBy("gram").count()
        .where(F.col("count") > hot / share).orderBy(F.desc("count")).limit(10_000).select("gram", F.lit(1).alias("hot"))
    )
    busy = F.broadcast(spark.createDataFrame(busy.collect(), "gram long, hot int"))
    dealt = anchors.where("kind = 0").join(busy, "gram", "left").select(F.coalesce("hot", F.lit(0)).alias("hot"), "dk", "th", "gram", "stretch", "packed")
    route = F.when(F.col("hot") > 0, F.xxhash64("gram", "stretch")).otherwise(F.xxhash64("gram"))
    agreed = stored(dealt.repartition(route).sortWithinPartitions("gram", "stretch").mapInArrow(_agreed, AGREED), "agreed")

    open_ = agreed.where("kind <> 1").groupBy("dk", "th").agg(F.collect_list(F.struct("kind", "gram", "packed")).alias("stretches"))
    fetched = stored(keyed.join(open_, ["dk", "th"]).select("dk", "th", "data", "stretches").mapInArrow(_fetch(length), FETCHED), "stretches")
    bodies = fetched.where("body IS NOT NULL").select("gram", "dk", "th", "packed", "body")
    settled = bodies.repartition("gram").sortWithinPartitions("gram").mapInArrow(_settle(length), SPAN)
    windows = fetched.where("body IS NULL")
    twice = windows.groupBy("gram", "other").agg(F.count(F.lit(1)).alias("n"), ).where("n > 1").select("gram", "other")
    single = windows.where(F.col("packed").bitwiseAND(1) == 0).join(twice, ["gram", "other"], "left_semi")

    start = F.shiftright("packed", WIDE).alias("start")
    count = F.shiftright("packed", 1).bitwiseAND(255).alias("windows")
    known = anchors.where((F.col("kind") == 1) | (F.col("packed").bitwiseAND(1) == 1)).select("dk", "th", start, count)
    return known.unionByName(agreed.where("kind = 1").select("dk", "th", start, count)).unionByName(single.select("dk", "th", start, count)).unionByName(settled)


def _remove(length: int, schema: pa.Schema, as_text: bool):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            low, held = 0, 0
            for row, (text, spans) in enumerate(zip(batch.column(0), batch.column(1))):
                data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                kept, runs = data, []
                if spans.is_valid:
                    values = spans.values
                    start = values.field("start").to_numpy()
                    order = np.argsort(start, kind="stable")
                    start = start[order]
                    end = np.maximum.accumulate(start + values.field("windows").to_numpy()[order] + length - 1)
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                    runs = list(zip(start[new].tolist(), end[np.concatenate((new[1:], [len(end)])) - 1].tolist()))
                    view, at, parts = memoryview(data), 0, []
                    for a, b in runs:
                        parts.append(view[at:a])
                        at = b
                    kept = b"".join([*parts, view[at:]])
                out[0].append([{"start": a, "end": b} for a, b in runs])
                kept = kept.to_pybytes() if isinstance(kept, pa.Buffer) else kept
                out[1].append(kept.decode("utf-8", "ignore") if as_text else kept)
                out[2].append(data.size)
                held += data.size
                if held > 4 << 20:
                    yield done(batch.slice(low, row + 1 - low), out)
                    out, low, held = [[], [], [], []], row + 1, 0
            if out[0]:
                yield done(batch.slice(low), out)

    def done(part: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
        made = [pa.array(out[0], schema.field(0).type), pa.array(out[1], schema.field(1).type), pa.array(out[2], pa.int64())]
        return pa.RecordBatch.from_arrays([*part.columns[2:], *made], names=[*part.schema.names[2:], *schema.names])

    return run


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = 40_000, as_text: bool = False) -> DataFrame:
    """``docs`` with ``removed_spans`` (maximal runs, byte offsets), ``kept`` (the bytes left) and ``text_bytes``.

    With ``as_text``, ``kept`` is a string, without the parts of characters that were cut apart.

    Existing columns of these names are replaced; all others are kept.
    """
    made = ("removed_spans", "kept", "text_bytes")
    rest = [c for c in docs.columns if c not in made]
    number = docs.schema[doc_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")) if number else F.xxhash64(doc_id)
    keys = {"dk": key, "th": F.xxhash64(doc_id, text), "data": F.coalesce(F.col(text).cast("binary"), F.lit(b""))}
    keyed = docs.select(*[v.alias(k) for k, v in keys.items()])
    spans = repeated_spans(keyed, length, gram, hot).groupBy("dk", "th").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    # What is carried along goes as one column, so that its names meet none of these.
    carried = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("carried")
    whole = docs.select(keys["dk"].alias("own_dk"), keys["th"].alias("own_th"), keys["data"].alias("own_data"), carried)
    joined = whole.join(spans, (F.col("own_dk") == F.col("dk")) & (F.col("own_th") == F.col("th")), "left").select("own_data", "spans", "carried")
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("removed_spans", run), ("kept", pa.string() if as_text else pa.binary()), ("text_bytes", pa.int64())])
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    out = StructType([whole.schema["carried"], StructField("removed_spans", ArrayType(span)), StructField("kept", StringType() if as_text else BinaryType()), StructField("text_bytes", LongType())])
    return joined.mapInArrow(_remove(length, schema, as_text), out).select("carried.*", *made)
