"""Token ids packed into rows of fixed length, best fit first.

A document's ids are cut into pieces of at most ``length``; nothing is dropped, and each
piece knows its document and its offset in it. Pieces are taken by decreasing length, each
into the row with the least room that suffices (Ding et al., 2024); a segment tree over
the room left finds it in log(length) steps. Packing goes on within shards of about
``shard_tokens`` ids, of which a task holds one at a time.

A row has the ids as little-endian integers of fixed width, filled up with ``pad``; the
cumulative lengths of its segments, from 0 on; the places where positions start again;
and for each segment the document and the offset.

Defined cases: a null or empty text gives no segment; every other document ends with the
end id; ids of documents may be null; repeated rows are packed each; an empty table gives
no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, SHARD_TOKENS = 2048, 1 << 21
END_ID = 50_256  # free in the vocabulary of ranks
CHARS = 1 << 20


class Room:
    """A segment tree over the room left in rows: the least room of at least so much that some row has."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.tree[i] += n
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row), no longer in the tree."""
        i = self.leaves + least
        while not self.tree[i]:  # up until a subtree to the right has a row, then down to its first leaf
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of pieces; by decreasing size, equal sizes in the given order."""
    rooms, rows = Room(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[piece])
        if found is None:
            rows.append([piece])
            left, row = length - sizes[piece], len(rows) - 1
        else:
            row = found[1]
            rows[row].append(piece)
            left = found[0] - sizes[piece]
        if left:
            rooms.put(left, row)
    return rows


def tokens_of(encoding, text: str) -> np.ndarray:
    """Ids of a whole text; a long one is read in pieces that end before a space which follows a letter."""
    import regex

    parts, at = [], 0
    border = regex.compile(r"(?<=\p{L})(?= \p{L})")
    while at < len(text):
        end = len(text)
        if end - at > CHARS and (found := border.search(text, at + CHARS)):
            end = found.start()
        parts.append(np.array(encoding.encode_ordinary(text[at:end]), np.int64))
        at = end
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def pack(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, pad: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of packed ids: shard, row, n_tokens, ids, cu_seqlens, resets, doc_ids, offsets."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary
    schema = [("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", None), ("offsets", pa.list_(pa.int64()))]

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        width = np.dtype("<u2") if max(end_id, pad, len(table)) < 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        held = shard = 0

        def send(kind: pa.DataType):
            rows = best_fit([len(p[2]) for p in pieces], length)
            for low in range(0, len(rows), 256):
                some = rows[low : low + 256]
                matrix = np.full((len(some), length), pad, width)
                ends = []
                for k, row in enumerate(some):
                    joined = np.concatenate([pieces[i][2] for i in row])
                    matrix[k, : len(joined)] = joined
                    ends.append(np.cumsum([0, *[len(pieces[i][2]) for i in row]]))
                columns = [
                    [part + shard] * len(some), range(low, low + len(some)), [int(e[-1]) for e in ends], [m.tobytes() for m in matrix], ends,
                    [e[:-1] for e in ends], [[pieces[i][0] for i in row] for row in some], [[pieces[i][1] for i in row] for row in some],
                ]
                types = [t if t is not None else pa.list_(kind) for _, t in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in schema])

        for batch in batches:
            type_ = batch.column(0).type
            for doc, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (value := one.as_py()):
                    continue
                ids = np.append(tokens_of(encoding, value), end_id)
                for at in range(0, len(ids), length):
                    pieces.append((doc, at, ids[at : at + length].astype(width)))
                    held += len(pieces[-1][2])
                    if held >= shard_tokens:
                        yield from send(type_)
                        pieces, held, shard = [], 0, shard + 1
        if pieces:
            yield from send(type_)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, offsets array<long>")


def positions(resets: list[int], n_tokens: int, length: int) -> np.ndarray:
    """Position of each place in its segment; 0 in the padding."""
    starts = np.zeros(length, np.int64)
    starts[np.asarray(resets)] = resets
    out = np.arange(length) - np.maximum.accumulate(starts)
    out[n_tokens:] = 0
    return out
