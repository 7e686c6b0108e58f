"""Helpers that run inside tasks: texts as bytes, words, and hashes of words.

Work goes through numpy in pieces of about a megabyte, so memory does not
follow the size of an Arrow batch or of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    begin = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), begin


def word_bytes() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all of non-ASCII."""
    table = np.zeros(256, bool)
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(low) : ord(high) + 1] = True
    table[128:] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Finds and hashes the words of many texts at once.

    With ``prefixes``, hashes have a row for the whole word and one for its first k bytes, for each k.
    """

    def __init__(self, prefixes: tuple[int, ...] = ()) -> None:
        self.prefixes = prefixes
        self.table = word_bytes()
        self.up = powers(BASE, PIECE + 1)
        self.down = powers(pow(BASE, -1, 1 << 64), PIECE + 1)

    def piece(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word; no word crosses a border."""
        inside = self.table[data]
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros((1 + len(self.prefixes), 0) if self.prefixes else 0, np.uint64)
        cut = np.zeros(len(data) + 1, bool)
        cut[borders] = True
        cut[[0, -1]] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        down = self.down[begins]
        hashes = mix((total[ends] - total[begins]) * down)
        if self.prefixes:
            heads = [mix((total[np.minimum(begins + k, ends)] - total[begins]) * down + np.uint64(k)) for k in self.prefixes]
            hashes = np.stack([hashes, *heads])
        return begins, ends, hashes

    def groups(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, past the last, where each text's words begin, starts, ends, hashes), group by group.

        Every text is whole in its group; a word of over a megabyte counts as several.
        """
        first, texts = 0, len(offsets) - 1
        while first < texts:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
            low, high = int(offsets[first]), int(offsets[last])
            found, at = [], low
            while at < high:
                end = min(high, at + PIECE)
                if end < high:
                    outside = np.flatnonzero(~self.table[data[at:end]])
                    end = at + int(outside[-1]) + 1 if len(outside) else end
                borders = offsets[first:last] - at
                starts, ends, hashes = self.piece(data[at:end], borders[(borders >= 0) & (borders < end - at)])
                found.append((starts + at, ends + at, hashes))
                at = end
            if not found:
                found = [self.piece(np.zeros(0, np.uint8), np.zeros(0, np.int64))]
            starts, ends, hashes = (x[0] if len(found) == 1 else np.concatenate(x, axis=-1) for x in zip(*found))
            yield first, last, np.searchsorted(starts, offsets[first : last + 1]), starts, ends, hashes
            first = last


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out * np.uint64(BASE)) + words[k : k + n]
    return mix(out)


def slices(batch: pa.RecordBatch, size: int = PIECE):
    """Parts of a batch of about so many bytes, one row at least."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    return (batch.slice(k, step) for k in range(0, batch.num_rows, step))
