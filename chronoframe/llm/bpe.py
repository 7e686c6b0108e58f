"""BPE encoding and decoding with a transducer lexicon for frequent words.

Words are what the tokenizer's pattern cuts from the normalised text; each word is
encoded by itself. The most frequent words of the corpus (counted over all of it, up to
``lexicon_words`` kept, those of one count all or none) are encoded once and compiled into a minimal acyclic
automaton that shares prefixes and suffixes. Its arcs carry outputs whose sum along a
word is the word's number, which leads to its ids. The driver ships the automaton as
one file of flat arrays; tasks map it into memory. Any other word is merged exactly,
lowest rank first, leftmost among equal ranks. The words that a slice of texts brings
anew walk through the automaton together, and the rest of them are merged together, one
pair of each word in a round.

Decoding joins the tokens of the ids by one space, as the tokenizer does when its file
names no decoder.

Defined cases: a null or empty text has no ids and decodes to an empty text; texts of
any length and words of any length are encoded whole; special tokens written out in a
text become their ids; lone surrogates cannot occur in a column of strings. Code points
that are newer than this Python's tables go through the library's own normaliser and
splitter. Ids outside of the vocabulary are skipped in decoding. Existing columns with
the names of new ones are replaced; all other columns are kept.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chronoframe.llm.storage import stored
from chronoframe.llm.text import PIECE, slices

WORD_END = "</w>"
CACHED, COUNTED = 100_000, 200_000  # words that a task remembers: with ids; with counts
# Parts of the pattern that the tokenizer's file states.
CONTRACTIONS, CLASSES = "'s|'t|'re|'ve|'m|'ll|'d|", r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The Latin letters of the two blocks after ASCII: their own NFC, and but for one they stay among themselves in lower case.
LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
BEYOND = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
PART, NONE = (1 << 20) - 1, 1 << 62  # a pair of ids in one integer; no merge
PLACE = (1 << 32) - 1  # under the rank of a pair: where it is
BLOCKS = (8, 16, 32, 100)  # words of so many bytes are merged together; longer ones, rare in any text, one by one


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, and exact merging."""

    def __init__(self, file: bytes) -> None:
        import regex

        spec = json.loads(file)
        model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError("a tokenizer of another make")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            self.merges[self.ids[a] << 20 | self.ids[b]] = rank << 20 | self.ids[a + b]
        letters = byte_letters()
        self.inner = [self.ids.get(x, -1) for x in letters]
        self.final = [self.ids.get(x + WORD_END, -1) for x in letters]
        self.pairs = None
        pattern = splits[0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # The same words, found faster: in texts without an apostrophe, and in those of ASCII and Latin letters alone.
        self.bare = self.plain = None
        if pattern.startswith(CONTRACTIONS):
            self.bare = regex.compile(pattern.removeprefix(CONTRACTIONS))
            if pattern == CONTRACTIONS + CLASSES:
                self.plain = re.compile(f"[{LETTERS}]+|[0-9]|{CONTRACTIONS}[^ \\t-\\r0-9{LETTERS}]+")  # letters first, as most words begin with one
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.rare = regex.compile(r"[^\x00-˿]")
        self.file, self.library = file, None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        return self._merge_long(ids) if len(ids) > 100 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, NONE
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i] = best & PART
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        get, none = self.merges.get, NONE
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(found, i) for i in range(len(ids) - 1) if (found := get(ids[i] << 20 | ids[i + 1], none)) != none]
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j], none) != found:
                continue
            ids[i], ids[j] = found & PART, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (right := get(ids[i] << 20 | ids[k], none)) != none:
                    heapq.heappush(heap, (right, i))
            if (h := before[i]) >= 0 and (left := get(ids[h] << 20 | ids[i], none)) != none:
                heapq.heappush(heap, (left, h))
        return [x for x in ids if x >= 0]

    def _as_arrays(self) -> None:
        """The merges in the order of their pairs, and those of bytes in a table; only tasks that merge need them."""
        pairs, found = (np.fromiter(part, np.int64, len(self.merges)) for part in (self.merges.keys(), self.merges.values()))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], NONE)  # the last pair is none that ids can make
        self.ranks = np.append(found[order] >> 20 << 32, NONE)
        self.merged = np.zeros(int(found.max(initial=0) >> 20) + 1, np.int64)
        self.merged[found >> 20] = found & PART
        self.bytes = np.array([*self.inner, *self.final], np.int64)
        self.first = self._ranks(self.bytes[:256, None], self.bytes)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one word after another, and how many each has."""
        if self.pairs is None:
            self._as_arrays()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, order, parts, least = np.zeros(len(words), np.int64), [], [], 0
        for most in BLOCKS:
            chosen = np.flatnonzero((sizes > least) & (sizes <= most))
            if len(chosen):
                ids, counts[chosen] = self._merge_block(b"".join([words[k] for k in chosen.tolist()]), sizes[chosen])
                order.append(chosen)
                parts.append(ids)
            least = most
        for k in np.flatnonzero(sizes > least).tolist():
            ids = np.array(self.merge(words[k]), np.int64)
            counts[k] = len(ids)
            order.append(np.array([k]))
            parts.append(ids)
        if not order:
            return np.zeros(0, np.int64), counts
        place = np.empty(len(words), np.int64)  # of each word among the parts
        place[np.concatenate(order)] = np.arange(len(words))
        begin = np.concatenate(([0], np.cumsum(counts[np.concatenate(order)])))
        return np.concatenate(parts)[runs(begin, place)[0]], counts

    def _merge_block(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, size = np.cumsum(sizes), len(data)
        first = begin = ends - sizes
        kind = np.frombuffer(data, np.uint8).astype(np.int64)
        kind[ends - 1] += 256
        ids = np.append(self.bytes[kind], -1)  # the last place stands for what is before and after a word
        after, before = np.arange(1, size + 2), np.arange(-1, size)
        after[ends - 1] = before[begin] = size
        found = np.full(size + 1, NONE)
        inner = np.flatnonzero(kind < 256)  # bytes that another of their word follows
        found[inner] = self.first[kind[inner], kind[inner + 1]] | inner
        while len(begin):
            best = np.minimum.reduceat(found, begin)  # a word that is done has no more pairs, so it may follow another's
            more = best < NONE
            begin, best = begin[more], best[more]
            i = best & PLACE
            j, h = after[i], before[i]
            k = after[j]
            ids[i], ids[j], found[j] = self.merged[best >> 32], -1, NONE
            after[i], before[k] = k, i
            found[i] = self._ranks(ids[i], ids[k]) | i
            found[h] = self._ranks(ids[h], ids[i]) | h
        left = ids[:size] >= 0
        return ids[:size][left], np.add.reduceat(left, first, dtype=np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, above the room for a place, or ``NONE``."""
        pair = a << 20 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], NONE)

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.cut is None or "<" not in text and all("<" in s for s in self.special):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self._plain(part) if part else []
        return out

    def _plain(self, text: str) -> list[str]:
        if self.plain is not None and (text.isascii() or not BEYOND.search(text)):
            return self.plain.findall(text.lower())
        find = self.pattern.findall if self.bare is None or "'" in text else self.bare.findall
        if text.isascii():
            return find(text.lower())
        if self.rare.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._by_library(text)
        # Lower case is by code point: a final sigma is like any other.
        return find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file.decode())
            self.letters = {c: b for b, c in enumerate(byte_letters())}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in part).decode("utf-8", "surrogateescape") for part, _ in parts]


def runs(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some rows, where each row's begin at ``begin``; and where each row ends in them."""
    sizes = begin[rows + 1] - begin[rows]
    ends = np.cumsum(sizes)
    return np.repeat(begin[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), ends


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer over sorted distinct words, as flat arrays.

    Words are added in order; states that no later word can change are merged with an
    equal one that exists (Daciuk et al., 2000).
    """
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states: final, and arcs as (label, node)
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    for word, _ in entries:
        if word <= last and last:
            raise ValueError("words must be sorted and distinct")
        common = len(os.path.commonprefix([word, last]))
        close(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0)
    root = len(nodes)
    nodes.append((path[0][0], tuple(path[0][1])))
    below = []  # words that end at or below each state; targets come before sources
    for final, arcs in nodes:
        below.append(int(final) + sum(below[t] for _, t in arcs))
    first, label, target, output = [0], [], [], []
    for final, arcs in nodes:
        passed = int(final)
        for c, t in arcs:
            label.append(c)
            target.append(t)
            output.append(passed)
            passed += below[t]
        first.append(len(label))
    start = np.cumsum([0, *[len(ids) for _, ids in entries]])
    arrays = [
        np.array(first, np.uint32), np.array(target, np.uint32), np.array(output, np.uint32), start.astype(np.uint32),
        np.array([i for _, ids in entries for i in ids], np.uint32), np.array(label, np.uint8), np.array([f for f, _ in nodes], np.uint8),
    ]
    return struct.pack("<8Q", root, *[a.nbytes for a in arrays]) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Looks words up in a compiled lexicon that is mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack("<8Q", self.map[:64])
        at, parts = 64, []
        for k, size in enumerate(sizes):
            kind = np.dtype(np.uint32 if k < 5 else np.uint8)
            parts.append(np.frombuffer(self.map, kind, size // kind.itemsize, at))
            at += size
        first, self.target, self.output, self.start, self.ids, label, self.final = parts
        # Labels rise within a state, so arcs are in the order of their states and labels.
        self.arcs = np.append(np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | label, NONE)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not in the lexicon."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        node, number, depth = np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        alive = np.arange(len(words))
        while len(alive := alive[sizes[alive] > depth]):
            arc = node[alive] << 8 | data[begin[alive] + depth]
            at = np.searchsorted(self.arcs, arc)
            there = self.arcs[at] == arc
            node[alive[~there]] = -1
            alive, at, depth = alive[there], at[there], depth + 1
            node[alive] = self.target[at]
            number[alive] += self.output[at]
        return np.where((node >= 0) & (self.final[node] > 0), number, -1)

    def find(self, word: bytes) -> list[int] | None:
        number = int(self.numbers([word])[0])
        return None if number < 0 else self.ids[self.start[number] : self.start[number + 1]].tolist()


class Encoder:
    """Ids of words; those seen last, and those of the lexicon, are kept as rows of one array."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.number: dict[str, int] = {}
        self.flat, self.begin, self.frequent = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        """All words but those of the lexicon, and these too if they are many."""
        rows = np.flatnonzero(self.frequent) if self.frequent.sum() <= CACHED // 2 else np.zeros(0, np.int64)
        place = dict(zip(rows.tolist(), range(len(rows))))
        self.number = {word: place[n] for word, n in self.number.items() if n in place}
        at, ends = runs(self.begin, rows)
        self.flat, self.begin, self.frequent = self.flat[at], np.append(0, ends), self.frequent[rows]

    def add(self, words: list[str]) -> None:
        """Take in distinct words that are not known."""
        data = [word.encode("utf-8", "surrogateescape") for word in words]
        numbers = self.lexicon.numbers(data) if self.lexicon else np.full(len(words), -1)
        special = [k for k, word in enumerate(words) if word in self.vocabulary.special]
        numbers[special] = -1
        listed = np.flatnonzero(numbers >= 0)
        other = np.setdiff1d(np.flatnonzero(numbers < 0), special)
        at, ends = runs(self.lexicon.start.astype(np.int64), numbers[listed]) if len(listed) else (listed, listed)
        merged, counts = self.vocabulary.merge_all([data[k] for k in other.tolist()])
        ids = [self.lexicon.ids[at]] if len(listed) else []
        ids += [merged, [self.vocabulary.special[words[k]] for k in special]]
        sizes = np.concatenate((np.diff(ends, prepend=0), counts, np.ones(len(special), np.int64)))
        for n, k in enumerate((*listed.tolist(), *other.tolist(), *special), len(self.number)):
            self.number[words[k]] = n
        self.flat = np.concatenate((self.flat, *ids)).astype(np.int32)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
        self.frequent = np.append(self.frequent, np.arange(len(words)) < len(listed))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and where each text's begin and the last one's end."""
        if len(self.number) > CACHED:
            self.forget()
        words, ends = [], [0]
        for text in texts:
            words += self.vocabulary.words(text) if text else ()
            ends.append(len(words))
        rows = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unknown = [words[k] for k in new.tolist()]
            self.add(list(dict.fromkeys(unknown)))
            rows[new] = [self.number[word] for word in unknown]
        at, last = runs(self.begin, rows)
        return self.flat[at], np.append(0, last)[ends]


def word_counts(docs: DataFrame, file: bytes, text: str = "text") -> DataFrame:
    """(word, n) over the whole corpus; summed in tasks before the shuffle."""

    def run(batches):
        from collections import Counter

        vocabulary, seen = Vocabulary(file), Counter()
        for batch in batches:
            for one in (value.as_py() for value in batch.column(0)):
                seen.update(vocabulary.words(one) if one else ())
                if len(seen) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, file: bytes, text: str = "text", lexicon_words: int = 32_768) -> str:
    """Compile the ``lexicon_words`` most frequent words and ship the file; gives its name."""
    vocabulary = Vocabulary(file)
    # The counts above which words number fewer than that; so the driver gets no list from every task.
    counts = stored(word_counts(docs, file, text).where("n > 1"), "words")
    frequent, least = 0, None
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(lexicon_words).collect():
        frequent += row["words"]
        if frequent > lexicon_words:
            break
        least = row["n"]
    top = counts.where(F.col("n") >= least).select("word").collect() if least else []
    words = sorted(r["word"].encode() for r in top if r["word"] not in vocabulary.special)
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(path, "wb") as out:
        out.write(compile_lexicon([(w, vocabulary.merge(w)) for w in words]))
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, file: bytes, lexicon: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an array."""
    kept = [f for f in docs.schema.fields if f.name != ids]

    def run(batches):
        encoder = Encoder(Vocabulary(file), Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            for part in slices(batch, PIECE // 2):  # all words of a slice are held at once
                values, ends = encoder.encode(part.column(0).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], column], names=[*part.schema.names[1:], ids])

    out = StructType([*kept, StructField(ids, ArrayType(IntegerType()))])
    return docs.select(F.col(text).alias("__text"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, out)


def decode(docs: DataFrame, file: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids of each row; null ids give an empty text."""
    kept = [f for f in docs.schema.fields if f.name != decoded]
    tokens = Vocabulary(file).tokens  # all that tasks need of it

    def run(batches):
        known, spelled = np.array([bool(t) for t in tokens]), pa.array(tokens, pa.string())
        for batch in batches:
            for part in slices(batch):
                lists = part.column(0)
                rows = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
                values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                good = (values >= 0) & (values < len(known))
                good[good] = known[values[good]]
                ends = np.concatenate(([0], np.cumsum(good)))[np.concatenate(([0], np.cumsum(rows)))]
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled.take(pa.array(values[good])))
                texts = pc.binary_join(words, " ")
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts], names=[*part.schema.names[1:], decoded])

    out = StructType([*kept, StructField(decoded, StringType())])
    return docs.select(F.col(ids).alias("__ids"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, out)
