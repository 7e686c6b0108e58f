"""How far the sources of a language differ in their words: every pair of sources, and the words that stand out.

1. Words are counted per (lang, source, term) in the tasks that read the texts. One shuffle by
   (lang, term) then brings all counts of a word together: they are added up, and the words of at
   least ``least_docs`` documents of the language are kept.
2. A kept term has one *level* per source, its count there. Think of a matrix with a row a
   term and an indicator column a (source, level). Its transpose times itself counts, for two
   sources and two levels, the terms on both: the joint table of each pair of sources. The
   product is made of integers, in blocks of terms of one language (rows) and runs of entries
   (columns), and the blocks' tables are added up. A term's levels above zero alone are multiplied; what
   meets a level of zero follows from the margins, which are the diagonal of the product.
3. A joint table has everything a divergence needs: each cell is priced once and weighted by
   its terms. The level decides the smoothed probability of a term within a source.

Arithmetic is exact: p = 1 + floor(scale * (count + 1) / (N + V)), with N the source's count of
kept terms and V their number, and f(p, q) = floor((p - q) * (p - q) / q).

Defined cases: null texts, languages and sources are ''; a source without any kept term still
takes part, with zeros; with V = 0 the value of a pair is 0; repeated rows are documents of
their own; ids are not used; other columns are ignored; an empty table gives no rows. A term is
a run of ASCII letters and non-ASCII characters; A-Z alone are lower-cased.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored

SCALE = 1_000_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Bytes from 0x80 on belong to non-ASCII characters only, so bytes and characters give the same runs.
RUN = re.compile(rb"[a-z\x80-\xff]+")
GAP = re.compile(rb"[^a-zA-Z\x80-\xff]")
# The byte of a term that each byte gives, 0 for those of gaps.
FOLD = np.array([b if RUN.match(bytes([b])) else 0 for b in LOWER], np.uint8)
PIECE = 1 << 20
SLICE = 1 << 22  # bytes of texts that are counted together
HELD = 500_000  # counts in a task before they are sent on, and texts of a slice
SENT = 1 << 16  # counts of a batch
WIDE = 9_000_000_000  # counts from here on are scaled in decimals
BLOCK_CELLS = 1 << 17  # cells of a block of terms, about
PRODUCTS = 1 << 21  # entries of a product at once
DEALT = 32  # parts of a language in joins by language
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
JOINT = pa.schema([("lang", pa.string()), ("a", pa.string()), ("an", pa.int64()), ("b", pa.string()), ("bn", pa.int64()), ("terms", pa.int64())])


def words_of(data: bytes) -> Counter:
    """Occurrences of each term of one text, a megabyte at a time."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        found.update(RUN.findall(data[at:end].translate(LOWER)))
        at = end
    return found


def _tally(group: np.ndarray, texts: pa.LargeBinaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts without nulls, and for each (group, term): number of the group, place of the term, n, docs."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = data != 0
    # A term begins and ends where a gap does, and never runs on into the next text.
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = at[:-1] < at[1:]
    for edges, places in ((begins, at[:-1][filled]), (ends, at[1:][filled] - 1)):
        edges[places] = inside[places]
    first = np.flatnonzero(begins)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) + 1 - first)))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    term, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, at)))
    cell, n = np.unique(group[doc] * size + term, return_counts=True)
    seen, _ = np.unique(doc * size + term, return_counts=True)
    doc, term = np.divmod(seen, size)
    _, docs = np.unique(group[doc] * size + term, return_counts=True)
    return words.dictionary, cell // size, cell % size, n, docs


def _count(batches):
    """(lang, source, term, n, docs) of runs of texts."""
    held: list[pa.Table] = []
    rows = 0

    def added() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTED.names)

    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        texts = pc.fill_null(batch.column(2), b"").cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        low = 0
        while low < len(texts):
            high = max(low + 1, min(low + HELD, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1))
            if at[high] - at[low] <= SLICE:
                terms, of, term, n, docs = _tally(group[low:high], texts[low:high])
            else:
                words = words_of(texts[low].as_buffer().to_pybytes())
                terms, term, n = pa.array(list(words), pa.large_binary()), np.arange(len(words)), np.array(list(words.values()), np.int64)
                of, docs = np.full(len(words), group[low]), np.ones(len(words), np.int64)
            named = [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary)))]
            columns = [*named, terms.cast(pa.binary()).cast(pa.string()).take(pa.array(term)), pa.array(n), pa.array(docs)]
            held.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, COUNTED)], schema=COUNTED))
            rows += len(term)
            low = high
            if rows > HELD:
                held = [added()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held[0].to_batches(SENT)
                    held, rows = [], 0
    if rows:
        yield from (added() if len(held) > 1 else held[0]).to_batches(SENT)


def _products(products: int):
    """Over rows (lang, block, term, source, n) sorted by block, lang and term: the joint tables of each block's sources."""

    def finish(block: pa.Table):
        term, source, n = (block.column(k).combine_chunks() for k in (2, 3, 4))
        source, row = source.dictionary_encode(), term.dictionary_encode().indices.to_numpy().astype(np.int64)
        # Sources stand in one order in all blocks, so that a pair of them comes one way round.
        _, place = np.unique(np.array(source.dictionary.to_pylist(), object), return_inverse=True)
        names = source.dictionary.take(pa.array(np.argsort(place)))
        levels, level = np.unique(n.to_numpy(), return_inverse=True)
        # Columns of the indicator matrix: the different (source, level), numbered.
        columns, column = np.unique(place[source.indices.to_numpy()] * len(levels) + level, return_inverse=True)
        row, column = np.divmod(np.sort(row * len(columns) + column), len(columns))
        end = np.cumsum(np.bincount(row))[row]
        # Entry k of a row meets the entries from k on in its row: the upper triangle of the product.
        width = end - np.arange(len(row))
        low, total = 0, np.concatenate(([0], np.cumsum(width)))
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(total, total[low] + products, "right")) - 1)
            reach = width[low:high]
            left = np.repeat(np.arange(low, high), reach)
            right = left + np.arange(len(left)) - np.repeat(np.concatenate(([0], np.cumsum(reach)[:-1])), reach)
            cell, terms = np.unique(column[left] * len(columns) + column[right], return_counts=True)
            sides = [x for c in np.divmod(cell, len(columns)) for x in np.divmod(columns[c], len(levels))]
            a, an, b, bn = (values.take(pa.array(x)) for values, x in zip((names, pa.array(levels)) * 2, sides))
            lang = block.column(0).combine_chunks().take(pa.array(np.zeros(len(cell), np.int64)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((lang, a, an, b, bn, pa.array(terms)), JOINT)], schema=JOINT)
            low = high

    def run(batches):
        at, held, rows = None, [], 0
        for batch in batches:
            lang, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((lang[1:] != lang[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(batch)]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                here = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if held and here != at:
                    yield from finish(pa.Table.from_batches(held))
                    held, rows = [], 0
                at = here
                held.append(part)
                rows += len(part)
                # A term with very many sources is a block of its own when it has to be.
                if rows >= 4 * BLOCK_CELLS and (cut := pc.index((table := pa.Table.from_batches(held)).column(2), part.column(2)[-1]).as_py()):
                    yield from finish(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def smoothed(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(scale * (count + 1) / (N + V)) in whole numbers; null where V is 0, for there are no terms then."""
    n = F.col(count) if isinstance(count, str) else count
    whole = F.nullif(F.col(total) + F.col(terms), F.lit(0).cast("long"))
    wide = (F.lit(SCALE).cast("decimal(10,0)") * n.cast("decimal(19,0)") + F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    # Whole numbers of 64 bits do for all but enormous counts, and take far less time.
    return F.when(n < WIDE, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), whole)).otherwise(F.call_function("div", wide, whole.cast("decimal(38,0)"))) + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Levels:
    """Counts of a corpus, stored: kept cells, the first source of a word leading, groups and languages with their totals."""

    def __init__(self, docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> None:
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
        counted = docs.select(*named, F.col(text).cast("binary")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        cells = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        word = Window.partitionBy("term", "lang")
        whole = [F.sum("n").over(word).alias("lang_n"), F.sum("docs").over(word).alias("lang_docs"), (F.col("source") == F.min("source").over(word)).alias("leads")]
        self.cells = stored(cells.select("lang", "source", "term", "n", *whole).where(F.col("lang_docs") >= least_docs).drop("lang_docs"), "kept")
        # Few rows, stored as groups and languages are both made of them.
        totals = stored(self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("present"), F.count_if("leads").alias("led")), "totals")
        kept = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("led").alias("kept"))
        zero = F.lit(0).cast("long")
        groups = docs.select(*named).distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        self.groups = stored(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "present", "lang_total", "kept")]), "groups")


def joint_tables(levels: Levels, block_cells: int = BLOCK_CELLS, products: int = PRODUCTS) -> DataFrame:
    """(lang, a, an, b, bn, terms): terms with count an > 0 in source a and bn > 0 in b, for a = b and one order of each pair."""
    blocks = levels.groups.groupBy("lang").agg(F.ceil(F.sum("present") / block_cells).alias("blocks"))
    cells = levels.cells.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "source", "n")
    dealt = cells.repartition("lang", "block").sortWithinPartitions("block", "lang", "term")
    made = dealt.mapInArrow(_products(products), "lang string, a string, an long, b string, bn long, terms long")
    return made.groupBy("lang", "a", "an", "b", "bn").agg(F.sum("terms").alias("terms"))


def _both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(lang, source, item, value) of pairs with a value ``forth`` and one ``back``."""
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(v).alias("value")) for x, y, v in ((left, right, "forth"), (right, left, "back"))]
    return pairs.select("lang", F.explode(F.array(*ways)).alias("way")).select("lang", "way.*")


def source_pairs(levels: Levels, **blocks: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of different sources of a language.

    With J the joint table, m the margins and 0 the level zero, the value is
    sum J(c, d) (f(c, d) - f(c, 0) - f(0, d) + f(0, 0)) + sum m(c) (f(c, 0) - f(0, 0))
    + sum m(d) (f(0, d) - f(0, 0)) + V f(0, 0), with c and d above zero.
    """
    zero = F.lit(0).cast("long")
    groups = levels.groups.select("lang", "source", "total", "kept", smoothed(zero, "total", "kept").alias("p0"))
    tables = stored(joint_tables(levels, **blocks), "joint")

    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("total", "kept", "p0")])

    def added(p, q, p0, q0) -> Column:
        return price(p, q) - price(p, q0) - price(p0, q) + price(p0, q0)

    ap, bp = smoothed("an", "a_total", "a_kept"), smoothed("bn", "b_total", "b_kept")
    priced = (
        tables.where("a <> b").join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
        .select("lang", "a", "b", "terms", "a_p0", "b_p0", ap.alias("p"), bp.alias("q"))
        .groupBy("lang", "a", "b")
        .agg(
            F.sum(F.col("terms") * added(F.col("p"), F.col("q"), F.col("a_p0"), F.col("b_p0"))).alias("forth"),
            F.sum(F.col("terms") * added(F.col("q"), F.col("p"), F.col("b_p0"), F.col("a_p0"))).alias("back"),
        )
    )
    # Margins against level zero of each other source: levels are few, a source has about the root of its words of them.
    margins = stored(tables.where("a = b AND an = bn").join(side("a"), ["lang", "a"]).select("lang", F.col("a").alias("source"), "terms", smoothed("an", "a_total", "a_kept").alias("p"), F.col("a_p0").alias("p0")), "margins")
    # Languages are few and one may have most sources, so both joins by language are dealt out by source too.
    deal = F.pmod(F.xxhash64("source"), F.lit(DEALT)).alias("deal")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("deal"))
    facing = margins.withColumn("deal", deal).join(other, ["lang", "deal"]).where("source <> item")
    grouped = facing.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (price(F.col("p"), F.col("q0")) - price(F.col("p0"), F.col("q0")))).alias("forth"),
        F.sum(F.col("terms") * (price(F.col("q0"), F.col("p")) - price(F.col("q0"), F.col("p0")))).alias("back"),
    )
    own = groups.withColumn("deal", deal).join(other, ["lang", "deal"]).where("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * price(F.col("p0"), F.col("q0")), zero).alias("value"))
    parts = _both_ways(priced, "a", "b").unionByName(_both_ways(grouped, "source", "item")).unionByName(own)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(levels: Levels, most: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms of a source likelier there than in its language, ``most`` at most."""
    cells = levels.cells.join(levels.groups.drop("present"), ["lang", "source"])
    p, q = smoothed("n", "total", "kept"), smoothed("lang_n", "lang_total", "kept")
    above = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(above.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= most)


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("source", "lang").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, most: int = 200, **blocks: int) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source, part ``term`` the telling terms."""
    levels = Levels(docs, lang, source, text, least_docs)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = _ranked(source_pairs(levels, **blocks)).withColumn("part", F.lit("pair"))
    terms = telling_terms(levels, most).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))
