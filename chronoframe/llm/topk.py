"""Exact top-k by integer inner product, in three phases with a uniform threshold.

A vector is cut into ``parts`` runs of dimensions; its score is the sum of its
scores on the parts. Vectors lie in blocks, and so do queries, so a task holds one
part of one block of either.

1. Every task sends its k best local scores of each query and part. All that is sent
   are candidates, whose full scores give a cutoff: the k-th best of them. No vector
   below the cutoff can be in the answer.
2. The cutoff goes to all tasks, a row for each query and block. A vector at or above
   the cutoff has a part of at least cutoff / parts; every task sends those entries.
   Entries are summed by vector, and vectors whose best possible score is below the
   cutoff are dropped.
3. The vectors left are scored exactly, and the k best are kept.

Pairs are scored where the vectors of both blocks lie in full, so that no pair carries
a vector. The rows of the blocks are shuffled once by part, for phases 1 and 2, and once
in full, for both scorings: the plans below them are equal, and Spark reuses the exchange.

Rows are numbered, and told apart by their number from then on.

Defined cases: vectors that are null or hold a null or non-finite component, and rows
with a null id, take no part, nor do vectors with a component of 2 ** 24 or more after
scaling, so that scores are exact 64-bit integers up to 2 ** 13 dimensions; shorter vectors
count as filled up with zeros; rows that repeat an id are vectors of their own, as queries
(each with a list under that id) and as candidates of one another; ties go to the smaller id;
a query with fewer than k others gets them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.storage import stored

#: Rows of a block.
VECTORS, QUERIES = 8192, 4096
#: Scores of a part that a task computes at a time, and pairs that it scores at a time.
SCORES, PAIRS = 1 << 20, 1 << 16
#: Tasks of a shuffle; from there on several blocks share one.
TASKS = 4096

LARGEST = 1 << 24


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(label, v): usable vectors with components floor(scale * x), under their ids."""
    usable = F.col(vec_id).isNotNull() & F.forall(vector, lambda x: F.abs(x) * scale < F.lit(float(LARGEST)))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    return vectors.where(usable).select(F.col(vec_id).alias("label"), scaled.alias("v"))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the smallest type in which products of their rows are exact.

    No sum over some of the dimensions is beyond the product of the norms; the limits leave
    half of what the type holds, for the norms themselves are rounded.
    """
    largest = np.prod([np.linalg.norm(m.astype(np.float64), axis=1).max(initial=0) for m in (q, v)])
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    return q.astype(kind), v.astype(kind)


def places(wanted: pa.ChunkedArray, among: pa.ChunkedArray) -> np.ndarray:
    """Where each value stands in ``among``; -1 if it does not."""
    return pc.fill_null(pc.index_in(wanted, value_set=among.combine_chunks()), -1).to_numpy()


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The queries and the vectors of two blocks."""
    return table.filter(pc.is_valid(table["query"])), table.filter(pc.is_valid(table["row"]))


ENTRIES = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("cutoff", pa.int64())])
SCORED = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("label", pa.int64()), ("score", pa.int64())])


def sent(q: pa.Table, v: pa.Table, cutoffs: pa.ChunkedArray, send) -> pa.Table:
    """Entries of one part: those that ``send`` picks from rows of scores, never a row with itself.

    Scores that take no part are lower than any real one.
    """
    if not len(q) or not len(v):
        return ENTRIES.empty_table()
    asked, held = exact(matrix(q, "v"), matrix(v, "v"))
    queries, others, cutoffs = q["query"].to_numpy(), v["row"].to_numpy(), cutoffs.combine_chunks()
    own = places(q["query"], v["row"])
    least = np.iinfo(np.int64).min if asked.dtype == np.int64 else -np.inf
    step = max(1, SCORES // len(held))
    found = []
    for start in range(0, len(asked), step):
        scores = asked[start : start + step] @ held.T
        mine = own[start : start + step]
        scores[np.flatnonzero(mine >= 0), mine[mine >= 0]] = least
        rows, columns = send(scores, cutoffs[start : start + step])
        values = scores[rows, columns]
        ok = values != least
        rows, columns, values = rows[ok] + start, columns[ok], values[ok].astype(np.int64)
        found.append(pa.table([queries[rows], others[columns], values, cutoffs.take(pa.array(rows))], schema=ENTRIES))
    return pa.concat_tables(found)


def scores_of(pairs: pa.Table, table: pa.Table) -> pa.Table:
    """Full scores of pairs, without those below their cutoff."""
    if not len(pairs):
        return SCORED.empty_table()
    q, v = sides(table)
    asked, held = exact(matrix(q, "v"), matrix(v, "v"))
    labels = v["label"].combine_chunks()
    found = []
    for start in range(0, len(pairs), PAIRS):
        some = pairs.slice(start, PAIRS)
        rows, columns = places(some["query"], q["query"]), places(some["row"], v["row"])
        scores = pa.array(np.einsum("ij,ij->i", asked[rows], held[columns]).astype(np.int64))
        whole = pa.table([some["query"], some["row"], labels.take(pa.array(columns)), scores], schema=SCORED)
        found.append(whole.filter(pc.fill_null(pc.greater_equal(scores, some["cutoff"]), True)))
    return pa.concat_tables(found)


def search(vectors: DataFrame, is_query: Column, k: int = 10, parts: int = 2, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each query.

    ``is_query`` is a condition on the column ``id``.
    """
    made = prepared(vectors, vec_id, vector, scale).withColumnRenamed("label", "id")
    numbered = made.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("label"), "v", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    ready = stored(numbered, "vectors")
    n, n_queries, width = ready.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("v"))).first()
    blocks, query_blocks = max(1, -(-n // VECTORS)), max(1, -(-n_queries // QUERIES))
    step = max(1, -(-(width or 0) // parts))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
    vector_block, query_block = block("row", blocks), block("query", query_blocks)
    pair = ["vb", "qb"]

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        """A task for each group, as far as that goes: their work is not in proportion to their bytes."""
        groups = blocks * query_blocks * (parts if "part" in keys else 1)
        return rows.repartition(min(groups, TASKS), *keys)

    # The rows of each block of vectors with each block of queries, in full and by part.
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(step * parts) - F.size("v"))).alias("v")
    held = ready.select("row", "label", padded).select("*", vector_block.alias("vb"), every(query_blocks).alias("qb"))
    asked = ready.where("is_query").select(F.col("row").alias("query"), padded).select("*", every(blocks).alias("vb"), query_block.alias("qb"))
    whole = held.unionByName(asked, allowMissingColumns=True)
    slices = F.array(*[F.slice("v", p * step + 1, step) for p in range(parts)])
    cut = whole.select("query", "row", *pair, F.posexplode(slices).alias("part", "v"))
    whole, cut = dealt(whole, *pair).groupBy(*pair), dealt(cut, "part", *pair).groupBy("part", *pair)

    def best(scores, cutoffs):
        first = max(0, scores.shape[1] - k)
        columns = np.argpartition(scores, first, axis=1)[:, first:]
        return np.repeat(np.arange(len(scores)), columns.shape[1]), columns.ravel()

    def enough(scores, cutoffs):
        limits = np.iinfo if scores.dtype == np.int64 else np.finfo
        share = -(-pc.fill_null(cutoffs, 0).to_numpy() // parts)
        least = np.where(cutoffs.is_null().to_numpy(zero_copy_only=False), limits(scores.dtype).min, share.astype(scores.dtype))
        return np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])

    def local_lists(table: pa.Table) -> pa.Table:
        q, v = sides(table)
        return sent(q, v, pa.chunked_array([pa.nulls(len(q), pa.int64())]), best)

    def sufficient(limits: pa.Table, table: pa.Table) -> pa.Table:
        q, v = sides(table)
        cutoffs = limits["cutoff"].take(pc.index_in(q["query"], value_set=limits["query"].combine_chunks()))
        return sent(q, v, cutoffs, enough)

    def summed(entries: DataFrame) -> DataFrame:
        """One row for each pair, in the task that scores it."""
        rows = dealt(entries.select("*", vector_block.alias("vb"), query_block.alias("qb")), *pair)
        return rows.groupBy(*pair, "query", "row").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("sent"), F.max("cutoff").alias("cutoff"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.select(*pair, "query", "row", "cutoff").groupBy(*pair).cogroup(whole).applyInArrow(scores_of, "query long, row long, label long, score long")

    # 1: local lists, and the cutoff that follows from them.
    columns = "query long, row long, score long, cutoff long"
    candidates = scored(summed(cut.applyInArrow(local_lists, columns)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
    cutoffs = candidates.withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("cutoff"))

    # 2: entries that suffice, summed; what cannot reach the cutoff is dropped.
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    limits = cutoffs.select("*", query_block.alias("qb"), every(blocks).alias("vb")).select("*", part)
    entries = dealt(limits, "part", *pair).groupBy("part", *pair).cogroup(cut).applyInArrow(sufficient, columns)
    reach = F.col("score") * parts + (F.lit(parts) - F.col("sent")) * F.col("cutoff")
    sums = summed(entries).where(F.col("cutoff").isNull() | (reach >= F.col("cutoff") * parts))

    # 3: their scores, and the answer.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "label", "row"))
    answer = scored(sums).withColumn("rank", place).where(F.col("rank") <= k)
    names = ready.where("is_query").select(F.col("row").alias("query"), F.col("label").alias("query_id"))
    return answer.join(names, "query").select("query_id", "rank", F.col("label").alias("vec_id"), "score")
