"""From raw documents to token ids: each stage works on what the one before it kept.

Rows are told apart by id and text. Rows that repeat both are copies of each other, of
which the near-duplicate stage keeps one; ids may be null; an empty table stays empty.
Columns besides ``doc_id`` and ``text`` are carried along whatever their names, ``n_chars``
follows the text; ids may be numbers or strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from chronoframe.llm import bpe, contamination, language, resemblance, simhash, suffixes
from chronoframe.llm.queries import vocabulary_file
from chronoframe.llm.storage import new_folder, stored

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let the session hand rows to Python in batches of 4 MB, unless it names a size of its own.

    Spark's 64 MB let a task hold all texts of its partition at once, in the executor's buffers
    and again in its Python worker. The setting stays, as a stage's result is computed later.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, str(4 << 20))
        return stage(spark, docs, sf_dir)

    return run


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as ``carried``, so that no stage meets their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(True).alias("nothing")])).alias("carried"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` from those of ``packed``; ``new`` replaces some, made of the other columns of ``rows``."""
    whole = ("doc_id", "text")
    return rows.select([(new[c] if c in new else F.col(c) if c in whole else F.col("carried").getField(c)).alias(c) for c in docs.columns])


@in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no language can be told: null, empty or without a letter."""
    names, prototypes = language.learn(docs.select("text", "lang"))
    marked = language.identify(packed(docs), names, prototypes)
    return unpacked(marked.where(F.col("lang_pred") != language.UNKNOWN), docs)


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Groups are those of the SimHash trie join, and what its three bits miss: pairs with a
    five-word Jaccard similarity of 0.8 or more, verified.
    """
    number = isinstance(docs.schema["doc_id"].dataType, NumericType)
    dk = F.coalesce(F.col("doc_id"), F.lit(0)) if number else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = {"dk": dk, "th": F.xxhash64("doc_id", "text")}
    rows = docs.select(F.struct(*[v.alias(k) for k, v in key.items()]).alias("doc_id"), "text")
    groups = resemblance.similar_documents(rows, also=simhash.near_duplicates(rows))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    keyed = packed(docs).select(*[v.alias(k) for k, v in key.items()], "*")
    return unpacked(keyed.join(first, ["dk", "th"]).dropDuplicates(["dk", "th"]), docs)


@in_small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated byte strings out of the texts; a document may end up empty, but stays."""
    cut = suffixes.deduplicate(packed(docs), as_text=True)
    new = {"text": F.when(F.col("text").isNotNull(), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return unpacked(cut, docs, **new)


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return unpacked(contamination.decontaminate(packed(docs), items), docs)


@in_small_batches
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text that they stand for.

    The ids are stored in between: a task that encodes and decodes has two Python workers,
    and an executor keeps all of them, with their memory, for what comes next.
    """
    file = vocabulary_file()
    texts = docs.select("doc_id", "text")
    ids = stored(bpe.encode(texts, file, bpe.build_lexicon(texts, file)).select("doc_id", "ids"), "ids")
    return bpe.decode(ids, file).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

# The stages use models and fixed points, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
