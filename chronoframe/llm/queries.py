"""Registered queries over the driver tables, one for each operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import bpe, contamination, divergence, language, ngramjoin, packing, repair, simhash, substring, suffixes, topk, toxicity, warc


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % folds


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def vocabulary_file(name: str = "word_bpe_49k.json") -> bytes:
    """A public tokenizer's file; tasks get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    names, prototypes = language.learn(docs, where=~held_out)
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lost = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])
    return suffixes.deduplicate(docs).select(
        "doc_id", F.col("text_bytes").alias("n_bytes"), lost.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    captures = warc.transactions(warc.read(spark, warc.write(pages), payload=False))
    revisit = F.col("response.type") == "revisit"
    return captures.select(
        F.col("metadata.fields")["page-id"].cast(kind).alias("page_id"),
        F.when(revisit, F.col("response.fields")["content-length"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.stated_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to_page").cast(kind).alias("refers_to"),
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination.find(docs, items).select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op10_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    file = vocabulary_file()
    ids = bpe.encode(docs, file, bpe.build_lexicon(docs, file)).select("doc_id", "ids")
    return bpe.decode(ids, file).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The damaged rows, and which of them are present."""
    space = F.lit(" ")
    name, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(name, F.lit(":"), turn)) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind", copies.alias("copy")), F.col("kind") != 0


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return repair.Repair(rows, present=present).digests().withColumnRenamed("conv", "conv_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxic_passages, op3_suffix_dedup, op4_simhash_near_dedup, op5_warc_transactions, op6_packed_ids, op7_language_id, op8_exact_top_k, op9_benchmark_leaks, op10_bpe_lexicon, op11_conversation_repair, op12_source_divergence, op13_ngram_jaccard_join)}
ORACLES: dict[str, str] = {
    "op5_warc_transactions": """
        WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        digests AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(encode(body)) AS d FROM bodies),
        firsts AS (SELECT d, min(page_id) AS first_id FROM digests WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM digests LEFT JOIN firsts USING (d)
    """,
    "op8_exact_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_source_divergence": """
        WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
        langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        seen AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, source, term),
        counts AS (SELECT lang, g.source, k.term, coalesce(s.n, 0) AS n, k.n AS lang_n
                   FROM groups g JOIN kept k USING (lang) LEFT JOIN seen s USING (lang, source, term)),
        sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS size FROM counts),
        smooth AS (SELECT c.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (size + v) AS p,
                          1 + (1000000000::HUGEINT * (lang_n + 1)) // (total + v) AS q FROM sized c JOIN langs USING (lang)),
        between_ AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                     FROM smooth a JOIN smooth b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN between_ x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
                  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM smooth WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ),
        places AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM words),
        grams AS (
            SELECT doc_id, n, i, CASE WHEN n < 3 THEN string_agg(x, ' ') OVER o ELSE x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o END AS token
            FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ),
        tokens AS (SELECT DISTINCT doc_id, token FROM grams WHERE token IS NOT NULL AND (n <> 2 OR i = 1)),
        sizes AS (SELECT doc_id, count(token) AS n FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY doc_id),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
            WHERE 10 * least(s.n, t.n) >= 9 * greatest(s.n, t.n)
            GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))
        ),
        reached AS (
            SELECT doc_id, doc_id AS low FROM documents
            UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.doc_id WHERE r.low < l.b
        )
        SELECT doc_id, n AS n_shingles, min(low) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
}
