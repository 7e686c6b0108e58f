"""Catalog tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoframe.model import COLUMN_COMMENTS, TABLE_COMMENTS

NAMESPACES = ("bronze", "silver", "gold")
CONTENT, BUILT_FROM = "chronoframe.content", "chronoframe.built_from"


def create_namespaces(spark: SparkSession, names: Sequence[str] = NAMESPACES) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def documented(df: DataFrame) -> DataFrame:
    """Attach column comments known to the model, keeping those already there."""
    described = []
    for column in df.schema.fields:
        comment = column.metadata.get("comment") or COLUMN_COMMENTS.get(column.name)
        described.append(
            F.col(column.name).alias(column.name, metadata={**column.metadata, "comment": comment})
            if comment
            else F.col(column.name)
        )
    return df.select(*described)


def replace_table(
    df: DataFrame,
    name: str,
    *,
    bucket_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    buckets: int = 0,
    cluster_by: tuple[str, str] | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Replace the contents of a table; a failed write leaves the old contents.

    Each version of a table has a folder of its own beside the others. The new one is written
    in full first, so ``df`` may read the table it replaces, and then the table is pointed at it
    in one step of the catalog: a reader always finds the table, with the old rows or the new
    ones. The version before stays for readers that are still at it; older ones go. Where
    columns, buckets or partitions differ, the new table takes the name by renaming, and if that
    fails half-way the old one gets it back.

    ``bucket_by`` stores
    the table hash-partitioned for shuffle-free joins and windows on that key.
    ``cluster_by`` takes a label and a date column and keeps each label's months
    together, sorted, so that filters on both skip files and row groups. The
    rebalancing shuffle splits a month that is too large for one file and merges
    small ones by measured size; unlike a range partitioning it does not
    evaluate the input twice.
    """
    spark = df.sparkSession
    incoming = f"{name}__incoming_{uuid.uuid4().hex[:12]}"
    folder = f"{_versions(spark, name)}{uuid.uuid4().hex[:12]}"
    rows = documented(df)
    if cluster_by:
        label, day = cluster_by
        rows = (
            rows.withColumn("_month", F.trunc(F.col(day), "month"))
            .hint("rebalance", label, "_month")
            .sortWithinPartitions(label, day)
            .drop("_month")
        )
    if bucket_by:
        # One task per bucket writes one file per bucket.
        rows = rows.repartition(buckets, *bucket_by)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", folder)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = None
    try:
        writer.saveAsTable(incoming)
        if spark.catalog.tableExists(name):
            before = _facts(spark, name)["Location"]
            if partition_by or not _alike(spark, incoming, name):
                _exchange(spark, incoming, name)
            else:
                spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
                spark.sql(f"DROP TABLE {incoming}")
        else:
            _rename(spark, incoming, name)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {incoming}")
        _delete(spark, folder)
        raise
    _tidy(spark, name, {folder, before})
    comment = TABLE_COMMENTS.get(name)
    if comment:
        quoted = comment.replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {name} IS '{quoted}'")


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table and all of its versions."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _tidy(spark, name, set())


def _versions(spark: SparkSession, name: str) -> str:
    """Where the versions of a table lie, up to the part that differs."""
    database, _, table = name.rpartition(".")
    return f"{spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri.rstrip('/')}/{table}__v_"


def _facts(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog says about a table."""
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}


def _alike(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two tables have the same columns and the same layout."""
    layout = ("Provider", "Num Buckets", "Bucket Columns", "Sort Columns", "# Partition Information")
    a, b = _facts(spark, one), _facts(spark, other)
    return spark.table(one).schema == spark.table(other).schema and all(a.get(k) == b.get(k) for k in layout)


def _exchange(spark: SparkSession, incoming: str, name: str) -> None:
    """Give a table's name to another table."""
    retired = f"{name}__retired_{uuid.uuid4().hex[:12]}"
    try:
        _rename(spark, name, retired)
        _rename(spark, incoming, name)
    except BaseException:
        if not spark.catalog.tableExists(name):
            _rename(spark, retired, name)
        raise
    spark.sql(f"DROP TABLE {retired}")


def _rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {name} RENAME TO {to}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _tidy(spark: SparkSession, name: str, kept: set[str | None]) -> None:
    """Delete the versions of a table that are not wanted any more."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(_versions(spark, name) + "*")
    wanted = {k.rpartition("/")[2] for k in kept if k}
    for found in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        if found.getPath().getName() not in wanted:
            _delete(spark, found.getPath().toString())


def store_table(df: DataFrame, name: str, built_from: str = "", **how) -> str:
    """``replace_table``, noting in the table's properties what it was built from and what it holds.

    The fingerprint of the rows, which is returned, is the number and the sum of their hashes,
    observed while they are written.
    """
    seen = Observation()
    total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    replace_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), total.alias("hashes")), name, **how)
    content = f"{seen.get['rows']}-{seen.get['hashes'] or 0}"
    df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{CONTENT}' = '{content}', '{BUILT_FROM}' = '{built_from}')")
    return content


def noted(spark: SparkSession, name: str, which: str) -> str | None:
    """A note that ``store_table`` left with a table."""
    if not spark.catalog.tableExists(name):
        return None
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get(which)


def reload_partitions(changes: DataFrame, name: str, *, key: Sequence[str], partition: str) -> None:
    """Put changed and new rows into a partitioned table; only the partitions that they fall into are written.

    Rows of the same ``key`` within those partitions are replaced, all others there stay. The
    partitions touched are named to the scan and overwritten one by one; the rest keep their files.
    """
    spark = changes.sparkSession
    table = spark.table(name)
    touched = [row[0] for row in changes.select(partition).distinct().collect()]  # as many as the table has at most
    if not touched:
        return
    old = table.filter(F.col(partition).isin(touched)).join(changes.select(*key), list(key), "left_anti")
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows = old.select(table.columns).unionByName(changes.select(table.columns))
        rows.repartition(partition).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)


def column_statistics(spark: SparkSession, name: str) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, smallest, largest) as the optimizer knows them, after ``analyze``."""
    stated = re.search(r"(\d+) rows", _facts(spark, name).get("Statistics", ""))
    rows = int(stated.group(1)) if stated else None
    out = []
    for column in spark.table(name).columns:
        known = {r.info_name: None if r.info_value == "NULL" else r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} `{column}`").collect()}
        count = lambda k: None if known.get(k) is None else int(known[k])  # noqa: B023, E731
        out.append((column, rows, count("num_nulls"), count("distinct_count"), known.get("min"), known.get("max")))
    return spark.createDataFrame(out, "column_name string, row_count long, null_count long, distinct_count long, smallest string, largest string")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Store a diagnostic as a table and read it back."""
    replace_table(df, name)
    return df.sparkSession.table(name)


def analyze(spark: SparkSession, name: str, *, columns: bool = False) -> None:
    """Refresh optimizer statistics; those of columns (with histograms where the session asks for them) cost a full pass."""
    scope = " FOR ALL COLUMNS" if columns else ""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS{scope}")
