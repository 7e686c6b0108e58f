"""Small reference files and Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions import blank_to_null, padded_identifier
from chronoframe.model import (
    CURRENT_SNAPSHOT,
    EXCLUDED_ENTITIES,
    MEMBERSHIP,
    SECTOR_HISTORY,
    SECTOR_REGISTRY,
    SourceError,
)
from chronoframe.sources.prices import Landing

# Snapshot column -> table column.
SNAPSHOT_RENAMES = {
    "Symbol": "ticker",
    "Security": "security_name",
    "GICS Sector": "gics_sector",
    "GICS Sub-Industry": "gics_sub_industry",
    "Headquarters Location": "headquarters",
    "Date added": "date_added",
    "CIK": "cik",
    "Founded": "founded",
}


def _text_columns(spark: SparkSession, path: str, names: Mapping[str, str], lines_within: bool = False) -> DataFrame:
    """All columns as text, selected by name, blanks as NULL.

    Files are split between tasks, unless cells may hold line breaks (``lines_within``).
    """
    try:
        raw = spark.read.option("header", True).option("multiLine", lines_within).option("escape", '"').csv(path)
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error.getErrorClass()}") from error
    missing = sorted(set(names) - set(raw.columns))
    if missing:
        raise SourceError(f"{path}: missing expected columns {missing}")
    return _named(raw, names)


def _named(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return raw.select([blank_to_null(F.col(f"`{c}`")).alias(alias) for c, alias in names.items()])


def _by_schema(schema: T.StructType) -> dict[str, str]:
    return {name: name for name in schema.fieldNames()}


def strict_date(text: Column) -> Column:
    """A date, or an error naming the value that is not one."""
    day = text.try_cast("date")
    complaint = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
    return F.when(text.isNotNull() & day.isNull(), complaint).otherwise(day)


def lenient_date(text: Column) -> Column:
    return text.try_cast("date")


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(
        [F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    )


def snapshot_from_text(raw: DataFrame) -> DataFrame:
    """Today's attributes from columns of text; the identifier keeps its leading zeros."""
    typed = _named(raw, SNAPSHOT_RENAMES).withColumns(
        {"date_added": lenient_date(F.col("date_added")), "cik": padded_identifier(F.col("cik"))}
    )
    return _shaped(typed, CURRENT_SNAPSHOT)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    same = {c: c for c in SNAPSHOT_RENAMES}
    return snapshot_from_text(_text_columns(spark, path, same, lines_within=True))


def log_from_text(raw: DataFrame) -> DataFrame:
    """The change log from columns of text, with strict dates."""
    dated = _named(raw, _by_schema(SECTOR_HISTORY)).withColumns(
        {c: strict_date(F.col(c)) for c in ("effective_after_close", "first_trading_day")}
    )
    return _shaped(dated, SECTOR_HISTORY)


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """The change log; a change that changes nothing is an error."""
    log = log_from_text(_text_columns(spark, path, _by_schema(SECTOR_HISTORY)))
    validate_changes(log)
    return log


def idle_changes(log: DataFrame) -> DataFrame:
    """All events whose old and new label are the same."""
    return log.filter(F.col("old_gics_sector") == F.col("new_gics_sector"))


def validate_changes(log: DataFrame) -> None:
    """Raise when ``idle_changes`` has rows, with their number and one key as a sample."""
    found = idle_changes(log).agg(F.count(F.lit(1)).alias("n"), F.min("ticker").alias("sample")).first()
    if found["n"]:
        raise SourceError(f"{found['n']} events leave their label as it was, for instance of {found['sample']}")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    text = _text_columns(spark, path, _by_schema(SECTOR_REGISTRY))
    dated = text.withColumns(
        {"existed_from": strict_date(F.col("existed_from")), "existed_to": lenient_date(F.col("existed_to"))}
    )
    return _shaped(dated, SECTOR_REGISTRY)


def read_holdouts(spark: SparkSession, path: str) -> DataFrame:
    return _shaped(_text_columns(spark, path, _by_schema(EXCLUDED_ENTITIES)), EXCLUDED_ENTITIES)


def intervals_from_text(raw: DataFrame) -> DataFrame:
    """Membership intervals from columns of text; a start that cannot be read is NULL."""
    dated = _named(raw, _by_schema(MEMBERSHIP)).withColumns({c: lenient_date(F.col(c)) for c in ("start_date", "end_date")})
    return _shaped(dated, MEMBERSHIP)


def read_intervals(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Membership intervals. Rows without a start are dropped.

    The observation holds ``dropped`` after the first action on the frame, so
    counting costs no pass of its own.
    """
    dated = intervals_from_text(_text_columns(spark, path, _by_schema(MEMBERSHIP)))
    dropped = Observation()
    counted = dated.observe(dropped, F.count_if(F.col("start_date").isNull()).alias("dropped"))
    return counted.filter(F.col("start_date").isNotNull()), dropped


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with declared column types; a value of the wrong type is an error."""
    text = _text_columns(spark, path, _by_schema(schema))
    strict = [
        strict_date(F.col(f.name)).alias(f.name) if f.dataType == T.DateType() else F.col(f.name)
        for f in schema.fields
    ]
    return _shaped(text.select(*strict), schema)


def lines_to_rows(lines: DataFrame, schema: T.StructType, header: str | None = None) -> Landing:
    """Typed rows from lines of CSV text in column ``value``, and the lines that do not fit as (value, reason).

    ``header`` names the columns in the order of the lines (by default, that of the schema);
    lines equal to it are skipped, blank ones too. A line does not fit when it has another number
    of cells, when a cell is not of its column's type, or when a column that must be present is
    empty. Cells hold no line breaks, so files are split between tasks.
    """
    order = [c.strip() for c in header.split(",")] if header else schema.fieldNames()
    missing = sorted(set(schema.fieldNames()) - set(order))
    if missing:
        raise SourceError(f"missing expected columns {missing}")
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    declared = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in order)
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unfit", "dateFormat": "yyyy-MM-dd", "escape": '"',
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
    }
    bare = F.regexp_replace("value", "^\ufeff|\r$", "")
    wanted = lines.select("value", bare.alias("_line")).filter((F.trim("_line") != "") & (F.trim("_line") != ",".join(order)))
    read = wanted.select("value", F.from_csv("_line", declared + ", `_unfit` string", options).alias("_row"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"_row.{f.name}").isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable]))
    reason = F.when(F.col("_row._unfit").isNotNull(), "cells do not fit the columns").when(
        F.size(lacking) > 0, F.concat(F.lit("empty: "), F.array_join(lacking, ", "))
    )
    judged = read.withColumn("reason", reason)
    rows = judged.filter(F.col("reason").isNull()).select([F.col(f"_row.{f.name}").alias(f.name, metadata=f.metadata) for f in schema.fields])
    return Landing(rows, judged.filter(F.col("reason").isNotNull()).select("value", "reason"))


def registry_from_lines(lines: DataFrame, header: str | None = None) -> Landing:
    """Label lifetimes from lines of text."""
    return lines_to_rows(lines, SECTOR_REGISTRY, header)


def holdouts_from_lines(lines: DataFrame, header: str | None = None) -> Landing:
    """Hold-outs from lines of text."""
    return lines_to_rows(lines, EXCLUDED_ENTITIES, header)


def land_seed(spark: SparkSession, path: str, schema: T.StructType) -> Landing:
    """A CSV file with declared column types; its first line names the columns. Lines that do not fit are rejects."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error.getErrorClass()}") from error
    header = lines.first()
    if header is None:
        raise SourceError(f"{path}: missing expected columns {sorted(schema.fieldNames())}")
    return lines_to_rows(lines, schema, header["value"].lstrip("\ufeff").strip())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a missing one is named, with how to produce it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise SourceError(f"{path} not found - build and export the layers first") from error
