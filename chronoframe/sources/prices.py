"""A folder of per-entity CSV files with a three-line header.

Line one names the columns, line two repeats the entity, line three names the
index and is otherwise empty. The entity is the file name. A file that cannot
be read in full goes to the rejects, whole; it never costs the other files.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.model import DAILY_PRICES, SourceError
from chronoframe.session import stored

# Source column -> table column, and the source's name for the date.
DATE_COLUMN = "Price"
RENAMES = {
    "Open": "open_price",
    "High": "high_price",
    "Low": "low_price",
    "Close": "close_price",
    "Volume": "volume",
}
INTEGRAL = ("volume",)
# First cells of the two header lines without information.
MARKERS = ("Ticker", "Date")
# Spellings of a missing number.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


@dataclass(frozen=True)
class Landing:
    """Parsed rows, and what was left out: files as (file, reason), or lines as (value, reason)."""

    rows: DataFrame
    rejects: DataFrame


# A comma and the cell after it: quoted parts, in which commas stand and quotes are doubled, and other text.
_CELL = ',((?:"(?:[^"]++|"")*+"|[^,"]++|")*+)'


def _cells(line: Column) -> Column:
    """Cells of one line, in one pass over it; a quoted cell may hold commas and doubled quotes."""
    bare = lambda cell: F.regexp_replace(F.regexp_replace(F.trim(cell), '^"(.*)"$', "$1"), '""', '"')
    quoted = lambda text: F.contains(text, F.lit('"'))
    unmarked = F.when(F.startswith(line, F.lit("\ufeff")), F.substring(line, 2, 2**31 - 1)).otherwise(line)
    found = F.regexp_extract_all(F.concat(F.lit(","), unmarked), F.lit(_CELL), 1)
    with_quotes = F.transform(found, lambda cell: F.when(quoted(cell), F.trim(bare(cell))).otherwise(F.trim(cell)))
    return F.when(quoted(line), with_quotes).otherwise(F.transform(F.split(unmarked, ",", -1), lambda cell: F.trim(cell)))


def read_keyed_csv(
    spark: SparkSession,
    path: str,
    *,
    date_column: str = DATE_COLUMN,
    renames: Mapping[str, str] = RENAMES,
    on_all_failed: str = "error",
) -> Landing:
    """All CSV files of a folder; see ``parse_lines``. A file without any line is rejected too.

    The entity is the file's name. Where the folder holds directories ``file=NAME.csv``, as
    Spark writes them, each is one file in as many pieces as it has.
    """
    try:
        source = spark.read.text(path)
        by_folder = "file" in source.columns
        if not by_folder:
            source = spark.read.option("pathGlobFilter", "*.csv").text(path)
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error.getCondition()}") from error
    name = F.col("file") if by_folder else F.col("_metadata.file_name")
    # No reader yields a row for an empty file; the listing is the one the source keeps on the driver anyway.
    parts = [unquote(urlparse(uri).path).split("/") for uri in source.inputFiles()]
    names = sorted({p[-2].removeprefix("file=") if by_folder else p[-1] for p in parts})
    if not names:
        raise SourceError(f"no CSV files found in {path}")
    files = spark.createDataFrame(pa.table({"file": names}))
    lines = source.select(name.alias("file"), "value")
    landed = parse_lines(lines, date_column=date_column, renames=renames)
    nothing = F.lit(_missing_text(sorted([date_column, *renames])))
    empty = files.join(lines.filter(F.trim("value") != "").select("file").distinct(), "file", "left_anti").select("file", nothing.alias("reason"))
    rejects = landed.rejects.unionByName(empty)
    if on_all_failed == "error" and files.join(rejects, "file", "left_anti").isEmpty():
        raise SourceError(f"every file in {path} failed to parse")
    return Landing(landed.rows, rejects)


def _missing_text(columns: list[str]) -> str:
    return f"missing expected columns [{', '.join(columns)}]"


def parse_lines(
    lines: DataFrame, *, date_column: str = DATE_COLUMN, renames: Mapping[str, str] = RENAMES
) -> Landing:
    """Rows and rejected files from lines given as (file, value).

    A file is rejected as a whole when its header lacks a column or comes twice, a
    marker line comes twice, a line has other than the header's number of cells, or a
    date or number cannot be read.

    Lines of one file may lie in any number of tasks: headers are found in a first pass, which
    takes apart only the lines that name the date column, and joined to the lines; verdicts are
    counts that are summed where the lines are, and rejected files drop out by an anti join.
    Nothing is ordered or gathered by file. The values of the lines, which verdicts and rows are
    both taken from, are stored in the shared folder, so that each line is taken apart once.
    """
    written = lines.filter(F.trim("value") != "").select("file", "value")
    may_be_header = F.lit(True) if '"' in date_column else F.contains("value", F.lit(date_column))
    is_header = F.array_contains("_cells", date_column)
    named = written.filter(may_be_header).select("file", _cells(F.col("value")).alias("_cells")).filter(is_header)
    headers = named.groupBy("file").agg(F.max("_cells").alias("_header"), F.count(F.lit(1)).alias("_headers"))
    first = F.get("_cells", F.lit(0))
    joined = written.join(headers.withColumnRenamed("file", "_of"), F.col("file") == F.col("_of"), "left")
    known = joined.select("file", "_header", "_headers", _cells(F.col("value")).alias("_cells")).withColumns(
        {"_is_header": is_header, "_marker": F.when(~is_header & first.isin(*MARKERS), first)}
    )
    names = F.coalesce("_header", F.array().cast("array<string>"))
    expected = F.array(*[F.lit(c) for c in sorted([date_column, *renames])])
    marked = known.withColumns({
        "_missing": F.when(is_header | F.col("_header").isNull(), F.array_join(F.array_except(expected, names), ", ")),
        "_body": ~F.col("_is_header") & F.col("_marker").isNull(), "_uneven": F.size("_cells") != F.size("_header"),
    })
    values = _values(marked, date_column, renames).drop("_cells", "_header", "_is_header")
    parsed = stored(values, "parsed-lines")
    body = F.col("_body")
    problems = {
        "headers": F.max("_headers") - 1,
        **{f"{m} lines": F.count_if(F.col("_marker") == m) - 1 for m in MARKERS},
        "lines of other length": F.count_if("_uneven"),
        "dates": F.count_if(body & F.col("_bad_date")),
        "numbers": F.count_if(body & F.col("_bad_number")),
    }
    texts = [F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(what))) for what, n in problems.items()]
    lacking = F.max("_missing")
    reason = F.when(lacking != "", F.concat(F.lit("missing expected columns ["), lacking, F.lit("]"))).otherwise(
        F.concat(F.lit("unusable: "), F.nullif(F.concat_ws(", ", *texts), F.lit("")))
    )
    rejects = parsed.groupBy("file").agg(reason.alias("reason")).filter(F.col("reason").isNotNull())
    key = F.regexp_replace("file", r"\.csv$", "").alias("ticker")
    columns = [f.name for f in DAILY_PRICES.fields if f.name in {"trade_date", *renames.values()}]
    rows = parsed.filter(body).join(rejects.select("file"), "file", "left_anti").select(key, *columns)
    return Landing(rows, rejects)


def _values(lines: DataFrame, date_column: str, renames: Mapping[str, str]) -> DataFrame:
    """Typed values of each line under its file's header, and whether they could be read."""

    def raw(column: str) -> Column:
        text = F.get("_cells", F.array_position("_header", column).cast("int") - 1)
        return F.when(~text.isin(list(MISSING)), text)

    # In steps, so that no value is worked out more than once.
    texts = lines.withColumns({"_day": raw(date_column), **{f"_text{k}": raw(source) for k, source in enumerate(renames)}})
    numbers = {f"_number{k}": F.nanvl(F.col(f"_text{k}").try_cast("double"), F.lit(None).cast("double")) for k in range(len(renames))}
    typed = texts.withColumns({"trade_date": F.col("_day").try_cast("date"), **numbers})
    values, bad = {}, F.lit(False)
    for k, target in enumerate(renames.values()):
        number = F.col(f"_number{k}")
        bad = bad | (F.col(f"_text{k}").isNotNull() & number.isNull())
        if target in INTEGRAL:
            whole = number.try_cast("bigint")
            bad = bad | F.coalesce(whole.cast("double") != number, number.isNotNull())
            number = whole
        values[target] = number
    found = typed.withColumns({**values, "_bad_date": F.col("trade_date").isNull(), "_bad_number": bad})
    return found.drop("_day", *[f"_{kind}{k}" for kind in ("text", "number") for k in range(len(renames))])


def corpus_profile(df: DataFrame, key: str = "ticker", time: str = "trade_date") -> DataFrame:
    """Rows, distinct keys, first and last day."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(key).alias("distinct_keys"),
        F.min(time).alias("first_date"),
        F.max(time).alias("last_date"),
    )
