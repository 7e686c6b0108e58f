"""Export of finished tables as compressed Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Table -> exported name.
EXPORTS = {
    "gold.anchor_metric": "anchor_metric.parquet",
    "gold.sector_cumulative_returns": "sector_cumulative_returns.parquet",
    "gold.sector_daily_returns": "sector_daily_returns.parquet",
    "silver.dim_sector_scd": "dim_sector_scd.parquet",
    "silver.ticker_universe": "ticker_universe.parquet",
    "silver.excluded_tickers": "excluded_tickers.parquet",
}


def export_frame(df: DataFrame, path: str) -> int:
    """Write one frame and return its rows, counted while writing."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def export_all(spark: SparkSession, folder: str, exports: Mapping[str, str] = EXPORTS) -> dict[str, int]:
    return {
        filename: export_frame(spark.table(table), f"{folder}/{filename}")
        for table, filename in exports.items()
    }
