"""The forward tracker as a scheduled job.

Each run takes the source states that arrived since the last run and moves the
tracked dimension on by one ``snapshot_check``. The stream's own checkpoint
remembers what was consumed.

``Tracker`` keeps the dimension in a folder and writes a closed row once; ``track`` keeps a
catalog table and rewrites it, for dimensions small enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoframe.model import SourceError
from chronoframe.operators.scd2 import KEY, snapshot_check, snapshot_start
from chronoframe.sinks import replace_table


def latest_states(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The latest state of each key by ``order``."""
    rest = [c for c in batch.columns if c != key]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_state")
    return batch.groupBy(key).agg(last).select(key, *[F.col(f"_state.{c}").alias(c) for c in rest])


def apply_batch(
    spark: SparkSession,
    batch: DataFrame,
    table: str,
    run_ts: datetime,
    *,
    order: str,
    key: str = KEY,
    check_cols: Sequence[str] = ("current_gics_sector", "current_sub_industry"),
) -> None:
    """Fold one batch of source states into the tracked table.

    Several states of a key in one batch are reduced to the latest by ``order``.
    Running a batch twice changes nothing the second time.
    """
    states = latest_states(batch, key, order)
    if spark.catalog.tableExists(table):
        following = snapshot_check(
            spark.table(table), states, run_ts, key=key, check_cols=check_cols
        )
    else:
        following = snapshot_start(states, run_ts)
    replace_table(following, table)


def track(
    source: DataFrame,
    table: str,
    checkpoint: str,
    *,
    order: str,
    clock: Callable[[], datetime] = datetime.now,
    **how,
) -> StreamingQuery:
    """Consume what is available from a streaming source, then stop."""

    def fold(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            apply_batch(batch.sparkSession, batch, table, clock(), order=order, **how)

    return (
        source.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


OPEN, CLOSED = "open", "closed"


class Tracker:
    """A tracked dimension below a folder, fed by one stream.

    A micro-batch writes one directory, ``batch=N``: in it the rows that it closed, for good,
    and the rows open after it. It reads the open rows of the batch before, so closed ones are
    neither read nor written again. A directory counts once its success marker is there, which
    Spark writes last; a batch that failed half-way is written again under its own number, and
    one that is delivered twice is passed over. So the folder belongs to one checkpoint.
    Open rows of the last but one batch stay for readers that are still at it; earlier ones go.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: str = KEY, check_cols: Sequence[str] = ("current_gics_sector", "current_sub_industry")) -> None:
        self.spark, self.folder, self.key, self.check_cols = spark, folder.rstrip("/"), key, tuple(check_cols)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the finished batches, in order."""
        pattern, files = self._path("batch=*", "_SUCCESS")
        found = files.globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)

    def rows(self) -> DataFrame:
        """All closed rows, and the open ones after the last finished batch."""
        finished = self.batches()
        if not finished:
            raise SourceError(f"{self.folder}: nothing has been tracked yet")
        stored = self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")
        last = F.col("batch") == finished[-1]
        kept = F.when(F.col("part") == OPEN, last).otherwise(F.col("batch") <= finished[-1])
        return stored.filter(kept).drop("batch", "part")

    def fold(self, batch: DataFrame, number: int, run_ts, order: str) -> None:
        """Move on by one micro-batch of source states."""
        finished = self.batches()
        if finished and finished[-1] >= number:
            return
        states = latest_states(batch, self.key, order)
        if finished:
            held = self.spark.read.parquet(f"{self.folder}/batch={finished[-1]}/part={OPEN}")
            following = snapshot_check(held, states, run_ts, key=self.key, check_cols=self.check_cols)
        else:
            following = snapshot_start(states, run_ts)
        part = F.when(F.col("valid_to").isNull(), OPEN).otherwise(CLOSED)
        following.withColumn("part", part).write.partitionBy("part").mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/batch={number}")
        for old in finished[:-1]:
            path, files = self._path(f"batch={old}", f"part={OPEN}")
            files.delete(path, True)

    def run(self, source: DataFrame, checkpoint: str, *, order: str, clock: Callable[[], object] = datetime.now) -> StreamingQuery:
        """Consume what is available from a streaming source, then stop."""

        def fold(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.fold(batch, number, clock(), order)

        return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
