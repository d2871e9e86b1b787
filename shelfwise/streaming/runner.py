"""Running a stream over all that has landed, with its results in a table."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfwise.runtime import work_dir

PROGRESS = "run_id string, batch_id long, reported_at string, input_rows long, state_rows long"
TIMEOUT_SECONDS = 1800
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State on local disk of the executors, backed up to the checkpoint folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def batch_path(out: str, batch_id: int) -> str:
    """Folder of one micro-batch; a batch that is run again replaces its own folder."""
    return f"{out}/batch_id={batch_id}"


def checkpoint_of(out: str) -> str:
    """Where a stream that writes to `out` keeps its place, so that the next run goes on from there."""
    return f"{out}/_checkpoint"


def drain(
    stream: DataFrame, write_batch: Callable[[DataFrame, int], None], mode: str, purpose: str, out: str
) -> None:
    """Process what is there and has not been processed for `out`, then stop."""
    spark = stream.sparkSession
    with rocksdb_state(spark):
        running = (
            stream.writeStream.foreachBatch(write_batch)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint_of(out))
            .trigger(availableNow=True)
            .start()
        )
        try:
            if not running.awaitTermination(TIMEOUT_SECONDS):
                raise TimeoutError(f"{purpose} did not finish in {TIMEOUT_SECONDS} s")
        finally:
            reports = running.recentProgress
            running.stop()
    _keep_progress(spark, out, reports)


def _keep_progress(spark: SparkSession, out: str, reports: list) -> None:
    """Add what Spark has reported of the batches of this run to the progress table of `out`."""
    rows = [
        (
            str(r["runId"]),
            int(r["batchId"]),
            r["timestamp"],
            int(r["numInputRows"]),
            sum(int(s["numRowsTotal"]) for s in r["stateOperators"]),
        )
        for r in (json.loads(one.json) if hasattr(one, "json") else one for one in reports)
    ]
    if rows:
        table = spark.createDataFrame(rows, PROGRESS)
        table.coalesce(1).write.mode("append").parquet(f"{out}/progress")


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """A row per batch and run: (run_id, batch_id, reported_at, input_rows, state_rows)."""
    return spark.read.schema(PROGRESS).parquet(f"{out}/progress")


def batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows under the batch folders of `path`, with their batch_id; none where nothing has been written yet."""
    reader = spark.read.option("basePath", path)
    if schema is None:
        return reader.parquet(path)
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return reader.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def stored_table(spark: SparkSession, out: str) -> DataFrame:
    """What `drained_table` has written for `out`."""
    return batches(spark, f"{out}/rows")


def drained_table(
    stream: DataFrame, mode: str, purpose: str, out: str | None = None, split: list[str] | None = None
) -> DataFrame:
    """All rows the stream has put out for `out`, with the batch that put them out; `split` names folders inside a batch."""
    spark = stream.sparkSession
    out = out or work_dir(spark, purpose)
    rows = f"{out}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*(split or [])).parquet(batch_path(rows, batch_id))

    drain(stream, write, mode, purpose, out)
    return batches(spark, rows, stream.schema)
