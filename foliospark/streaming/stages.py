"""Independent outputs of one stream: each micro-batch goes through all stages, and one that fails doesn't hold up the others.

An output is a folder of Parquet files with a folder for each micro-batch, which is overwritten when the batch runs again: after a crash between two
outputs the stream repeats the batch, and no row is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Stage = Callable[[DataFrame], DataFrame]
FAILURES = "failures"
_FAILURE = "stage string, error string, n_rows long"


class StopStream(Exception):
    """Raised by a stage that can't go on for any rows: the stream ends, and repeats the micro-batch when it is started again."""


def _batch(path: str, stage: str, number: int) -> str:
    return f"{path.rstrip('/')}/{stage}/batch={number}"


def run_stages(stream: DataFrame, stages: Mapping[str, Stage], path: str, once: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Start the stream. ``stages``: names of outputs, and what each makes of a micro-batch.

    A stage that raises an ``Exception`` leaves a row in the output ``failures`` (stage, error, rows of the batch), and its own output lacks the batch: run it again
    with ``repeat``. After ``StopStream``, and after the loss of the driver, the stream goes on at the same batch when it is started again.
    ``once``: all that is there, then stop.
    """
    if FAILURES in stages:
        raise ValueError(f"no stage may be called {FAILURES}")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            failed = []
            for name, stage in stages.items():
                try:
                    stage(batch).write.mode("overwrite").parquet(_batch(path, name, number))
                except StopStream:
                    raise
                except Exception as e:  # noqa: BLE001  a stage may fail in any way; the others go on, and the failure is kept
                    failed.append((name, f"{type(e).__name__}: {e}"[:1000], batch.count()))
            spark.createDataFrame(failed, _FAILURE).coalesce(1).write.mode("overwrite").parquet(_batch(path, FAILURES, number))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{path.rstrip('/')}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def output(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """All rows of a stage's output, with the number of their micro-batch."""
    return spark.read.option("basePath", f"{path.rstrip('/')}/{stage}").parquet(f"{path.rstrip('/')}/{stage}/batch=*").withColumn("batch", F.col("batch").cast("long"))


def repeat(spark: SparkSession, rows: DataFrame, stages: Mapping[str, Stage], path: str, stage: str, number: int) -> None:
    """Make a stage's output of one micro-batch again out of the batch's ``rows``, and take back its failure."""
    stages[stage](rows).write.mode("overwrite").parquet(_batch(path, stage, number))
    left = spark.read.parquet(_batch(path, FAILURES, number)).filter(F.col("stage") != stage).collect()  # a row for each stage at most
    spark.createDataFrame(left, _FAILURE).coalesce(1).write.mode("overwrite").parquet(_batch(path, FAILURES, number))


def append_log(stream: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """An append-only log: a file sink with each row once, also after restarts. Secrets and identifiers are to be redacted before (``functions.text.redacted``)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
