"""Scan what is new: the same plan over a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credsieve.config import ScanSettings
from credsieve.plans.scan import scan
from credsieve.scratch import shared_folder
from credsieve.sources.baseline import read_baseline
from credsieve.sources.tree import use_trees


def stream_findings(
    lines: DataFrame, settings: ScanSettings | None = None, *, mode: str = "staged", **options
) -> DataFrame:
    """Findings of a stream of lines.

    Detection is row by row and keeps no state. A baseline is a static table the stream is
    joined with, as it was when the stream was started; restart the stream to take up a new one.
    """
    if not lines.isStreaming:
        raise ValueError("the lines are not a stream")
    return scan(lines, settings, mode=mode, **options).findings


def stream_files(spark: SparkSession, root: str, subtree: str = "", *, settle: float = 2, **options) -> DataFrame:
    """Files below ``root`` as a stream: what was changed since the last batch, hidden names too.

    The newest ``settle`` seconds are left to the next batch. Further options are those of ``file_tree``.
    """
    use_trees(spark)
    reader = spark.readStream.format("file_tree").option("subtree", subtree).option("settle", settle)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(root)


def report_once(findings: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Each fingerprint once within ``delay`` of event time; older state is dropped."""
    timed = findings.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def write_new(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all findings that are available now to a Parquet table, then stop.

    The checkpoint remembers what was read, so the next run takes up only what came since.
    """
    return (
        findings.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_following(
    lines: DataFrame, baseline: str, path: str, checkpoint: str, settings: ScanSettings | None = None, *,
    mode: str = "staged", trigger: Mapping[str, object] | None = None, **options,
) -> StreamingQuery:
    """Findings of a stream of lines, each batch against the baseline as it is when the batch begins.

    A batch is scanned like a table and written to a folder of its own, ``batch_id=<n>``. A batch that is
    repeated after a loss takes the place of its first try, so nothing is written twice. Without ``trigger`` what is available is read and
    the stream ends.
    """
    if not lines.isStreaming:
        raise ValueError("the lines are not a stream")

    def write_batch(batch: DataFrame, number: int) -> None:
        known = read_baseline(batch.sparkSession, baseline)
        found = scan(batch, settings, mode=mode, baseline=known, **options).findings
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")

    return lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_once(findings: DataFrame) -> DataFrame:
    """Run a stream to the end of its input and give back what it wrote."""
    spark = findings.sparkSession
    path, checkpoint = shared_folder(spark, "findings"), shared_folder(spark, "progress")
    write_new(findings, path, checkpoint).awaitTermination()
    return spark.read.schema(findings.schema).parquet(path)
