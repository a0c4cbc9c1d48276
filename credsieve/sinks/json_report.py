"""JSON reports: one object per finding, and whole documents."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import credsieve
from credsieve.operators.suppress import KEPT
from credsieve.plans.scan import Scan
from credsieve.schema import FINDING_COLUMNS, SCAN_ORDER
from credsieve.sinks.chunks import counts_of, found_once, in_chunks
from credsieve.sinks.folders import in_scan_order, write_folder

DOCUMENT_SIZE = 5_000
_WITH_NULLS = {"ignoreNullFields": "false"}


def utc_now() -> Column:
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in column ``value``; fields without a value are null."""
    return findings.select(
        F.to_json(F.struct(*FINDING_COLUMNS), _WITH_NULLS).alias("value")
    )


def summary_json(summary: DataFrame) -> DataFrame:
    counts = F.struct("total", "critical", "high", "suppressed", "scanned_files", "scanned_lines")
    return summary.select(
        F.to_json(F.struct("scan_mode", "target", counts.alias("summary"))).alias("value")
    )


def report_documents(scan: Scan, size: int = DOCUMENT_SIZE) -> DataFrame:
    """Whole reports in column ``value``: the counts of the run and up to ``size`` findings each.

    A run with more findings gives several documents with the same head; one without any gives
    a document with an empty list. Lines are searched once, when this is called; files and lines are
    counted by a job that searches nothing.
    """
    found = found_once(scan)
    pieces = (
        in_chunks(found.filter(F.col("status") == KEPT), SCAN_ORDER, size)
        .groupBy("chunk")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(*SCAN_ORDER, F.struct(*FINDING_COLUMNS).alias("finding")))
            ).alias("sorted")
        )
        .select(F.lit(1).alias("one"), F.col("sorted.finding").alias("findings"))
    )
    # Both are one row, so sending them to every task is free of growth.
    summary = counts_of(scan, found).crossJoin(F.broadcast(scan.scanned))
    head = summary.withColumn("one", F.lit(1))
    full = pieces.join(F.broadcast(head), "one").select(*summary.columns, "findings")
    clean = summary.filter(F.col("total") == 0).withColumn(
        "findings", F.array().cast(pieces.schema["findings"].dataType)
    )
    counts = F.struct("total", "critical", "high", "suppressed", "scanned_files", "scanned_lines")
    return full.unionByName(clean).select(
        F.to_json(
            F.struct(
                F.lit(credsieve.__version__).alias("version"),
                utc_now().alias("generated_at"),
                "scan_mode",
                "target",
                counts.alias("summary"),
                "findings",
            ),
            _WITH_NULLS,
        ).alias("value")
    )


def report_rows(scan: Scan) -> DataFrame:
    """Matches in scan order, kept ones with their JSON; what a report folder is written from."""
    item = F.when(F.col("status") == KEPT, F.to_json(F.struct(*FINDING_COLUMNS), _WITH_NULLS))
    rows = in_scan_order(scan.safe_matches, SCAN_ORDER)
    return rows.select("status", "severity", item.alias("item"), "rule_id", F.lit(None).cast("string").alias("rule"))


def write_json_report(scan: Scan, path: str, size: int = DOCUMENT_SIZE) -> None:
    """A report folder: documents of up to ``size`` findings, and an index with the counts of the run.

    Lines are searched once. Files and lines are counted before, by a job that searches nothing, as a
    count of distinct files cannot be had on the way and counters on the way count repeated tasks twice.
    """
    now = datetime.now(UTC).isoformat(timespec="microseconds")
    head = {"version": credsieve.__version__, "generated_at": now, "scan_mode": scan.mode, "target": scan.target}
    write_folder(report_rows(scan), path, "json", head, size, scan.scanned.first().asDict())


def write_findings(scan: Scan, path: str) -> None:
    """One object per line; the form for any number of findings."""
    finding_json(scan.safe_findings).write.mode("overwrite").text(path)
