"""SARIF 2.1.0 reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import credsieve
from credsieve.functions.severity import report_level
from credsieve.operators.suppress import KEPT
from credsieve.plans.scan import Scan
from credsieve.schema import SCAN_ORDER
from credsieve.sinks.chunks import counts_of, found_once, in_chunks
from credsieve.sinks.folders import in_scan_order, write_folder

# Fixed values of the format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
)
TOOL = "credsieve"
TAGS = ("security", "secret-detection")
DOCUMENT_SIZE = 5_000
_WITH_NULLS = {"ignoreNullFields": "false"}


def message_text(rule_name: Column, secret_masked: Column) -> Column:
    return F.concat(
        rule_name,
        F.lit(" found, masked as "),
        secret_masked,
        F.lit("; revoke it and issue a new one"),
    )


def rule_text(rule_id: Column, match_type: Column) -> Column:
    return F.concat(F.lit(f"{TOOL}: "), match_type, F.lit(" rule "), rule_id)


def result_columns(findings: DataFrame) -> DataFrame:
    """The fields of a SARIF result, flat; columns count from one."""
    return findings.select(
        F.col("rule_id").alias("ruleId"),
        report_level(F.col("severity")).alias("level"),
        message_text(F.col("rule_name"), F.col("secret_masked")).alias("message"),
        F.col("file_path").alias("uri"),
        F.col("line_number").alias("startLine"),
        (F.col("column_start") + 1).alias("startColumn"),
        (F.col("column_end") + 1).alias("endColumn"),
        F.col("line_preview").alias("snippet"),
        "fingerprint",
        "severity",
        F.col("match_type").alias("matchType"),
        F.col("secret_masked").alias("secretMasked"),
        "author",
        F.col("commit_hash").alias("commitHash"),
    )


def result_struct() -> Column:
    """A finding as a SARIF result."""
    place = F.struct(
        F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias(
            "artifactLocation"
        ),
        F.struct(
            F.col("line_number").alias("startLine"),
            (F.col("column_start") + 1).alias("startColumn"),
            (F.col("column_end") + 1).alias("endColumn"),
            F.struct(F.col("line_preview").alias("text")).alias("snippet"),
        ).alias("region"),
    )
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        report_level(F.col("severity")).alias("level"),
        F.struct(message_text(F.col("rule_name"), F.col("secret_masked")).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias(f"{TOOL}/v1")).alias("fingerprints"),
        F.struct(
            "severity",
            F.col("match_type").alias("matchType"),
            F.col("secret_masked").alias("secretMasked"),
            "author",
            F.col("commit_hash").alias("commitHash"),
        ).alias("properties"),
    )


def rule_struct() -> Column:
    """What SARIF wants to know about the rule of a finding."""
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        F.struct(F.col("rule_name").alias("text")).alias("shortDescription"),
        F.struct(rule_text(F.col("rule_id"), F.col("match_type")).alias("text")).alias("fullDescription"),
        F.struct(report_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(
            F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
            "severity",
            F.col("match_type").alias("matchType"),
        ).alias("properties"),
    )


def rule_columns(matches: DataFrame) -> DataFrame:
    """One flat row per rule with a kept finding, described by its first finding in scan order."""
    first = F.min_by(F.struct("rule_name", "severity", "match_type"), F.struct(*SCAN_ORDER))
    kept = matches.filter(F.col("status") == KEPT)
    return (
        kept.groupBy("rule_id")
        .agg(first.alias("first"))
        .select(
            F.col("rule_id").alias("id"),
            F.col("first.rule_name").alias("name"),
            rule_text(F.col("rule_id"), F.col("first.match_type")).alias("fullDescription"),
            report_level(F.col("first.severity")).alias("level"),
            F.col("first.severity").alias("severity"),
            F.col("first.match_type").alias("matchType"),
        )
    )


def sarif_documents(scan: Scan, size: int = DOCUMENT_SIZE) -> DataFrame:
    """SARIF logs in column ``value``, each with up to ``size`` results and the rules they use.

    Consumers bound the results of one run, and a cluster must bound one group, so a large scan
    gives several logs; a clean one gives a log without results. Lines are searched once, when this is called.
    """
    found = found_once(scan)
    rows = in_chunks(found.filter(F.col("status") == KEPT), SCAN_ORDER, size).select(
        "chunk", *SCAN_ORDER, result_struct().alias("result"), rule_struct().alias("rule")
    )
    pieces = rows.groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct(*SCAN_ORDER, "result"))).alias("sorted"),
        F.array_sort(F.collect_list(F.struct(*SCAN_ORDER, "rule"))).alias("ruled"),
    )
    pieces = pieces.select(
        F.lit(1).alias("one"),
        F.col("sorted.result").alias("results"),
        F.array_distinct(F.col("ruled.rule")).alias("rules"),
    )
    # A rule is described by its first finding.
    pieces = pieces.withColumn(
        "rules", F.filter("rules", lambda r, i: F.array_position("rules.id", r["id"]) == i + 1)
    )
    counts = counts_of(scan, found)
    head = counts.select("scan_mode", "target", "suppressed", "total").withColumn("one", F.lit(1))
    full = pieces.join(F.broadcast(head), "one").drop("one", "total")
    clean = head.filter(F.col("total") == 0).select(
        "scan_mode",
        "target",
        "suppressed",
        F.array().cast(pieces.schema["results"].dataType).alias("results"),
        F.array().cast(pieces.schema["rules"].dataType).alias("rules"),
    )
    run = F.struct(
        F.struct(
            F.struct(
                F.lit(TOOL).alias("name"), F.lit(credsieve.__version__).alias("version"), "rules"
            ).alias("driver")
        ).alias("tool"),
        "results",
        F.struct(
            F.col("scan_mode").alias("scanMode"),
            "target",
            F.col("suppressed").alias("suppressedCount"),
        ).alias("properties"),
    )
    return full.unionByName(clean).select(
        F.to_json(
            F.struct(
                F.lit(SARIF_VERSION).alias("version"),
                F.lit(SARIF_SCHEMA).alias("$schema"),
                F.array(run).alias("runs"),
            ),
            _WITH_NULLS,
        ).alias("value")
    )


def log_rows(scan: Scan) -> DataFrame:
    """Matches in scan order, kept ones as SARIF results with their rules."""
    kept = F.col("status") == KEPT
    item, rule = (F.when(kept, F.to_json(c, _WITH_NULLS)) for c in (result_struct(), rule_struct()))
    rows = in_scan_order(scan.safe_matches, SCAN_ORDER)
    return rows.select("status", "severity", item.alias("item"), "rule_id", rule.alias("rule"))


def write_sarif(scan: Scan, path: str, size: int = DOCUMENT_SIZE) -> None:
    """A report folder of SARIF logs with up to ``size`` results each, written by one pass over the lines.

    ``suppressedCount`` of a log is that of its own stretch of matches; the index has the run's.
    """
    head = {
        "log": {"version": SARIF_VERSION, "$schema": SARIF_SCHEMA},
        "tool": {"name": TOOL, "version": credsieve.__version__},
        "properties": {"scanMode": scan.mode, "target": scan.target},
    }
    write_folder(log_rows(scan), path, "sarif", head, size)
