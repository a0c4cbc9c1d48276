"""Counts over a scan, the pass/fail gate, and ordered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.config import EntropySettings
from credsieve.functions.masking import preview
from credsieve.functions.severity import severity_rank
from credsieve.operators.suppress import KEPT
from credsieve.schema import SCAN_ORDER
from credsieve.scratch import stored


class SecretsFound(RuntimeError):
    """A gated scan has findings."""


def by_severity(matches: DataFrame) -> DataFrame:
    return matches.groupBy("severity").agg(
        F.count_if(F.col("status") == KEPT).alias("findings"),
        F.count_if(F.col("status") != KEPT).alias("suppressed"),
    )


def scan_key() -> Column:
    return F.struct(*SCAN_ORDER)


def first_per_rule(matches: DataFrame) -> DataFrame:
    """The first kept finding of every rule, in scan order."""
    first = F.min_by(
        F.struct("rule_name", "severity", "match_type", "file_path", "line_number", "column_start"),
        scan_key(),
    )
    return (
        matches.filter(F.col("status") == KEPT)
        .groupBy("rule_id")
        .agg(first.alias("first"), F.count("*").alias("findings"))
        .select("rule_id", "first.*", "findings")
    )


def gate(summary: DataFrame, fail_on_findings: bool = True) -> DataFrame:
    """``has_findings`` and the exit code a job should end with."""
    found = F.col("total") > 0
    return summary.select(
        found.alias("has_findings"),
        F.when(found & F.lit(fail_on_findings), 1).otherwise(0).alias("exit_code"),
    )


def assert_clean(summary: DataFrame) -> None:
    """Raise ``SecretsFound`` when the summary counts any finding."""
    row = summary.agg(F.sum("total").alias("total")).first()
    if row["total"]:
        raise SecretsFound(f"{row['total']} finding(s)")


def findings_view(matches: DataFrame) -> DataFrame:
    """Six columns for reading: worst first, then by path and scan order.

    Sorting samples its input first, which would search all lines twice; so the rows are stored when this is called.
    """
    kept = matches.filter(F.col("status") == KEPT)
    shown = {
        "severity": F.upper("severity"),
        "rule": F.col("rule_name"),
        "file": F.col("file_path"),
        "line": F.col("line_number"),
        "secret": F.translate("secret_masked", "*", "•"),
        "preview": preview(F.col("line_preview")),
    }
    order = F.struct(severity_rank(F.col("severity")).alias("rank"), *SCAN_ORDER).alias("order")
    rows = stored(kept.select(order, *[c.alias(n) for n, c in shown.items()]), "view")
    return rows.orderBy(F.col("order.rank").desc(), *[f"order.{n}" for n in SCAN_ORDER]).select(*shown)


def rule_activity(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Every active rule with its hit counts; rules without hits count zero."""
    counts = matches.groupBy("rule_id").agg(
        F.count("*").alias("hits"), F.count_if(F.col("status") == KEPT).alias("findings")
    )
    return rules.join(counts, rules["id"] == counts["rule_id"], "left").select(
        rules["rule_ord"],
        rules["id"],
        rules["name"],
        rules["severity"],
        F.coalesce(F.nullif(rules["description"], F.lit("")), F.lit("—")).alias("description"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


def rule_listing(rules: DataFrame, matches: DataFrame, entropy: EntropySettings) -> DataFrame:
    """``rule_activity`` with the state of the entropy detector beside each rule."""
    return rule_activity(rules, matches).withColumns(
        {"entropy_enabled": F.lit(entropy.enabled), "entropy_threshold": F.lit(float(entropy.threshold))}
    )
