"""Severity rank and report level."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in ascending rank, and the report level of each.
RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
OTHER_LEVEL = "warning"


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def report_level(severity: Column) -> Column:
    out = F.lit(OTHER_LEVEL)
    for name, level in LEVEL.items():
        out = F.when(severity == name, F.lit(level)).otherwise(out)
    return out
