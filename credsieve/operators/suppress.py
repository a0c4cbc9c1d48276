"""Suppression: ignored paths, allowlisted values, baselined fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions.dialect import NoJvmForm, jvm_pattern
from credsieve.functions.paths import ignored_by
from credsieve.operators.exact import allowed_by_python

KEPT, ALLOWED, BASELINED = "kept", "allowlist", "baseline"


def mark_ignored(df: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Add ``path_ignored``, unless an earlier step did it on fewer rows."""
    if "path_ignored" in df.columns:
        return df
    return df.withColumn("path_ignored", ignored_by(F.col("file_path"), list(globs)))


def drop_ignored(df: DataFrame, globs: Sequence[str]) -> DataFrame:
    return df.filter(~ignored_by(F.col("file_path"), list(globs)))


def is_allowed(raw_value: Column, patterns: Sequence[str]) -> Column:
    """True where any allowlist pattern is found anywhere in the value."""
    python: list[str] = []
    test = F.lit(False)
    for p in patterns:
        try:
            test = test | raw_value.rlike(jvm_pattern(p).regex)
        except NoJvmForm:
            python.append(p)
    if python:
        test = test | allowed_by_python(python, raw_value)
    return test


def mark_baselined(df: DataFrame, baseline: DataFrame | None, key: Column | None = None) -> DataFrame:
    """Add ``in_baseline`` by a left join on the fingerprint.

    No broadcast is forced: a baseline grows with what it covers, so Spark decides by its size.
    ``key`` replaces the fingerprint as join key where many rows have none.
    """
    if baseline is None:
        return df.withColumn("in_baseline", F.lit(False))
    known = (
        baseline.select(F.col("fingerprint").alias("_known"))
        .filter(F.col("_known").isNotNull())
        .distinct()
    )
    key = F.col("fingerprint") if key is None else key
    return df.join(known, key == F.col("_known"), "left").select(
        *df.columns, F.col("_known").isNotNull().alias("in_baseline")
    )


def drop_baselined(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lacks."""
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def status(allowed: Column, in_baseline: Column) -> Column:
    return F.when(allowed, ALLOWED).when(in_baseline, BASELINED).otherwise(KEPT)
