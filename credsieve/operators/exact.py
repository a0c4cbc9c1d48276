"""Rules on Python's own ``re``, in Arrow batches.

For patterns without an exact JVM form only. The worker sees just the lines that passed the
guards and returns their hits; partitioning and everything after stays with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.config import RegexRule
from credsieve.schema import HIT


def exact_hits(rules: Sequence[tuple[int, RegexRule]], content: Column) -> Column:
    plain = [(i, r.id, r.name, r.severity, r.pattern) for i, r in rules]

    # All nested, so that Spark ships the code itself and workers need no installed package.
    def hits(line: str, ready):
        for rule_ord, rule_id, name, severity, regex in ready:
            for m in regex.finditer(line):
                # The first group where it took part, else the whole match.
                g = 1 if regex.groups and m.start(1) >= 0 else 0
                yield {
                    "rule_id": rule_id,
                    "rule_name": name,
                    "severity": severity,
                    "match_type": "regex",
                    "raw_value": m.group(g),
                    "column_start": m.start(g),
                    "column_end": m.end(g),
                    "engine_rank": 0,
                    "rule_ord": rule_ord,
                }

    @F.pandas_udf(f"array<{HIT.simpleString()}>")
    def search(lines: pd.Series) -> pd.Series:
        ready = [(i, rid, name, sev, re.compile(p)) for i, rid, name, sev, p in plain]
        return lines.map(lambda s: [] if s is None else list(hits(s, ready)))

    return search(content)


def allowed_by_python(patterns: Sequence[str], value: Column) -> Column:
    """``re.search`` of any pattern in the value, for allowlist patterns without a JVM form."""
    texts = list(patterns)

    @F.pandas_udf("boolean")
    def search(values: pd.Series) -> pd.Series:
        ready = [re.compile(p) for p in texts]
        return values.map(lambda v: v is not None and any(r.search(v) for r in ready))

    return search(value)
