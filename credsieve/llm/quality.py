"""A ledger of quality rules: each rule is evaluated once, as one bit, next to what was measured.

Verdicts are later decisions over the stored bits: a policy is a named, versioned set of rules, a
document is kept if none of the policy's bits is set. Changing a policy or asking what one rule
costs reads the ledger, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import SPACE, WordHashes, ship, window_hashes

SYMBOLS = b"#*$%&|<>"
REPEATED_WINDOW = 3

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper",
]
MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    if len(hashes) < REPEATED_WINDOW + 1:
        return 0
    _, which, counts = np.unique(window_hashes(hashes, REPEATED_WINDOW), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(hashes), bool)
    for k in range(REPEATED_WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def measure_text(text: str | None, known: WordHashes) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACE))
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters, upper = sum_cases(data)
    return (
        len(words),
        len(text) - spaces,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(known.of(words)),
        letters,
        upper,
    )


LOWER_ASCII = bytes(range(97, 123))
UPPER_ASCII = bytes(range(65, 91))


def sum_cases(data: bytes) -> tuple[int, int]:
    """Letters a-z in either case, and those of them in upper case."""
    upper = len(data) - len(data.translate(None, UPPER_ASCII))
    return upper + len(data) - len(data.translate(None, LOWER_ASCII)), upper


@F.pandas_udf(MEASURED)
def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for texts in batches:
        rows = [measure_text(t, known) for t in texts]
        yield pd.DataFrame(rows, columns=MEASURES).astype("int64")


# Bits never change their meaning; a changed rule is a new one with the next free bit.
BITS = {
    "few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "shouting": 4, "short_words": 5,
    "long_words": 6,
}


def rules() -> dict[str, Column]:
    """Does the document fail? Integers throughout; no rule divides."""
    n = {m: F.col(f"measures.{m}") for m in MEASURES}
    return {
        "few_words": n["n_words"] < 50,
        "repeated_words": 100 * n["n_repeat_words"] > 50 * n["n_words"],
        "symbols": 10 * n["n_symbols"] > n["n_words"],
        "repeated_lines": 100 * n["n_dup_lines"] > 50 * n["n_lines"],
        "shouting": 100 * n["n_upper"] > 30 * n["n_letters"],
        "short_words": n["word_chars"] < 2 * n["n_words"],
        "long_words": n["word_chars"] > 12 * n["n_words"],
    }


POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "short_words", "long_words"],
}
CURRENT = "v1"


def mask_of(policy: str | list[str]) -> int:
    return sum(1 << BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``measures`` (a struct) and ``failed`` (one bit for each rule that fails).

    A null or empty text has no words and fails only what that implies. Repeated rows are judged
    each for itself. Columns of ``docs`` with those two names are replaced. No row is lost.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("measures", "failed")])
    bits = [F.when(fails, F.lit(1 << BITS[r])).otherwise(F.lit(0)) for r, fails in rules().items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return kept.withColumn("measures", measured(F.col(text).cast("string"))).withColumn("failed", failed.cast("long"))


def passes(policy: str | list[str], failed: Column | None = None) -> Column:
    """Does the ledger row pass the policy (a name or a list of rules)?"""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(book: DataFrame, policy: str | list[str]) -> DataFrame:
    """For each rule of the policy: documents it fails, those only it fails, and kept without it.

    Documents are counted by bits first, so what is shuffled is bounded by the combinations of bits.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask_of(names)
    counted = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in names]))
    rows = counted.withColumn("each", each).select("failed", "n", "each.*")
    here = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        here(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        here(F.col("failed") == F.col("bit")).alias("n_only"),
        here(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def first_rule(policy: str | list[str]) -> Column:
    """The policy's failing rule with the lowest bit; empty where none fails."""
    names = sorted(POLICIES[policy] if isinstance(policy, str) else policy, key=BITS.get)
    return F.coalesce(*[F.when(F.col("failed").bitwiseAND(F.lit(1 << BITS[r])) != 0, F.lit(r)) for r in names], F.lit(""))


def with_ablations(book: DataFrame, policy: str | list[str]) -> DataFrame:
    """``book`` with ``rule``, the ``first_rule`` of each row, and what ``ablations`` says of it.

    Where no rule fails the rule is empty and the counts are 0; columns of ``book`` with their names are replaced. The
    ledger is read twice, so it should be a stored one. What is joined has one row a rule.
    """
    added = ("rule", "n_failed", "n_only", "n_kept_without")
    rows = book.select(*[c for c in book.columns if c not in added]).withColumn("rule", first_rule(policy))
    joined = rows.join(F.broadcast(ablations(book, policy)), "rule", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in added[1:]]
    return joined.select(*[c for c in rows.columns if c != "rule"], "rule", *counts)


ship(__name__)
