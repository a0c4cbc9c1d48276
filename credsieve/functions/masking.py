"""Masking, redaction and fingerprints."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.dialect import SPACE_CHARS

# How much of a secret stays readable.
SHOWN_HEAD = 4
SHOWN_TAIL = 4
SMALLEST_MASK = 3
SHORTEST_WITH_TAIL = 12
EMPTY_MASK = "****"
PREVIEW_CHARS = 80


def mask_secret(value: Column) -> Column:
    """First four characters, stars, and the last four when the value has twelve or more."""
    n = F.length(value)
    head = F.left(value, F.lit(SHOWN_HEAD))
    return (
        F.when(value.isNull() | (n <= SHOWN_HEAD), F.lit(EMPTY_MASK))
        .when(
            n >= SHORTEST_WITH_TAIL,
            F.concat(
                head,
                F.repeat(F.lit("*"), n - (SHOWN_HEAD + SHOWN_TAIL)),
                F.right(value, F.lit(SHOWN_TAIL)),
            ),
        )
        .otherwise(
            F.concat(head, F.repeat(F.lit("*"), F.greatest(n - SHOWN_HEAD, F.lit(SMALLEST_MASK))))
        )
    )


def cut(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (0-based) up to ``end`` (exclusive)."""
    return F.substring(text, start + 1, end - start)


def redact_line(line: Column, start: Column, end: Column) -> Column:
    """The line with one span masked; a span that does not fit leaves the line as it is."""
    fits = (start >= 0) & (start < end) & (end <= F.length(line))
    return F.when(
        fits,
        F.concat(
            F.left(line, start),
            mask_secret(cut(line, start, end)),
            F.substring(line, end + 1, F.length(line)),
        ),
    ).otherwise(line)


def redact_spans(line: Column, spans: Column) -> Column:
    """The line with every span masked; overlapping spans are masked as one.

    ``spans`` is an array of structs with ``column_start`` and ``column_end``.
    """
    proper = F.filter(
        spans,
        lambda s: (s["column_start"] >= 0)
        & (s["column_start"] < s["column_end"])
        & (s["column_end"] <= F.length(line)),
    )
    ordered = F.array_sort(
        F.transform(
            proper, lambda s: F.struct(s["column_start"].alias("s"), s["column_end"].alias("e"))
        )
    )

    def state(out: Column, done: Column, s: Column, e: Column) -> Column:
        return F.struct(
            out.cast("string").alias("out"),
            done.cast("int").alias("done"),
            s.cast("int").alias("s"),
            e.cast("int").alias("e"),
        )

    def closed(a: Column) -> Column:
        return F.concat(a["out"], cut(line, a["done"], a["s"]), mask_secret(cut(line, a["s"], a["e"])))

    def step(a: Column, x: Column) -> Column:
        return (
            F.when(a["s"].isNull(), state(a["out"], a["done"], x["s"], x["e"]))
            .when(
                x["s"] < a["e"],
                state(a["out"], a["done"], a["s"], F.greatest(a["e"], x["e"])),
            )
            .otherwise(state(closed(a), a["e"], x["s"], x["e"]))
        )

    start = state(F.lit(""), F.lit(0), F.lit(None), F.lit(None))
    return F.aggregate(
        ordered,
        start,
        step,
        lambda a: F.when(a["s"].isNull(), line).otherwise(
            F.concat(closed(a), F.substring(line, a["e"] + 1, F.length(line)))
        ),
    )


def fingerprint(rule_id: Column, file_path: Column, secret_masked: Column) -> Column:
    """Sixteen hex characters that identify a finding across runs (line moves do not change it)."""
    return F.substring(F.sha2(F.concat_ws(":", rule_id, file_path, secret_masked), 256), 1, 16)


def preview(line: Column) -> Column:
    """The line without outer white space, at most eighty characters."""
    return F.left(F.regexp_replace(line, f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\\z", ""), F.lit(PREVIEW_CHARS))
