"""Text columns as numbered lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.operators.suppress import mark_ignored

# What ends a line besides "\n".
OTHER_LINE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
LINE_END = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; a line end at the very end opens no further line.

    Most texts end lines with "\\n" only, and a plain one-character split is several times
    faster than one on a pattern, so the pattern is kept for texts that need it.
    """
    mixed = reduce(Column.__or__, [text.contains(c) for c in OTHER_LINE_ENDS])
    parts = F.when(mixed, F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    return F.transform(F.array(parts), _without_last_empty)[0]


def _without_last_empty(parts: Column) -> Column:
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def lines_from_text(
    texts: DataFrame,
    path: Column | str,
    text: Column | str,
    *,
    ignore: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Numbered lines of every row's text.

    With ``ignore`` the path globs are tried once per text and not once per line. ``keep`` names
    columns to carry along.
    """
    path = F.col(path) if isinstance(path, str) else path
    text = F.col(text) if isinstance(text, str) else text
    rows = texts.select(path.alias("file_path"), text.alias("_text"), *keep)
    extra = list(keep)
    if ignore is not None:
        rows = mark_ignored(rows, ignore)
        extra.append("path_ignored")
    lines = rows.select("file_path", *extra, F.posexplode(split_lines(F.col("_text"))))
    return lines.select(
        "file_path", (F.col("pos") + 1).alias("line_number"), F.col("col").alias("content"), *extra
    )
