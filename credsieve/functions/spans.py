"""Where a pattern matches on a line.

Spark has no built-in for all match positions. Each match is therefore extracted twice, alone and with all
text since the match before it; running sums over the lengths of the latter give every offset. ``split``
would give the gaps as well, but compiles the pattern anew for every line.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.lets import let
from credsieve.schema import SPAN

# A running sum grows its result array step by step; doing so in blocks keeps a line with very
# many matches (a minified file, a whole document on one line) from going quadratic. What a block
# adds is summed once and carried on. Blocks have this many matches, or the cube root of all if that is more.
BLOCK = 16


def find_spans(content: Column, regex: Column, grouped: Column | bool) -> Column:
    """All matches of ``regex`` as an array of (value, column_start, column_end).

    ``grouped`` patterns capture the text before the value as group 1 and the value as group 2. A pattern
    must not match the empty string.
    """
    return let(found_parts(content, regex, grouped), place_parts)


def found_parts(content: Column, regex: Column, grouped: Column | bool) -> Column:
    """What ``place_parts`` needs of all matches. The pattern is compiled once only if it is a constant."""
    grouped = grouped if isinstance(grouped, Column) else F.lit(grouped)
    with_gap = F.concat(F.lit("\\G(?s:.*?)(?:"), regex, F.lit(")"))
    return F.struct(
        F.regexp_extract_all(content, regex, 0).alias("whole"),
        F.regexp_extract_all(content, with_gap, 0).alias("reach"),
        F.when(grouped, F.regexp_extract_all(content, regex, 1)).alias("lead"),
        F.when(grouped, F.regexp_extract_all(content, regex, 2)).alias("value"),
    )


def place_parts(found: Column) -> Column:
    """The spans of ``found_parts``; ``found`` has to be bound."""
    return _placed(
        F.transform(
            found["whole"],
            lambda w, i: F.struct(
                F.coalesce(found["value"][i], w).alias("value"),
                (F.length(found["reach"][i]) - F.length(w) + F.coalesce(F.length(found["lead"][i]), F.lit(0))).alias("skip"),
                F.length(found["reach"][i]).alias("step"),
            ),
        )
    )


def _span(part: Column, at: Column) -> Column:
    return F.struct(
        part["value"].alias("value"),
        (at + part["skip"]).alias("column_start"),
        (at + part["skip"] + F.length(part["value"])).alias("column_end"),
    )


def _placed(parts: Column) -> Column:
    """Turn (value, skip, step) parts into spans; ``step`` is the distance to the next part."""
    empty = F.array().cast(f"array<{SPAN.simpleString()}>")

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda a, p: a + p["step"])

    def run(items: Column, base: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(base.alias("at"), empty.alias("spans")),
            lambda a, p: F.struct(
                (a["at"] + p["step"]).alias("at"), F.array_append(a["spans"], _span(p, a["at"])).alias("spans")
            ),
            lambda a: a["spans"],
        )

    def block(items: Column, b: Column, size: Column) -> Column:
        return F.slice(items, b * size + 1, size)

    def blocks(items: Column, size: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))

    def bases(items: Column, size: Column) -> Column:
        """Where each block begins."""
        return F.aggregate(
            blocks(items, size),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, b: F.struct(
                (a["at"] + total(block(items, b, size))).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")
            ),
            lambda a: a["starts"],
        )

    def in_blocks(items: Column, size: Column) -> Column:
        return F.flatten(F.transform(bases(items, size), lambda base, b: run(block(items, b, size), base)))

    def placed(items: Column) -> Column:
        n = F.size(items)
        size = F.greatest(F.lit(BLOCK), F.ceil(F.cbrt(n)).cast("int"))
        return (
            F.when(n <= 1, F.transform(items, lambda p: _span(p, F.lit(0))))
            .when(n <= BLOCK, run(items, F.lit(0)))
            .otherwise(let(size, lambda s: in_blocks(items, s)))
        )

    return let(parts, placed)


def overlaps(a: Column, b: Column) -> Column:
    return (a["column_start"] < b["column_end"]) & (a["column_end"] > b["column_start"])
