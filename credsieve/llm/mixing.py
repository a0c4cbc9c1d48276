"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Documents of a source stand in order of size. Each is expected ``target / source size`` times; the
sums of these expectations, moved by one offset drawn per source, cross as many integers within a
document as it is emitted. Ordered by size, what is taken differs from the target by less than the
source's largest document.

A position in its source is found without gathering a source: rows are counted by (source, size,
bucket), the counts are summed up along sizes and then along buckets, and only within one bucket are
rows numbered. Buckets are ranges of the key, as many as keep them small when all rows have one size,
so the order is that of (size, key) wherever the ranges are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsieve.llm.common import stash

SEED = "mix"
MOST_TIMES = 3
BUCKET_ROWS = 1_000_000
DRAWN_PER_BUCKET = 50


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset(source: Column) -> Column:
    """A multiple of 2**-20 below 1 for each source, so that adding whole numbers stays exact."""
    name = F.coalesce(F.concat(F.lit(f"{SEED}="), source), F.lit(SEED))
    return F.conv(F.substring(F.sha2(name, 256), 1, 5), 16, 10).cast("double") / (1 << 20)


def source_targets(sizes: DataFrame, most_times: int = MOST_TIMES) -> DataFrame:
    """``source, source_size`` to those and ``target``.

    Weights are 1, 2, 3, repeating, by code point, null last. Sources by ``most_times * size /
    weight``: those before some place stop at their limit and the rest share what is left by weight;
    the share per weight is largest at the right place. One row per source goes through one task.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    limit = F.col("source_size") * most_times
    everything = W.partitionBy()
    before = W.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = weighted.withColumn("share", left.cast("double") / weights)
    level = F.max("share").over(everything) * F.col("weight")
    return share.select("source", "source_size", F.least(limit.cast("double"), level).alias("target"))


def key_ranges(rows: DataFrame, key: str, bucket_rows: int) -> Column:
    """The range of a row's key: 0 and up, in the order of the keys, null first. Cuts come from a sample."""
    count = rows.count()
    buckets = -(-count // bucket_rows)
    if buckets < 2:
        return F.lit(0)
    drawn = rows.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
    drawn = drawn.sample(min(1.0, DRAWN_PER_BUCKET * buckets / count), 6).orderBy("key").collect()
    cuts = [drawn[len(drawn) * k // buckets][0] for k in range(1, buckets)] if drawn else []
    if not cuts:
        return F.lit(0)
    kind = rows.schema[key].dataType
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in dict.fromkeys(cuts)]), lambda c: c <= F.col(key)))


def mix(rows: DataFrame, key: str, source: str, size: str, most_times: int = MOST_TIMES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies``, how often the mix takes each row.

    A null source is a source; a null size is 0. Sources without words have target 0 and are not
    taken. Rows with the same key and size may swap copies, which no result shows. Columns of
    ``rows`` named like the three are replaced. An empty table gives an empty table.
    """
    taken = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    named = rows.select(
        F.struct(*taken).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(source).cast("string").isNull().alias("unnamed"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"),
        key_ranges(rows, key, bucket_rows).alias("bucket"),
        F.col(key).alias("key"),
    )
    cell = ["unnamed", "name", "size", "bucket"]
    counts = stash(named.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    group = ["unnamed", "name"]
    sizes = counts.groupBy(*group).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named_sizes = sizes.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(named_sizes, most_times).select(
        F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target",
        offset(F.col("source")).alias("offset"),
    )
    before = W.partitionBy(*group).orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    by_size = counts.groupBy(*group, "size").agg(F.sum("n").alias("n"))
    by_size = by_size.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    before = W.partitionBy(*group, "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    cells = cells.join(by_size, [*group, "size"]).join(targets, group)
    cells = cells.select(
        *cell, (F.col("first") + F.col("before")).alias("first"), "source_size", "target", "offset",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    place = F.col("first") + F.row_number().over(W.partitionBy(*cell).orderBy("key"))
    crossed = lambda i: F.floor(F.col("offset") + F.col("rate") * i)
    copies = F.least(crossed(F.col("place")) - crossed(F.col("place") - 1), F.ceil("rate"))
    placed = named.join(cells, cell).withColumn("place", place)
    return placed.select("row.*", "source_size", "target", copies.cast("long").alias("copies"))
