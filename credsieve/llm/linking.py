"""From buckets of candidates to connected groups, without ever listing all pairs of a bucket.

A bucket's members are first compared with a few pivots only. Whoever is linked to it shares its group.
After that the sole pairs that can still join groups lie across groups of one bucket, and those are
compared in full: each member outside the bucket's largest group with all members of other groups.
So no link is lost, and a bucket of many copies costs as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ship, stash

MOST_ROUNDS = 200
PIVOTS = 3


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``id, component``, the smallest id reachable; only linked ids have rows.

    Alternating large and small stars: every node hands its larger neighbours, then its smaller
    ones, to the smallest id it sees, until nothing moves. Each round is a written table. A hub with
    many neighbours is summed up before the shuffle and joined back by a join Spark may split.
    Loops (a = b), repeated links and links with a null are ignored.
    """
    edges = links.filter(F.col("a") != F.col("b"))
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stash(edges, "component-links"), None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter(F.col("v") != F.col("m")).select("v", "m")
        edges = stash(small.select("u", "m").union(moved).distinct().toDF("u", "v"), "component-stars")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.toDF("id", "component").union(roots.select("v", "v"))


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, id) the first of each (key, id), where a key has two ids or more.

    Only the last row is held from batch to batch, however many rows a key has.
    """
    held, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key, id_ = rows["key"].to_numpy(), rows["id"].to_numpy()
        other = key[1:] != key[:-1]
        starts = np.flatnonzero(np.append(True, other))
        ends = np.append(starts[1:], len(key))
        shared = id_[starts] != id_[ends - 1]
        shared[0] |= told
        new = np.append(not told, other | (id_[1:] != id_[:-1]))
        chosen = new & np.repeat(shared, ends - starts)
        # The last row of a bucket that is not known to be shared yet waits for the next batch.
        yield from rows.filter(pa.array(chosen)).combine_chunks().to_batches()
        held, told = rows.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(shared[-1])


def alive_members(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (``key, id`` and what these two settle) whose bucket has two ids or more, each once.

    All rows are shuffled and sorted once; a bucket is gone through row by row and never held. Neither key nor id is null.
    """
    return members.repartition("key").sortWithinPartitions("key", "id").mapInArrow(shared_buckets, members.schema)


def star_pairs(alive: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """Each id with the pivots of its buckets.

    ``apart`` says of each id how far from all others it is; the least apart of a bucket is one pivot,
    as it is linked to most, and some are drawn by a hash that differs from bucket to bucket, so an id
    meets many members of its group over all its buckets. Without it all are equally far apart.
    """
    drawn = [F.min(F.struct(F.xxhash64("key", "id", F.lit(k)).alias("h"), "id")).alias(f"drawn{k}") for k in range(PIVOTS)]
    members = alive.select("key", "id")
    ranked = members.withColumn("apart", F.lit(0)) if apart is None else members.join(apart, "id")
    pivots = ranked.groupBy("key").agg(F.min(F.struct("apart", "id")).alias("least"), *drawn)
    chosen = F.array_distinct(F.array("least.id", *[f"drawn{k}.id" for k in range(PIVOTS)]))
    pairs = alive.select("key", "id").join(pivots.select("key", chosen.alias("pivots")), "key")
    pairs = pairs.select("id", F.explode("pivots").alias("pivot")).filter(F.col("id") != F.col("pivot"))
    return pairs.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()


def in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``component``, an id without links being its own."""
    return rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def undecided(members: DataFrame) -> DataFrame:
    """Rows of ``key, id, component`` in buckets that hold two groups or more."""
    seen = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return members.join(seen.filter(F.col("lo") != F.col("hi")).select("key"), "key", "left_semi")


def contested(members: DataFrame) -> DataFrame:
    """Rows of ``key, id, component`` in buckets of several groups, with the largest group as ``main``."""
    groups = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("groups"))
    main = main.filter(F.col("groups") > 1).select("key", F.col("main.component").alias("main"))
    return stash(members.join(main, "key").select("key", "id", "component", "main"), "contested")


def shared_first(a: str, b: str) -> Column:
    """Is this bucket the first that both sides are in? Their columns ``keys`` list the buckets of each."""
    return F.array_min(F.array_intersect(f"{a}keys", f"{b}keys")) == F.col("key")


def cross_pairs(rows: DataFrame, facts: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """All pairs of one bucket of ``contested`` rows whose groups differ, once for each bucket they share.

    ``facts`` has an id's columns for ``possible``, which gets the prefixes of both sides' columns and
    must hold for every pair that can be linked.
    """
    names = [c for c in facts.columns if c != "id"]
    known = rows.join(facts, "id")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in names]
    strays = known.filter(F.col("component") != F.col("main"))
    strays = strays.select("key", F.col("id").alias("a"), F.col("component").alias("of_a"), *side("a"))
    others = known.select("key", F.col("id").alias("b"), F.col("component").alias("of_b"), "main", *side("b"))
    once = (F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = strays.join(others, "key").filter((F.col("of_a") != F.col("of_b")) & once & possible("a_", "b_"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


ship(__name__)
