"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into segments, each indexed by its value. Two codes that differ in no more than
``segments * (r + 1) - 1`` bits differ in at most r bits of some segment. So segment values at distance
0, 1, 2 ... from the query's are looked up, what they hold is verified, and a query is done as soon as
its k-th verified distance is provably covered by the radius reached. Rounds are for all queries that
are still open; verified neighbours are carried along, so a round looks up only its own radius.

Equal codes are one entry with their smallest ids, and equal queries one query.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsieve.llm.common import stash

BITS = 64
SEGMENTS = 4
SALTS = 64


def sign_code(embedding: str, bits: int = BITS) -> Column:
    """The signs of the first ``bits`` coordinates as a long; null for a null or empty vector.

    A coordinate that is null, NaN's sign or not above zero gives 0.
    """
    bit = "(x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L)"
    code = F.expr(f"aggregate(transform(slice(`{embedding}`, 1, {bits}), {bit}), 0L, (a, b) -> a | b)")
    return F.when(F.size(embedding) > 0, code)


def smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """Rows of ``code, id`` that are among a code's ``most`` smallest ids.

    A code that many rows share is cut down within salted parts first, then as a whole.
    """
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for key in (["code", "salt"], ["code"]):
        salted = salted.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("id"))).filter(F.col("n") <= most)
    return salted.select("code", "id")


def segment_keys(code: Column, segments: int) -> list[Column]:
    """Number and value of each segment in one long."""
    width = BITS // segments
    value = lambda j: F.shiftrightunsigned(code, j * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return [value(j) + F.lit(j << width).cast("long") for j in range(segments)]


def masks(width: int, radius: int) -> Column:
    """All values of ``width`` bits with ``radius`` bits set, as one constant."""
    values = ",".join(str(sum(1 << b for b in chosen)) for chosen in combinations(range(width), radius))
    return F.split(F.lit(values), ",").cast("array<long>")


def nearest(codes: DataFrame, queries: DataFrame, key: str, code: str, k: int, segments: int = SEGMENTS) -> DataFrame:
    """``query_id, neighbour_id, distance, rank``: the k nearest other rows of ``codes`` for each row of
    ``queries``, by distance, then id. Both tables have ``key`` and ``code`` columns.

    Rows with a null key or code are neither found nor searched for. Repeated rows count once. With
    fewer than k other rows all of them are returned. A query's own id is never its neighbour. Empty
    tables give no rows. ``segments`` divides 64; about 64 / log2(rows) is best.
    """
    width = BITS // segments
    rows = codes.select(F.col(code).cast("long").alias("code"), F.col(key).cast("long").alias("id")).dropna()
    wanted = queries.select(F.col(key).cast("long").alias("query_id"), F.col(code).cast("long").alias("query")).dropna().distinct()
    index = stash(smallest_ids(rows, k + 1), "hamming-index")
    total = index.count()
    buckets = index.select("code").distinct().select(F.explode(F.array(*segment_keys(F.col("code"), segments))).alias("key"), "code")
    buckets = stash(buckets, "hamming-buckets")
    need = min(k + 1, total)
    best = stash(wanted.select("query").distinct().select("query", F.lit(None).cast("int").alias("distance"), F.lit(None).cast("long").alias("id"), F.lit(False).alias("done")), "hamming-best")
    for radius in range(width + 1):
        covered = segments * (radius + 1) - 1
        best = stash(grown(best, buckets, index, need, radius, covered if radius < width else BITS, segments), "hamming-best")
        if not total or best.filter(~F.col("done")).isEmpty():
            break
    found = wanted.join(best.filter(F.col("id").isNotNull()).select("query", "distance", "id"), "query").filter(F.col("id") != F.col("query_id"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias("neighbour_id"), "distance", "rank")


def grown(best: DataFrame, buckets: DataFrame, index: DataFrame, need: int, radius: int, covered: int, segments: int) -> DataFrame:
    """``best`` after a further radius: open queries' neighbours so far and the bucket's, verified."""
    width = BITS // segments
    done, open_rows = best.filter("done"), best.filter(~F.col("done"))
    verified = open_rows.filter(F.col("id").isNotNull()).select("query", "distance", "id")
    state = open_rows.groupBy("query").agg(F.max("distance").alias("farthest"), F.count("id").alias("n"))
    state = state.select("query", F.when(F.col("n") >= need, F.col("farthest")).otherwise(BITS).alias("limit"))
    probes = state.select("query", "limit", F.explode(F.array(*segment_keys(F.col("query"), segments))).alias("key"))
    probes = probes.select("query", "limit", "key", F.explode(masks(width, radius)).alias("mask"))
    probes = probes.select("query", "limit", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
    # Probes look as small to the planner as the queries they were exploded from; they must not be broadcast.
    near = probes.hint("merge").join(buckets.hint("merge"), "key").withColumn("distance", apart).filter(F.col("distance") <= F.col("limit"))
    near = near.select("query", "distance", "code").distinct().hint("merge").join(index.hint("merge"), "code").select("query", "distance", "id")
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    kept = verified.union(near).distinct().withColumn("place", place).filter(F.col("place") <= need).drop("place")
    open_queries = open_rows.select("query").distinct()
    kept = open_queries.hint("merge").join(kept.hint("merge"), "query", "left")
    per = W.partitionBy("query")
    settled = (F.count("id").over(per) >= need) & (F.max("distance").over(per) <= covered)
    return kept.select("query", "distance", "id", F.coalesce(settled, F.lit(False)).alias("done")).union(done.select("query", "distance", "id", "done"))
