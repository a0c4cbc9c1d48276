"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of band hashes are drawn, each band made of a few minhashes. A table key is a
pair of bands, one from each collection, so ``bands ** 2`` tables of ``2 * rows`` minhashes cost only
``2 * bands * rows`` minhashes. A pair of similarity s meets in some table with probability
``(1 - (1 - s ** rows) ** bands) ** 2``: 0.9999 at 0.75 with 18 bands of 3, and 1 - 1e-5 at 0.8.

A document can meet another in a table only if it meets one in each collection, so single bands
are matched first and only those that two groups of documents still share are paired up to table
keys. Copies of one original, edited each in its own way, share bands and may still be unlike each
other. How many shingles a document has that no other candidate has tells the original from them, which
makes it the bucket's pivot. Of pairs that are still open, those that share a rare shingle are found by
it, and others only compared if what they have besides rare shingles suffices (``open_pairs``).
Candidates have to agree in half of the minhashes or so (a bound that a true link misses once
in 10**9), and every link is confirmed on the full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm import linking
from credsieve.llm.common import WordHashes, hash_family, min_hashes, mixed, shingle_set, ship, stash

WIDTH = 5
PERCENT = 75
ROWS, BANDS = 3, 18
LOSS = 1e-9
RARE = 8


def least_agreement(count: int, percent: int, loss: float = LOSS) -> int:
    """The largest number of equal minhashes that a pair at the threshold misses with ``loss`` at most."""
    p, below = percent / 100, 0.0
    for k in range(count + 1):
        below += comb(count, k) * p**k * (1 - p) ** (count - k)
        if below > loss:
            return k
    return count


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` minhashes, of one set or of one a row; equal runs in other places differ."""
    bands = minima.reshape(*minima.shape[:-1], -1, rows)
    keys = np.arange(1, bands.shape[-2] + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys ^ bands[..., k])
    return keys


def signature_udf(width: int, rows: int, bands: int, seed: int):
    """Text to set size, a digest of the set, band keys and one byte of each minhash."""

    @F.pandas_udf("n int, digest binary, bands array<long>, marks binary")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        known, (factors, offsets) = WordHashes(), hash_family(rows * bands, seed)
        for texts in batches:
            out = []
            for text in texts:
                s = shingle_set(text, width, known)
                if len(s):
                    minima = min_hashes(s, factors, offsets)
                    keys = band_keys(minima, rows).view(np.int64)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys, minima.astype(np.uint8).tobytes()))
                else:
                    out.append((0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "digest", "bands", "marks"])

    return signature


@F.pandas_udf(T.IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many bytes of two strings of one length are equal."""
    if not len(a):
        return pd.Series([], dtype="int32")
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
    return pd.Series((left == right).sum(axis=1).astype(np.int32))


def shingles_udf(width: int):
    """Text to its set of shingle hashes."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordHashes()
        for texts in batches:
            yield pd.Series([shingle_set(t, width, known).view(np.int64) for t in texts], dtype=object)

    return shingles


@F.pandas_udf(T.LongType())
def common_shingles(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sets."""
    return pd.Series([len(np.intersect1d(x, y, True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Jaccard similarity of at least ``percent``, in integers."""
    return 100 * common >= percent * (a + b - common)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity and whose minhashes agree often enough."""
    facts = lambda side: nodes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("marks").alias(f"marks_{side}"))
    known = pairs.join(facts("a"), "a").join(facts("b"), "b")
    sized = known.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    close = sized.filter(agreement("marks_a", "marks_b") >= least_agreement(count, percent))
    return close.select("a", "b", "n_a", "n_b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, n_a, n_b`` those that are similar on their full sets (``id, set``)."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = common_shingles("set_a", "set_b")
    return both.filter(similar(shared, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def loneliness(sets: DataFrame) -> DataFrame:
    """``id, apart``: how many shingles of a set are in no other, larger sets first of equal ones."""
    rows = sets.select("id", F.explode("set").alias("shingle"))
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id")).filter(F.col("times") == 1)
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    known = sets.select("id", F.size("set").alias("n")).join(alone, "id", "left")
    return known.select("id", F.struct(F.coalesce("alone", F.lit(0)).alias("alone"), (-F.col("n")).alias("n")).alias("apart"))


def open_pairs(rows: DataFrame, sets: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs across the groups of ``contested`` rows that can still be links.

    Two sets either share a shingle that ``rare`` contested sets or fewer have, and meet in that one's
    short list; or they share only others, of which each must then have enough. The second kind of
    pairs is looked for in the buckets, each in the first one it shares. Both ways together leave out no pair of a bucket that can be
    similar enough, whatever ``rare`` is.
    """
    ids = stash(rows.select("id", "component").distinct(), "contested-ids")
    chosen = sets.join(ids.select("id"), "id", "left_semi")
    shingles = chosen.select("id", F.explode("set").alias("shingle"))
    listed = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") <= rare)
    listed = stash(shingles.join(listed, "shingle"), "rare-shingles")
    few = listed.groupBy("id").agg(F.count(F.lit(1)).alias("few"))
    facts = chosen.select("id", F.size("set").alias("n")).join(few, "id", "left")
    facts = facts.select("id", "n", (F.col("n") - F.coalesce("few", F.lit(0))).alias("shared"))
    facts = facts.filter(100 * F.col("shared") >= percent * F.col("n"))
    facts = stash(facts.join(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"), "contested-facts")

    def possible(a: str, b: str) -> Column:
        most = F.least(f"{a}shared", f"{b}shared")
        enough = (100 + percent) * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))
        return enough & linking.shared_first(a, b)

    side = lambda s: listed.filter(F.col("times") > 1).join(ids, "id").select("shingle", F.col("id").alias(s), F.col("component").alias(f"of_{s}"))
    met = side("a").join(side("b"), "shingle").filter((F.col("a") > F.col("b")) & (F.col("of_a") != F.col("of_b")))
    return linking.cross_pairs(rows, facts, possible).union(met.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, seed: int = 8
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; a text with fewer than
    ``width`` words is one shingle, one without words (or null) has none and is linked with nothing.
    Documents are linked at a Jaccard similarity of ``percent``; ``component_id`` is the smallest key
    reachable. Equal sets are one node, so copies are counted and not compared. Keys should be
    distinct integers; rows with the same key share a component, a null key is its own and kept.
    Other columns are not looked at. An empty table gives no rows.
    """
    count = 2 * rows * bands
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = texts.select("id", signature_udf(width, rows, 2 * bands, seed)("text").alias("s")).select("id", "s.*")
    base = stash(signed, "minhash")
    classes = base.filter(F.col("n") > 0).groupBy("digest").agg(F.min("id").alias("rep"))
    classes = stash(classes, "minhash-classes")
    heads = classes.filter(F.col("rep").isNotNull()).select("digest", F.col("rep").alias("id"))
    nodes = stash(base.join(heads, ["digest", "id"]).dropDuplicates(["id"]).drop("digest"), "minhash-nodes")
    spread = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    alive = stash(linking.alive_members(spread.select("key", (F.col("band") < bands).alias("first"), "id")), "minhash-alive")

    chosen = texts.join(stash(alive.select("id").distinct(), "minhash-ids"), "id").dropDuplicates(["id"])
    sets = stash(chosen.select("id", shingles_udf(width)("text").alias("set")), "minhash-sets")

    def links(pairs: DataFrame) -> DataFrame:
        close = stash(plausible(pairs, nodes, percent, count), "minhash-pairs")
        return stash(confirm(close, sets, percent), "minhash-links")

    stars = links(linking.star_pairs(alive, stash(loneliness(sets), "minhash-apart")))
    open_bands = linking.undecided(linking.in_groups(alive, linking.components(stars)))
    side = lambda first: F.collect_set(F.when(F.col("first") == first, F.col("key")))
    sides = open_bands.groupBy("id", "component").agg(side(True).alias("one"), side(False).alias("two"))
    paired = sides.select("id", "component", F.explode("one").alias("one"), "two")
    paired = paired.select("id", "component", "one", F.explode("two").alias("two"))
    rows = linking.contested(paired.select(F.xxhash64("one", "two").alias("key"), "id", "component"))
    more = links(open_pairs(rows, sets, percent))
    groups = linking.components(stars.union(more))
    found = base.select("id", "n", "digest").join(classes, "digest", "left")
    found = found.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return found.select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


ship(__name__)
