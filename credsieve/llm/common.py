"""What several operators share: reading and stashing tables, words and their hashes."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from credsieve.scratch import shared_folder

# Words are runs of anything but these, the ASCII white space that ``bytes.split`` knows.
SPACE = b" \t\n\x0b\x0c\r"
REMEMBERED = 1 << 18
# Spark's setting for shuffle files that go as soon as the query that made them is over.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module: str) -> None:
    """Send a module's functions to the workers by value, so they need not find the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Shuffle files of the write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, purpose), spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; the whole sequence if it is shorter."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = (total + words[k : n - width + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return mixed(total)


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of the ASCII-lower-cased text."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(known.of(text.encode("utf-8", "surrogatepass").lower().split()), width))


def min_hashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a non-empty set, in slices of bounded size."""
    least = None
    for at in range(0, len(shingles), 2048):
        part = (shingles[None, at : at + 2048] * factors[:, None] + offsets[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, count, np.uint64)


ship(__name__)
