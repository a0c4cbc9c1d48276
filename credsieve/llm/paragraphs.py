"""Repeated paragraphs across documents by MinHash banding.

Paragraphs are the lines of a text. Those of ``least_words`` words or more get minhashes; bands are
tuned so that a pair at the threshold meets in some band with a wanted probability. Paragraphs that
meet are confirmed on their full sets of shingles, and of each connected group the first occurrence
(smallest document, then place) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsieve.llm import linking
from credsieve.llm.common import WordHashes, hash_family, ship, stash, window_hashes
from credsieve.llm.fuzzy_lines import text_version, without_lines
from credsieve.llm.minhash import PERCENT, WIDTH, band_keys, confirm, loneliness, open_pairs, plausible

LEAST_WORDS = WIDTH
ROWS = 2
RECALL = 0.9999
MARKS = 64
WORDS_AT_ONCE = 1 << 15

FOUND = "doc_id long, version long, paragraph int, n_words int, id long, bands array<long>"
SETS = "id long, set array<long>, marks binary"


def bands_for(percent: int, rows: int, recall: float) -> int:
    """Bands of ``rows`` minhashes by which a pair at the threshold meets with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def long_paragraphs(text: str | None, least_words: int) -> Iterator[tuple[int, list[bytes]]]:
    """Place and lower-cased words of each paragraph with enough words."""
    if text:
        for place, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
            words = line.split()
            if len(words) >= least_words:
                yield place, words


def identity(words: list[bytes]) -> int:
    """64 bits of the words in a row. Of n different paragraphs two share one at odds of n**2 / 2**65."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def all_shingles(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts that stand one after the other, repeated ones too, and where those of each text begin."""
    ends = np.cumsum(sizes)
    if (sizes < width).any():
        parts = [window_hashes(hashes[e - n : e], width) for e, n in zip(ends, sizes, strict=True)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
    inside = np.ones(len(hashes), bool)
    for k in range(1, width):
        inside[ends - k] = False
    return window_hashes(hashes, width)[inside[: len(hashes) - width + 1]], np.append(0, np.cumsum(sizes - width + 1)[:-1])


def least_hashes(shingles: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over each of some non-empty sets, which begin at ``starts``."""
    minima = np.empty((len(starts), len(factors)), np.uint64)
    for k, (f, o) in enumerate(zip(factors, offsets, strict=True)):
        minima[:, k] = np.minimum.reduceat(shingles * f + o, starts)
    return minima


class Signer:
    """Collects paragraphs and signs many at a time."""

    def __init__(self, width: int, rows: int, bands: int, seed: int):
        self.width, self.rows = width, rows
        self.known = WordHashes()
        self.family = [x[: rows * bands] for x in hash_family(max(rows * bands, MARKS), seed)]
        self.places: list[tuple] = []
        self.words: list[bytes] = []

    def add(self, doc_id: int, version: int, place: int, words: list[bytes]) -> None:
        self.places.append((doc_id, version, place, len(words), identity(words)))
        self.words.extend(words)

    def signed(self, schema: pa.Schema) -> pa.RecordBatch:
        sizes = np.asarray([p[3] for p in self.places])
        minima = least_hashes(*all_shingles(self.known.of(self.words), sizes, self.width), *self.family)
        keys = band_keys(minima, self.rows).view(np.int64)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.places, strict=True), schema, strict=False)]
        columns.append(pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], np.int32), keys.ravel()))
        self.places, self.words = [], []
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def sign_worker(least_words: int, width: int, rows: int, bands: int, seed: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("version", pa.int64()), ("paragraph", pa.int32()), ("n_words", pa.int32()), ("id", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width, rows, bands, seed)
        for batch in batches:
            for doc_id, version, text in zip(*batch.columns, strict=True):
                doc_id, version = doc_id.as_py(), version.as_py()
                for place, words in long_paragraphs(text.as_py(), least_words):
                    signer.add(doc_id, version, place, words)
                    if len(signer.words) >= WORDS_AT_ONCE:
                        yield signer.signed(schema)
        if signer.places:
            yield signer.signed(schema)

    return work


def set_worker(least_words: int, width: int, rows: int, bands: int, seed: int):
    """Sets, and one byte of each minhash, of the paragraphs that a document's list of places names."""
    schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64())), ("marks", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, family = WordHashes(), [x[:MARKS] for x in hash_family(max(rows * bands, MARKS), seed)]

        def marked(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, sets)])[:-1]
            marks = [m.tobytes() for m in least_hashes(np.concatenate(sets), starts, *family).astype(np.uint8)] if sets else []
            columns = [pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            ids, sets, held = [], [], 0
            for wanted, text in zip(batch.column(0), batch.column(1), strict=True):
                wanted = set(wanted.as_py())
                for place, words in long_paragraphs(text.as_py(), least_words):
                    if place in wanted:
                        ids.append(identity(words))
                        sets.append(np.unique(window_hashes(known.of(words), width)))
                        held += len(sets[-1])
                    if held > WORDS_AT_ONCE:
                        yield marked(ids, sets)
                        ids, sets, held = [], [], 0
            yield marked(ids, sets)

    return work


def repeated_paragraphs(
    docs: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS, width: int = WIDTH, percent: int = PERCENT,
    rows: int = ROWS, recall: float = RECALL, seed: int = 10,
) -> DataFrame:
    """One row per occurrence of a paragraph that occurs twice or more, exactly or nearly:
    ``doc_id, paragraph`` (its line, from 0), ``n_words, group`` (an id of the connected group),
    ``kept``, true for the group's first occurrence by (doc_id, version, paragraph), and ``version``, the
    ``text_version`` of its text.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. Null and empty texts and
    shorter paragraphs have no rows. Occurrences within one document count. Rows that share a key and a
    text are one document's: the first of equal occurrences is kept once; with other texts they are documents of their own. A null key is last. An empty
    table gives no rows. Other columns are not looked at.
    """
    bands = bands_for(percent, rows, recall)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_version(text).alias("version"), F.col(text).cast("string").alias("text"))
    found = stash(texts.mapInArrow(sign_worker(least_words, width, rows, bands, seed), FOUND), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "paragraph")
    first = found.groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n_times"))
    first = stash(first.select("id", "place.doc_id", "place.version", "place.paragraph", "n_times"), "paragraph-ids")
    members = found.select("id", F.explode("bands").alias("key"))
    alive = stash(linking.alive_members(members), "paragraphs-alive")
    in_bucket = alive.select("id").distinct()

    wanted = first.join(in_bucket, "id").groupBy("doc_id", "version").agg(F.collect_set("paragraph").alias("wanted"))
    chosen = texts.join(stash(wanted, "paragraphs-wanted"), ["doc_id", "version"]).select("wanted", "text")
    sets = stash(chosen.mapInArrow(set_worker(least_words, width, rows, bands, seed), SETS).dropDuplicates(["id"]), "paragraph-sets")
    nodes = sets.select("id", F.size("set").alias("n"), "marks")

    def links(pairs: DataFrame) -> DataFrame:
        close = stash(plausible(pairs, nodes, percent, MARKS), "paragraph-pairs")
        return stash(confirm(close, sets, percent), "paragraph-links")

    stars = links(linking.star_pairs(alive, stash(loneliness(sets), "paragraph-apart")))
    grouped = linking.in_groups(alive.select("key", "id"), linking.components(stars))
    rows = linking.contested(grouped)
    more = links(open_pairs(rows, sets, percent))
    groups = linking.components(stars.union(more))
    return occurrences(found, first, groups)


def occurrences(found: DataFrame, first: DataFrame, groups: DataFrame) -> DataFrame:
    """Occurrences of linked or repeated paragraphs, each group's first one marked."""
    classes = linking.in_groups(first, groups)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "paragraph")
    tops = classes.groupBy(F.col("component").alias("group")).agg(
        F.min(place).alias("top"), F.sum("n_times").alias("n_in_group")
    )
    tops = tops.filter(F.col("n_in_group") > 1)
    classes = classes.select("id", F.col("component").alias("group")).join(tops, "group")
    rows = found.select("doc_id", "version", "paragraph", "n_words", "id").join(classes, "id")
    tied = W.partitionBy("group", "doc_id", "version", "paragraph").orderBy("id")
    rows = rows.select("doc_id", "paragraph", "n_words", "group", place.eqNullSafe(F.col("top")).alias("is_top"), "version", "id")
    kept = F.col("is_top") & (F.row_number().over(tied) == 1)
    return rows.select("doc_id", "paragraph", "n_words", "group", kept.alias("kept"), "version")


def without_repeats(docs: DataFrame, key: str, text: str, repeats: DataFrame) -> DataFrame:
    """``docs`` with the paragraphs that ``repeats`` does not keep taken out of ``text``."""
    removed = repeats.filter(~F.col("kept"))
    gone = removed.groupBy(F.col("doc_id").alias("__key"), F.col("version").alias("__version")).agg(F.collect_set("paragraph").alias("__gone"))
    joined = docs.join(gone, (F.col(key).cast("long") == F.col("__key")) & (text_version(text) == F.col("__version")), "left")
    return joined.withColumn(text, without_lines(F.col(text), F.col("__gone"))).select(*docs.columns)


ship(__name__)
