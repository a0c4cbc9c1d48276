"""Phrases whose words stand together more often than apart, by counting longest windows only.

Every word of a piece of text leads one window of up to four words, padded where the piece ends.
Only these windows are counted; ``ROLLUP`` over their columns sums them to the counts of all shorter
phrases, which are the windows' beginnings. Words alone are counted before. A phrase found ``least`` times holds only words, neighbours and
runs of three found as often, so windows also end at rarer ones. Which of them may be frequent
is told to the tasks as bits of a fixed number of slots. Two that share a slot make windows longer than
need be, never wrong: the counts of what is frequent are exact however full the slots are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsieve.llm.common import mixed, ship, stash

LONGEST = 4
LEAST = 30
# A phrase goes if a longer one has at least this share of its occurrences, in percent.
INSIDE = 80
SCALE = 2_000_000
NO_LANG = "und"

# Slots of the filters, as powers of two: 2 MB for words, 8 MB each for runs of two and of three. They bound what is sent with a task.
WORD_SLOTS = 24
RUN_SLOTS = 26
# Bits of a run's id that are kept: shared ids do no harm, and zeros take no room in a shuffle.
RUN_BITS = 44
# Rows gathered in a task before they are summed up and handed on.
HELD_WORDS = 1 << 18
HELD_WINDOWS = 1 << 20
REMEMBERED = 1 << 18

# What ends a piece, and what parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"


def _folding() -> bytes:
    """Byte to byte: A to Z in lower case, every end of a piece as a line feed, of a word as a space."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in PIECE_ENDS:
        table[c] = ord("\n")
    for c in WORD_ENDS:
        table[c] = ord(" ")
    return bytes(table)


FOLDING = _folding()


def tokens_of(text: bytes) -> list[bytes]:
    """Words in order, with a line feed at each end of a piece, and empty strings to be skipped."""
    return text.translate(FOLDING).replace(b"\n", b" \n ").split(b" ")


def lang_seed(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)


def word_id(word: bytes, seed: int) -> int:
    """A 64-bit id of a word of a language, as Spark's signed long; 0 stays free for padding."""
    h = xxhash.xxh3_64_intdigest(word, seed)
    return (h - (1 << 64) if h >> 63 else h) or 1


def slots_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return ids.view(np.uint64) >> np.uint64(64 - bits)


def in_slots(ids: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    slots = slots_of(ids, bits)
    return (filled[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) > 0


def run_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ids of runs from those of their beginnings and of the words that follow."""
    found = mixed(mixed(first.view(np.uint64)) * np.uint64(3) + second.view(np.uint64))
    return (found & np.uint64((1 << 64) - (1 << (64 - RUN_BITS)))).view(np.int64)


class FrequentWords(dict):
    """Ids of one language's words: 0 for rare ones and ends of pieces, -1 for what is to be skipped."""

    SKIP = -1

    def __init__(self, lang: str, seed: int, filled: np.ndarray):
        self.seed, self.filled = lang_seed(lang, seed), filled
        self.start()

    def start(self) -> None:
        self.clear()
        self[b""], self[b"\n"] = self.SKIP, 0

    def __missing__(self, word: bytes) -> int:
        h = word_id(word, self.seed)
        slot = (h & ((1 << 64) - 1)) >> (64 - WORD_SLOTS)
        if not int(self.filled[slot >> 6]) >> (slot & 63) & 1:
            h = 0
        elif h == self.SKIP:
            raise ValueError("a word has the id kept free; take another seed")
        if len(self) >= REMEMBERED:
            self.start()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        tokens = tokens_of(text)
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids != self.SKIP]


def word_counter(seed: int):
    """A task that counts the words of each language."""
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def out(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            for skipped in (b"", b"\n"):
                found.pop(skipped, None)
            words, own = list(found), lang_seed(lang, seed)
            columns = [
                pa.array([word_id(w, own) for w in words], pa.int64()), pa.array([lang] * len(words), pa.string()),
                pa.array(words, pa.binary()), pa.array(found.values(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.setdefault(lang, Counter()).update(tokens_of(text.as_py()))
                if len(counts[lang]) > HELD_WORDS:
                    yield from out({lang: counts.pop(lang)})
        yield from out(counts)

    return work, "id long, lang string, word binary, n long"


def _texts(batches: Iterator[pa.RecordBatch], seed: int, filled: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of all words of many texts at a time, each text ended by a 0."""
    known: dict[str, FrequentWords] = {}
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in known:
                known[lang] = FrequentWords(lang, seed, filled)
            ids = known[lang].of(text.as_py())
            held += [ids, np.zeros(1, np.int64)]
            size += len(ids) + 1
            if size >= HELD_WINDOWS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def links_of(ids: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """For each number of words from two on: whether the run each place begins may be frequent.

    Runs of two and three are looked up as far as there are filters; a longer one, or one without a filter,
    may be if the two runs within it that are one word shorter may be.
    """
    held, links = ids != 0, []
    runs = ids
    for k in range(1, LONGEST):
        held = held[:-1] & held[1:]
        if k <= 2:
            runs = run_ids(runs[:-1], ids[k:])
        if k <= len(filters):
            held = held & in_slots(runs, filters[k - 1], RUN_SLOTS)
        links.append(held)
    return links


def run_counter(seed: int, words: np.ndarray, filters: list[np.ndarray]):
    """A task that counts runs one word longer than the last filter's, of which all shorter ones may be frequent."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    size = len(filters) + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _texts(batches, seed, words):
            if len(ids) < LONGEST:
                ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
            at = np.flatnonzero(links_of(ids, filters)[size - 2])
            runs = ids[at]
            for k in range(1, size):
                runs = run_ids(runs, ids[at + k])
            runs, n = np.unique(runs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n.astype(np.int64))], schema=schema)

    return work, "id long, n long"


def windows_of(ids: np.ndarray, links: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of the windows of two words or more; 0 from the first word on that does not belong."""
    columns = [ids]
    for k, held in enumerate(links, start=1):
        column = np.zeros(len(ids), np.int64)
        column[: len(ids) - k] = np.where(held, ids[k:], 0)
        columns.append(column)
    return [c[columns[1] != 0] for c in columns]


def summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct windows with the sums of their counts, which stand last."""
    order = np.lexsort(columns[-2::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
    at = np.flatnonzero(new)
    n = np.add.reduceat(columns[-1], at) if len(at) else columns[-1]
    return [*(c[at] for c in columns[:-1]), n]


def window_counter(seed: int, words: np.ndarray, filters: list[np.ndarray]):
    """A task that counts longest windows."""
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    schema = pa.schema([(n, pa.int64()) for n in [*names, "n"]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * (LONGEST + 1)
        for ids in _texts(batches, seed, words):
            if len(ids) < LONGEST:
                ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
            found = windows_of(ids, links_of(ids, filters))
            held = summed([np.concatenate(c) for c in zip(held, [*found, np.ones(len(found[0]), np.int64)], strict=True)])
            if len(held[0]) >= HELD_WINDOWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=schema)
                held = [c[:0] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], schema=schema)

    return work, ", ".join(f"{n} long" for n in [*names, "n"])


def slot_counter(bits: int):
    """A task that gathers ids as bits: one row for each 64 slots with any."""
    schema = pa.schema([("block", pa.int64()), ("bits", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            slots = slots_of(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            np.bitwise_or.at(filled, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
        blocks = np.flatnonzero(filled)
        for at in range(0, len(blocks), 1 << 16):
            part = blocks[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(filled[part].view(np.int64))], schema=schema)

    return work


def filled_slots(ids: DataFrame, bits: int) -> np.ndarray:
    """All ids as bits. At most 2 ** (bits - 6) rows reach the driver, whatever the table's size."""
    rows = ids.mapInArrow(slot_counter(bits), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return filled


def word_table(texts: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """``id, lang, word, n`` of every word, and a seed with which no two words share an id."""
    while True:
        work, columns = word_counter(seed)
        counted = texts.mapInArrow(work, columns).groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        words = stash(counted, "phrase-words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def phrase_counts(texts: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """``ws`` (ids of 1 to 4 words) and ``n`` for all phrases found at least ``least`` times."""
    often = F.col("n") >= least
    frequent = filled_slots(words.filter(often).select("id"), WORD_SLOTS)
    filters: list[np.ndarray] = []
    for _ in range(LONGEST - 2):
        work, columns = run_counter(seed, frequent, list(filters))
        runs = texts.mapInArrow(work, columns).groupBy("id").agg(F.sum("n").alias("n"))
        filters.append(filled_slots(runs.filter(often).select("id"), RUN_SLOTS))

    work, columns = window_counter(seed, frequent, filters)
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    summed = texts.mapInArrow(work, columns).rollup(*names).agg(F.sum("n").alias("n"), F.grouping_id().alias("rolled"))
    phrase = F.lit(None)
    for level in range(2, LONGEST + 1):
        last = F.col(names[level - 1])
        phrase = F.when((F.col("rolled") == (1 << (LONGEST - level)) - 1) & (last != 0), F.array(*names[:level])).otherwise(phrase)
    longer = summed.filter(often).select(phrase.alias("ws"), "n").filter(F.col("ws").isNotNull())
    return longer.unionByName(words.filter(often).select(F.array("id").alias("ws"), "n"))


def best_cuts(counts: DataFrame) -> DataFrame:
    """``ws, a, l, r, score`` of every phrase of two words or more at its lowest-scoring cut.

    Products are decimals of up to 38 digits. Of cuts with equal scores the first counts.
    """
    size = F.size("ws")
    cut = counts.filter(size > 1).select("ws", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumn("head", F.slice("ws", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ws", F.col("k") + 1, size - F.col("k")))
    heads = counts.select(F.col("ws").alias("head"), F.col("n").alias("l"))
    tails = counts.select(F.col("ws").alias("tail"), F.col("n").alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cut.join(heads, "head").join(tails, "tail").withColumn("score", score)
    lowest = scored.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.select("ws", "a", "low.l", "low.r", "low.score")


def most_inside(counts: DataFrame) -> DataFrame:
    """For every phrase inside a longer one: the most occurrences of any such longer one."""
    size = F.size("ws")
    longer = counts.filter(size > 2)
    parts = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ws", i, n)),
    ))
    return longer.select(F.explode(parts).alias("ws"), "n").groupBy("ws").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, lang: str, text: str, *, least: int = LEAST, first: int | None = None, seed: int = 0) -> DataFrame:
    """Phrases of 2 to 4 words found at least ``least`` times: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``; a null or empty text has no words; repeated rows count again; an empty
    table gives no rows. Equal scores are ordered by occurrences, then by the phrase's bytes.
    ``first`` keeps so many ranks of each language. Other columns are not looked at, whatever their names.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    words, seed = word_table(texts, seed)
    counts = stash(phrase_counts(texts, words, seed, least), "phrase-counts")
    inside = most_inside(counts)
    hundred = F.lit(100).cast("decimal(20,0)")
    swallowed = hundred * F.coalesce("longer", F.lit(0)) >= F.lit(INSIDE).cast("decimal(20,0)") * F.col("a")
    kept = best_cuts(counts).join(inside, "ws", "left").filter(~swallowed).drop("longer")

    named = words.filter(F.col("n") >= least)
    for k in range(1, LONGEST + 1):
        part = named.select(F.col("id").alias(f"id{k}"), F.col("word").cast("string").alias(f"t{k}"), *(["lang"] if k == 1 else []))
        kept = kept.withColumn(f"id{k}", F.get("ws", F.lit(k - 1))).join(part, f"id{k}", "inner" if k <= 2 else "left")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = kept.join(totals, "lang").withColumn("phrase", F.concat_ws(" ", *[f"t{k}" for k in range(1, LONGEST + 1)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if first is not None:
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.select("lang", *[F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])


ship(__name__)
