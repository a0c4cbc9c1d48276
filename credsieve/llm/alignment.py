"""Tokens of two tokenizers that cover the same bytes.

Tokens times bytes are two incidence matrices in compressed rows, A and B. The row products A·Bᵀ are
the overlaps of tokens. Offsets at which tokens of both end cut a text into groups, and the products of
the tokens-times-groups matrices are the links of tokens in one group.

Neither tokenizer has a token that goes on from a character that is no white space to a space, so both
cut every text before such a space. The matrices of a text are therefore block-diagonal over its chunks, and
equal chunks are equal blocks: a task multiplies every distinct chunk once and remembers the block.

How many documents hold a pair of ids is a number over the whole corpus, which each link needs.
A task cuts its documents into blocks of some megabytes and writes down what each block and each of its documents
holds; texts are tokenized once and never moved. Each block asks once for each distinct pair it holds, and the
answers come back to the block's documents, whose links are kept as differences of places among the block's pairs.
Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ship, stash
from credsieve.llm.incidence import from_lengths, one_each, partial_sizes, product, ranges, transposed

BLOCK_BYTES = 8 << 20
REMEMBERED = 1 << 19
REMEMBERED_LINKS = 1 << 22
CHUNK = re.compile(r"(?<=\S)(?= )")
UNEVEN = re.compile(r"\s |\s$")
# A pair of ids in one long; the second tokenizer's ids need less than 32 bits.
SHIFT = 32

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def byte_alphabet() -> dict[str, int]:
    """The characters byte-level vocabularies write bytes in: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()

    def encode(self, chunks: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


class Pieces:
    """A piece vocabulary of the ``sentencepiece`` library, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.space = self.model.piece_to_id("▁")

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, chunks: Sequence[str]) -> list[list[int]]:
        """A chunk that is one space ends a text; alone it would be an empty text, which has no pieces."""
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        return [[self.space] if c == " " else i for c, i in zip(chunks, ids, strict=True)]


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut before every space that follows a character that is no white space."""
    if UNEVEN.search(" " + text):
        return CHUNK.split(" " + text)
    return [" " + word for word in text.split(" ")]


def _same(ids: Sequence[Sequence[int]], known: list[bytes], whole: list[bytes]) -> np.ndarray:
    """Which chunks their tokens' bytes give back."""
    joined = [b"".join([known[i] for i in row]) for row in ids]
    return np.array([j == w for j, w in zip(joined, whole, strict=True)], bool)


class Blocks:
    """Links, groups and counts of chunks, remembered up to a bound."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.sizes = [np.array([len(b) for b in v.bytes], np.int64) for v in (first, second)]
        # What a token writes within its group, and as the last of it.
        self.words = [([f"{i}," for i in range(len(s))], [f"{i}{end}" for i in range(len(s))]) for s, end in zip(self.sizes, "|;", strict=True)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.known = np.empty(0, bool)
        self.counts = np.empty((0, len(COUNTS)), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.links = np.empty(0, np.int64)

    def learn(self, texts: Sequence[list[str]]) -> None:
        """Make the blocks of all chunks that are not known yet, all in one product."""
        if len(self.place) > REMEMBERED or len(self.links) > REMEMBERED_LINKS:
            self.forget()
        new = [c for c in dict.fromkeys(c for chunks in texts for c in chunks) if c not in self.place]
        if not new:
            return
        ids_a, ids_b = self.first.encode(new), self.second.encode(new)
        whole = [c.encode() for c in new]
        same = _same(ids_a, self.first.bytes, whole) & _same(ids_b, self.second.bytes, whole)
        if not same.all():
            ids_a, ids_b = ([i if s else [] for i, s in zip(ids, same, strict=True)] for ids in (ids_a, ids_b))

        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        a, b = from_lengths(self.sizes[0][flat_a]), from_lengths(self.sizes[1][flat_b])
        row, column, _ = product(a, transposed(b))
        before_a = np.concatenate([[0], np.cumsum(n_a)])
        n_links = np.diff(np.searchsorted(row, before_a))

        # Both end at every end of a chunk, so groups never reach over chunks.
        shared = np.intersect1d(a.starts[1:], b.starts[1:], assume_unique=True)
        group_a, group_b = (np.searchsorted(shared, m.starts[:-1], "right") for m in (a, b))
        in_a, in_b = one_each(group_a, len(shared)), one_each(group_b, len(shared))
        group_links = np.concatenate([[0], np.cumsum(partial_sizes(in_a, transposed(in_b)))])
        n_groups = np.diff(np.searchsorted(shared, a.starts[before_a], "right"))

        at = len(self.known)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.known = np.concatenate([self.known, same])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, np.diff(group_links[before_a])], axis=1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, (flat_a[row] << SHIFT) | flat_b[column]])
        self.groups += self._group_texts(flat_a, flat_b, group_a, group_b, before_a, np.concatenate([[0], np.cumsum(n_b)]))

    def _group_texts(self, flat_a, flat_b, group_a, group_b, before_a, before_b) -> list[str]:
        """Each chunk's groups, all written in one go: a group's first ids, then its second ones."""
        parts = np.empty(len(flat_a) + len(flat_b), object)
        # A token stands behind the other side's tokens of earlier groups; a second one also behind those of its own.
        places = np.arange(len(flat_a)) + np.searchsorted(group_b, group_a), np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")
        for place, flat, group, (within, last) in zip(places, (flat_a, flat_b), (group_a, group_b), self.words, strict=True):
            ends = np.append(group[1:] != group[:-1], True)[: len(group)]
            parts[place] = [last[i] if e else within[i] for i, e in zip(flat.tolist(), ends.tolist(), strict=True)]
        written, cuts = parts.tolist(), (before_a + before_b).tolist()
        return ["".join(written[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def text(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
        """Counts, links (pairs of ids) and the digest of the groups of a text of known chunks."""
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        if not chunks or not self.known[at].all():
            return np.zeros(len(COUNTS), np.int64), np.empty(0, np.int64), ""
        links = self.links[ranges(self.starts[at], self.starts[at + 1] - self.starts[at])]
        digest = hashlib.sha256("".join(map(self.groups.__getitem__, at.tolist()))[:-1].encode()).hexdigest()
        return self.counts[at].sum(axis=0), links, digest


SLICE_CHARS = 1 << 20

BLOCK = (
    "block long, key long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, holders array<long>"
)
RESULT = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_group_links long"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as all their lowest bytes, then all the next ones: small ones leave runs of zeros."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _schema(columns: str) -> pa.Schema:
    types = {
        "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, types[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


def block_worker(path_a: str, path_b: str, block_bytes: int):
    """A row per document, and a row per block with its distinct pairs and how many of its documents hold each."""
    schema = _schema(BLOCK)

    def rows(block: int, held: list[tuple]) -> pa.RecordBatch:
        pairs, holders = np.unique(np.concatenate([h[2] for h in held]), return_counts=True)
        out = []
        for key, (n_a, n_b, n_groups, n_links, n_group_links), links, times, digest in held:
            places = np.diff(np.searchsorted(pairs, links), prepend=0)
            out.append((block, key, n_a, n_b, n_groups, n_links, n_group_links, digest, packed(places), packed(times), None, None))
        out.append((block, *[None] * 9, pairs, holders))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(ByteLevel(path_a), Pieces(path_b))
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            while at < len(keys):
                part, chars = [], 0
                while at + len(part) < len(keys) and chars < SLICE_CHARS:
                    part.append(texts[at + len(part)].as_py() or "")
                    chars += len(part[-1])
                chunks = [chunks_of(t) if t else [] for t in part]
                blocks.learn(chunks)
                for key, of in zip(keys[at : at + len(part)], chunks, strict=True):
                    counts, links, digest = blocks.text(of)
                    held.append((key, counts, *np.unique(links, return_counts=True), digest))
                at += len(part)
                size += chars + 64 * len(part)
                if size >= block_bytes:
                    yield rows(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield rows(block, held)

    return work


def answer_worker():
    """For one block: its documents' links looked up among the answers to its pairs, which come in the pairs' order."""
    schema = _schema(RESULT)

    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("pair").to_numpy())
        n = answers.column("n").to_numpy()[order]
        best = answers.column("best").to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
            at, k = np.cumsum(unpacked(places)), unpacked(times)
            n_best.append(int((best[at] * k).sum()) if len(at) else 0)
            count_sum.append(int((n[at] * k).sum()) if len(at) else 0)
        found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([found[f.name] if f.name in found else docs.column(f.name) for f in schema], schema=schema)

    return work


def align(docs: DataFrame, key: str, text: str, path_a: str, path_b: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its tokens, groups, links, and how usual its links are in the corpus.

    A null or empty text, or one that either tokenizer does not give back byte by byte, has no tokens: zeros
    and an empty digest. Repeated rows are documents of their own. An empty table gives no rows. A null key
    stays null. Other columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    held = stash(rows.mapInArrow(block_worker(path_a, path_b, block_bytes), BLOCK), "token-blocks")
    asked = held.filter(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    asked = asked.select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", SHIFT))
    tops = counts.groupBy("a").agg(F.max("n").alias("top"))
    marked = counts.join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    answers = asked.select("block", "pair").join(marked, "pair").select("block", "pair", "n", "best")
    kept = held.filter(F.col("pairs").isNull()).drop("pairs", "holders").withColumnRenamed("block", "part")
    found = kept.groupBy("part").cogroup(answers.groupBy("block")).applyInArrow(answer_worker(), RESULT)
    return found.withColumnRenamed("key", key)


ship(__name__)
