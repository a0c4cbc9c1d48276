"""Sum-of-squares packing of token sequences into windows.

A document's whole windows are cut off first. Its rest goes to the fill level for which the sum of
the squared counts of partly filled windows becomes smallest; the counts are one array over levels.
Each partition packs its own documents and shuffles nothing. When its documents are used up, or too
many windows stand open, the emptiest open windows are cut up to fill the fullest, so one window is
left at most; that one is cut into sequences whose lengths are powers of two. No token is padding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ship

WINDOW = 2048
END = 1
MOST_OPEN = 4096
ROWS_OUT = 4096
CHARS_OUT = 1 << 24

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> str:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256))


class TokenBytes(dict):
    """Little-endian 32-bit ids of white-space-free chunks, remembered up to a bound.

    The vocabulary's tokens never span white space, so a text's ids are those of its chunks in a row.
    A chunk that is a letter's end followed by ASCII marks (no apostrophe) is cut there, as the
    vocabulary cuts it; a chunk of Latin letters is one entry of the model whatever its case.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    # Letters below this are composed already and stay letters in lower case, but for one.
    LATIN_END, DOTTED = "\u0180", "\u0130"
    LETTERS = byte_letters()

    def __init__(self, path: str, remembered: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            packed = self.word(chunk)
        elif not chunk:
            return b""
        else:
            core = chunk.rstrip(self.MARKS)
            if core and core != chunk and core[-1].lower()[-1].isalpha() and not self.holds_special(chunk):
                packed = self[core.lower() if core.isascii() else core] + self[chunk[len(core) :]]
            else:
                packed = self.encoded(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.remembered:
                self.clear()
            self[chunk] = packed
        return packed

    def holds_special(self, chunk: str) -> bool:
        for s in self.special:
            if s in chunk:
                return True
        return False

    def word(self, chunk: str) -> bytes:
        """A chunk of letters."""
        lowered = chunk.lower()
        if not chunk.isascii():
            if max(chunk) >= self.LATIN_END or self.DOTTED in chunk:
                return self.encoded(chunk)
            lowered = lowered.encode().decode("latin-1").translate(self.LETTERS)
        elif lowered != chunk:
            return self[lowered]
        return array("I", [t.id for t in self.model.tokenize(lowered)]).tobytes()

    def encoded(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def of(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


class LevelPacker:
    """Open windows by fill level. A piece is [row, start, ids]; ``close`` gets finished windows."""

    def __init__(self, window: int, close, most_open: int = MOST_OPEN):
        self.window, self.close, self.most_open = window, close, most_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level to which ``size`` tokens go; 0 is a new window. The fullest wins ties."""
        at = self.counts[1 : self.window - size + 1]
        if not len(at):
            return 0
        change = 2 * (self.counts[size + 1 :] - at) + 2
        change[-1] = 1 - 2 * at[-1]
        change[at == 0] = np.iinfo(np.int64).max
        best = len(at) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.counts[size] + 1 else 0

    def place(self, piece: list) -> None:
        size = len(piece[2]) // 4
        level = 0 if size == self.window else self.level(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.tidy(last=False)

    def tidy(self, last: bool) -> None:
        """Fill the fullest open windows with what lies in the emptiest, cutting where needed."""
        rest = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        at = 0
        while at < len(rest) - 1:
            gap = self.window - sum(len(p[2]) for p in rest[at]) // 4
            while gap and at < len(rest) - 1:
                gap -= self.move(rest[-1], rest[at], gap)
                if not rest[-1]:
                    rest.pop()
            if not gap:
                self.close(rest[at])
                at += 1
        for pieces in rest[at:]:
            size = sum(len(p[2]) for p in pieces) // 4
            if size == self.window:
                self.close(pieces)
            elif last:
                while size:
                    power = 1 << (size.bit_length() - 1)
                    part, gap = [], power
                    while gap:
                        gap -= self.move(pieces, part, gap)
                    self.close(part)
                    size -= power
            else:
                self.open[size] = [pieces]
                self.counts[size] = self.n_open = 1

    @staticmethod
    def move(source: list, target: list, most: int) -> int:
        """Move up to ``most`` tokens of the last piece."""
        row, start, ids = source.pop()
        size = len(ids) // 4
        if size > most:
            source.append([row, start + most, ids[4 * most :]])
            ids, size = ids[: 4 * most], most
        target.append([row, start, ids])
        return size


def pack_worker(path: str, window: int, end: int, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = TokenBytes(path), []
        first = TaskContext.get().partitionId() << 32
        closed = held = 0

        def close(pieces: list) -> None:
            nonlocal closed, held
            offset = 0
            for (key, tokens), start, ids in pieces:
                out.append((key, start, len(ids) // 4, ids, tokens, first + closed, offset))
                offset += len(ids) // 4
                held += len(ids)
            closed += 1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                out.clear()
                held = 0

        packer, last = LevelPacker(window, close), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = known.of(text.as_py()) + last
                row = (key.as_py(), len(ids) // 4)
                for at in range(0, len(ids), 4 * window):
                    packer.place([row, at // 4, ids[at : at + 4 * window]])
                if len(out) >= ROWS_OUT or held >= CHARS_OUT:
                    yield from flush()
        packer.tidy(last=True)
        yield from flush()

    return work


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: ``key``, where it starts in its document, its ids (little-endian 32 bit),
    its document's length with the end id, its sequence and its place there.

    A null or empty text is the end id alone. A null key stays null; repeated rows are documents of
    their own. An empty table gives no rows. Other columns are not looked at, whatever their names.
    ``sequence_id`` is unique and depends on the partitions of ``docs``, which a rerun of a task keeps.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    types = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in f"key long, {PIECES}".split(",")]
    schema = pa.schema([(n, types[t]) for n, t in fields])
    packed = rows.mapInArrow(pack_worker(tokenizer, window, end, schema), f"key long, {PIECES}")
    return packed.withColumnRenamed("key", key)


ship(__name__)
