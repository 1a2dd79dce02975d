"""Operator 7, best-fit packing.

Tokens are counted next to the scan; only pieces' lengths move. Each packer takes
a contiguous block of the given order and packs it online: a fixed number of bins
is open, a bitset has bit ``f`` set when some open bin has ``f`` tokens free, and
the smallest set bit at or above a piece's length is its best fit. When no bin
fits and all are open, the fullest closes.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, kept, stored

CAPACITY, OPEN_BINS, ROWS_PER_PACKER = 2048, 512, 40_000
#: Bytes of words and ids that a task holds; a word longer than _CACHED_LENGTH bytes isn't held.
_CACHED_BYTES, _CACHED_LENGTH = 64 << 20, 64
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What an entry of the cache takes beyond its own bytes.
_ENTRY = 170


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers use for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, word by word, by a tokenizer that lower-cases A-Z and drops white space.

    Both are tried out when the tokenizer is loaded, and one that does otherwise is
    refused. A word of Latin letters, or one with a mark of punctuation after it,
    needs no normaliser and no splitting: it goes to the model at once, if that too
    has given the tokenizer's own ids for all words tried out.
    """

    #: ASCII marks that end a word and are pieces of their own behind a letter.
    MARKS = b".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        held = kept(path)
        if not held:
            held |= {"tokenizer": Tokenizer.from_file(path), "words": {}, "bytes": [0]}
            self.tokenizer, self.cache, self.held = held["tokenizer"], held["words"], held["bytes"]
            held["table"] = byte_letters()
            held["fast"] = self._tried(held["table"])
        self.tokenizer = held["tokenizer"]
        self.model = held["tokenizer"].model
        self.cache: dict[bytes, bytes] = held["words"]
        self.held: list[int] = held["bytes"]
        self.table, self.fast = held["table"], held["fast"]

    def _tried(self, table: dict[int, str]) -> bool:
        """Whether words of letters may go to the model at once; raises if words can't be encoded one by one."""
        rng = random.Random(7)
        letters = "abcdefghijklmnopqrstuvwxyz" * 4 + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
        plain = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(400)]
        odd = ["it's", "'s", "can't", "x1", "12", "a.b", "...", "--", "e\u0301", "\u0301a", "\u00a0b", "\u3000", "<|", "|>", "\U0001d4b3", "\ufb01", "\u0130", "\u212a", "#1", "(a)", "\x00", "\x85", "\x1c"]
        words = [*plain[:60], *(w.upper() for w in plain[60:90] if len(w.upper()) == len(w)), *odd]
        self.model = self.tokenizer.model
        for _ in range(60):
            some = rng.choices(words, k=12)
            gaps = rng.choices([" ", "\n", "\t", "\r", "\x0b", "\x0c", "  ", "\r\n"], k=12)
            whole = self._full("".join(w + g for w, g in zip(some, gaps)))
            if whole != b"".join(self._full(w.encode().lower().decode()) for w in some):
                raise ValueError("this tokenizer doesn't encode texts word by word without regard to case and white space")
        self.table = table
        return all(self._model(w) == self._full(w) for w in plain) and all(self._model(w) + self._full(m) == self._full(w + m) for w in plain[:100] for m in self.MARKS.decode())

    def _full(self, w: str) -> bytes:
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def _model(self, letters: str) -> bytes:
        """Ids of a word of lower-case Latin letters."""
        piece = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _letters(self, w: bytes) -> str | None:
        """The word in lower case if it has nothing but letters of Latin-1."""
        if w.isalpha():
            return w.decode()
        return s.lower() if _LETTERS.fullmatch(s := w.decode()) else None

    def word(self, w: bytes) -> bytes:
        """Ids of a word with A-Z in lower case, kept for the next time."""
        out = None
        if self.fast:
            if (s := self._letters(w)) is not None:
                out = self._model(s)
            elif len(w) > 1 and w[-1] in self.MARKS and (s := self._letters(w[:-1])) is not None:
                core = self.cache.get(w[:-1])
                mark = self.cache.get(w[-1:])
                out = (self._model(s) if core is None else core) + (self.word(w[-1:]) if mark is None else mark)
        if out is None:
            out = self._full(w.decode())
        if len(w) <= _CACHED_LENGTH:
            if self.held[0] > _CACHED_BYTES:
                self.cache.clear()
                self.held[0] = 0
            self.cache[w] = out
            self.held[0] += len(w) + len(out) + _ENTRY
        return out

    def forget(self) -> None:
        """Empties the cache: an idle worker would keep it beside the next stage's."""
        self.cache.clear()
        self.held[0] = 0

    def encode(self, text: str) -> bytes:
        """Splits at ASCII white space; any other is left to the tokenizer, inside a word."""
        get, word = self.cache.get, self.word
        return b"".join([get(w) or word(w) for w in text.encode().lower().split()])


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` tokens."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            seq = self._take(f)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            seq, f = self.made, self.capacity
            self.made += 1
        if left := f - length:
            self.bins[left].append(seq)
            self.free |= 1 << left
            self.open += 1
        return seq, self.capacity - f

    def _take(self, f: int) -> int:
        seq = self.bins[f].pop()
        if not self.bins[f]:
            self.free &= ~(1 << f)
        self.open -= 1
        return seq


def token_pieces(docs: DataFrame, tokenizer_path: str, order: list[Column], key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``key, piece, start, length, ids_crc32`` (and ``ids`` if kept), with ``o0, o1, ...`` from ``order`` and ``row``, which numbers the documents.

    A document's ids are those of its whole text followed by ``end_id``; null and
    empty texts have ``end_id`` alone. Only longer ones than ``capacity`` are cut.
    The tokenizer must be one that ``WordEncoder`` accepts.
    """
    names = [f"o{i}" for i in range(len(order))]
    given = docs.select(docs[key].alias(key), *[o.alias(n) for o, n in zip(order, names)], F.monotonically_increasing_id().alias("row"), docs[text].cast("string").alias("__text"))
    fields = [*given.schema.fields[:-1], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    tail = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            row: list[int] = []
            piece, start, length, crc, ids = [], [], [], [], []
            for i, s in enumerate(batch.column(batch.num_columns - 1)):
                data = encoder.encode(s.as_py() or "") + tail
                for p, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[f.name for f in fields])
        encoder.forget()
        give_back()

    return given.mapInArrow(work, T.StructType(fields))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    order: list[Column] | None = None,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = 0,
    rows_per_packer: int = ROWS_PER_PACKER,
    keep_ids: bool = False,
) -> DataFrame:
    """One row ``key, piece, start, length, ids_crc32[, ids], sequence_id, offset`` for each piece of each document.

    Documents are taken in ``order`` (default: by key), in contiguous blocks of
    about ``rows_per_packer`` documents, each packed by itself with ``open_bins``
    open bins; pieces of a document in their own order, documents that tie in the
    order of the rows. Offsets within a sequence run from 0 without gaps. Repeated rows
    and null keys are documents like any other; other columns don't come out. An
    empty table gives an empty result. Sequence ids grow along the order from
    block to block and are not gapless.
    """
    order = [docs[key]] if order is None else order
    # Kept, as range partitioning looks at its input twice and tokens are dear. The
    # stored row numbers make the order whole: a repeated task finds the same one,
    # and equal keys are dealt out like others.
    pieces = stored(token_pieces(docs, tokenizer_path, order, key, text, capacity, end_id, keep_ids), "pieces")
    packers = max(1, -(-pieces.filter("start = 0").count() // rows_per_packer))
    by = [*(F.col(f"o{i}") for i in range(len(order))), F.col("row")]
    dealt = pieces.repartitionByRange(packers, *by).sortWithinPartitions(*by, "start")
    kept = [f for f in pieces.schema.fields if f.name not in {"row", *(f"o{i}" for i in range(len(order)))}]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 33
        fit = BestFit(capacity, open_bins)
        for frame in frames:
            at = [fit.place(n) for n in frame["length"].tolist()]
            frame["sequence_id"] = [first + s for s, _ in at]
            frame["offset"] = [o for _, o in at]
            yield frame

    return dealt.select(*[f.name for f in kept]).mapInPandas(work, schema)
