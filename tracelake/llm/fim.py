"""Fill-in-middle documents by piece tables.

A document is a list of descriptors, each a span of one of two immutable buffers: its own UTF-8 text and the sentinels.
Cutting splits a descriptor in two, an arrangement permutes descriptors and puts sentinel descriptors between them, and
nothing copies text until the pieces are joined for output; hashes stream the pieces.  Restoring reads an output as the
text buffer of a table of its own, splits it at the sentinels, and undoes the permutation.

A unit is a run of ASCII letters or any other single code point.  Two cuts and the form of each document come from the
SHA-256 of seed and doc_id, so reruns and copies of a row agree.  A document without text, one that holds a sentinel and
one drawn out of the rate stays plain.

Edge cases: a null text counts as empty and an empty one is plain; a null doc_id is hashed as an empty number; whole texts
are used however long; columns of the input that are named like results are left out of what is kept unless asked for by
another name; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from enum import IntEnum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Sentinels of prefix, suffix and middle, and the one buffer that holds them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: In a hundred documents, so many are arranged, and so many of these with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Order of the parts (0 prefix, 1 middle, 2 suffix) in the output, each behind its sentinel.
ORDERS = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
PART_SENTINELS = (PREFIX, MIDDLE, SUFFIX)


class Buffer(IntEnum):
    TEXT = 0
    SENTINEL = 1


@dataclass(frozen=True)
class Piece:
    """``length`` bytes of a buffer from ``start`` on."""

    buffer: Buffer
    start: int
    length: int


@dataclass(frozen=True)
class PieceTable:
    """Pieces in their order over an immutable text."""

    text: bytes
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls(text, (Piece(Buffer.TEXT, 0, len(text)),))

    def cut(self, *offsets: int) -> PieceTable:
        """Splits the pieces that hold these byte offsets of the current content; an offset at an edge cuts off an empty piece."""
        pieces, at, due = [], 0, sorted(offsets)
        for k, piece in enumerate(self.pieces):
            last = k == len(self.pieces) - 1
            done = 0
            while due and (due[0] < at + piece.length or last):
                here = due.pop(0) - at
                pieces.append(Piece(piece.buffer, piece.start + done, here - done))
                done = here
            pieces.append(Piece(piece.buffer, piece.start + done, piece.length - done))
            at += piece.length
        return PieceTable(self.text, tuple(pieces))

    def arranged(self, order: Sequence[int], sentinels: Sequence[bytes] = ()) -> PieceTable:
        """Pieces in the order given, the k-th of the table behind ``sentinels[k]`` if there are any."""
        out = []
        for k in order:
            if sentinels:
                out.append(Piece(Buffer.SENTINEL, SENTINELS.index(sentinels[k]), len(sentinels[k])))
            out.append(self.pieces[k])
        return PieceTable(self.text, tuple(out))

    def spans(self) -> Iterator[memoryview]:
        buffers = (memoryview(self.text), memoryview(SENTINELS))
        for p in self.pieces:
            yield buffers[p.buffer][p.start : p.start + p.length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for span in self.spans():
            digest.update(span)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.spans())


def unit_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which units start, in order."""
    codes = np.frombuffer(text, np.uint8)
    letter = ((codes | 0x20) >= 0x61) & ((codes | 0x20) <= 0x7A)
    starts = (codes & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.nonzero(starts)[0]


def n_chars(text: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Arranged:
    """A document's table in its form; ``parts`` are prefix, middle and suffix of an arranged one."""

    form: str
    n_units: int
    table: PieceTable
    parts: tuple[Piece, ...] = ()


def arrange(doc_id: int | None, text: bytes, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Arranged:
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in range(0, 32, 8))
    starts, whole = unit_starts(text), PieceTable.of(text)
    n = len(starts)
    if not text or any(s in text for s in PART_SENTINELS) or h3 % 100 >= rate:
        return Arranged(PLAIN, n, whole)
    offsets = [int(starts[c]) if c < n else len(text) for c in (h1 % (n + 1), h2 % (n + 1))]
    cut = whole.cut(*offsets)
    form = SPM if h4 % 100 < suffix_first else PSM
    return Arranged(form, n, cut.arranged(ORDERS[form], PART_SENTINELS), cut.pieces)


def restored(output: bytes, form: str) -> PieceTable:
    """The table of the original text over an output of that form."""
    table = PieceTable.of(output)
    if form == PLAIN:
        return table
    order = ORDERS[form]
    at = [output.index(PART_SENTINELS[k]) for k in order]
    cut = table.cut(*(edge for k, start in zip(order, at) for edge in (start, start + len(PART_SENTINELS[k]))))
    parts = PieceTable(output, cut.pieces[2::2])  # an empty piece comes first, then sentinels and parts in turn
    return parts.arranged(np.argsort(order).tolist())


def fill_in_middle(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), with_output: bool = True, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Columns ``keep``, counts, form, ``pieces`` as spans, digests of the output and of the text restored from it, and the output.

    ``pieces`` are structs of buffer (``text`` or ``sentinel``) and byte span, which suffice to build the output elsewhere.
    One pass without a shuffle; a text, its output and the restored text are in memory one document at a time.
    """
    names = list(keep)
    span = pa.struct([("buffer", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
    found: dict[str, tuple[pa.DataType, T.DataType]] = {
        "n": (pa.int64(), T.LongType()),
        "form": (pa.string(), T.StringType()),
        "prefix_chars": (pa.int64(), T.LongType()),
        "middle_chars": (pa.int64(), T.LongType()),
        "output_sha256": (pa.string(), T.StringType()),
        "restored_sha256": (pa.string(), T.StringType()),
    }
    if with_output:
        spans = T.StructType([T.StructField("buffer", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
        found |= {"pieces": (pa.list_(span), T.ArrayType(spans)), "output": (pa.string(), T.StringType())}

    def row(doc_id: int | None, text: bytes) -> tuple:
        done = arrange(doc_id, text, seed, rate, suffix_first)
        output = done.table.content()
        chars = [n_chars(memoryview(text)[p.start : p.start + p.length]) for p in done.parts[:2]] or [None, None]
        out = (done.n_units, done.form, *chars, done.table.sha256(), restored(output, done.form).sha256())
        if not with_output:
            return out
        return (*out, [{"buffer": p.buffer.name.lower(), "start": p.start, "length": p.length} for p in done.table.pieces], output.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column("doc_id").to_pylist()
                rows = [row(d, t.as_py() or b"") for d, t in zip(ids, texts.slice(start, 512))]
                columns = [pa.array([r[k] for r in rows], kind) for k, (kind, _) in enumerate(found.values())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, *found])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, kind) for c, (_, kind) in found.items())])
    return docs.select(*dict.fromkeys([*names, "doc_id", "text"])).mapInArrow(run, schema)
