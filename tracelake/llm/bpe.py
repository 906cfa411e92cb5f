"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

A rank file maps byte strings to ranks.  Its model has one piece per byte string, spelled with one printable character
per byte, scored by the negative rank, with the identity as normaliser and no white-space rules.  Sentencepiece's BPE
merges the best-scored adjacent pair first and the left one of equals, which is the rank order.  A text is cut into
pre-tokens by the vocabulary's pattern, each pre-token is spelled and encoded alone, and ids are decoded by the inverse
spelling.

Edge cases: a null text is an empty one and has no ids; text is never cut short; repeated rows are encoded alike; other
columns, whatever their names, are kept by ``encode`` and ``decode`` unless they have the name of a result, which
replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct pre-tokens that a worker keeps with their ids (it starts anew beyond), the longest it keeps, and the
#: characters of texts that are encoded together.  They bound memory; every token is encoded.
KEPT, KEPT_CHARS, GROUP_CHARS = 200_000, 40, 250_000


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string to rank, from lines of a base64 string and a rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: length-delimited, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece k spells the byte string of rank k; the one after the last is the unknown piece.

    Ranks must be 0 to n - 1.  Fields as in the public model format: pieces 1 (piece 1, score 2, type 3),
    trainer_spec 2 (model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3
    (name 1, charsmap 2, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    spell = byte_chars()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[b] for b in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1 without gaps")
    minus_one = (1 << 64) - 1
    pieces = [
        _field(1, _field(1, "".join(spell[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for rank, token in enumerate(by_rank)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(by_rank))
    trainer += b"".join(_field(k, minus_one) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """A model and a pattern; the processor is built in each Python worker at first use."""

    def __init__(self, model: bytes, pattern: str):
        self.model, self.pattern = model, pattern

    @classmethod
    def of_ranks(cls, path: str, pattern: str) -> Codec:
        return cls(model_bytes(read_ranks(path)), pattern)

    def __getstate__(self):
        return {"model": self.model, "pattern": self.pattern}

    @cached_property
    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def _split(self):
        import regex

        return regex.compile(self.pattern).findall

    @cached_property
    def _spell(self) -> list[str]:
        return byte_chars()

    @cached_property
    def _bytes(self) -> list[bytes]:
        back = {c: b for b, c in enumerate(self._spell)}
        size = self._processor.get_piece_size() - 1
        return [bytes(back[c] for c in self._processor.id_to_piece(i)) for i in range(size)]

    @cached_property
    def _seen(self) -> dict[str, list[int]]:
        return {}

    @cached_property
    def _spell_table(self) -> dict[int, str]:
        return dict(enumerate(self._spell))

    @cached_property
    def digits(self) -> list[str]:
        return [str(i) for i in range(len(self._bytes))]

    def forget(self) -> None:
        """Drops the processor and what was kept beside it; they are built anew at the next use."""
        for name in ("_processor", "_bytes", "_seen", "digits"):
            self.__dict__.pop(name, None)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order.  Texts go in groups of about ``GROUP_CHARS``; a group's new pre-tokens are encoded in one call."""
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            group.append(self._split(text or ""))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> Iterator[list[int]]:
        known = self._seen
        if len(known) > KEPT:
            known.clear()
        new = list(set(chain.from_iterable(group)).difference(known))
        spelled = [t.encode().decode("latin-1").translate(self._spell_table) for t in new]
        known.update(zip(new, self._processor.encode(spelled, num_threads=1)))
        coded = [list(chain.from_iterable(map(known.__getitem__, tokens))) for tokens in group]
        for token in new:
            if len(token) > KEPT_CHARS:
                del known[token]
        yield from coded

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    return (value.as_py() for value in batch.column(column))


def encode(docs: DataFrame, codec: Codec, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text of ``column`` as array<int> ``into``."""
    kept = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([pa.array(x, pa.int32()) for x in shared.value.encode_all(_texts(batch, column))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, into])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(into, T.ArrayType(T.IntegerType(), True))])
    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, codec: Codec, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of the ids of ``column`` as binary ``into``; null ids give no bytes."""
    kept = [c for c in coded.columns if c != into]
    shared = coded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([shared.value.decode(x.as_py() or []) for x in batch.column(column)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), got], [*kept, into])

    return coded.mapInArrow(run, T.StructType([*(coded.schema[c] for c in kept), T.StructField(into, T.BinaryType())]))


def digests(docs: DataFrame, codec: Codec, keys: list[str], with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: ``keys``, n_tokens, SHA-256 of the ids and of the decoded bytes, and the ids if wanted.

    With ``forget`` each task drops what its worker kept for the codec, so that it takes no memory from later stages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, coded, back, all_ids = [], [], [], []
            digits = shared.value.digits
            for ids in shared.value.encode_all(_texts(batch, "text")):
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(shared.value.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
            columns = [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], [*keys, *(f.name for f in fields)])
        if forget:
            shared.value.forget()

    rows = docs.select(*dict.fromkeys([*keys, "text"]))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keys), *fields]))
