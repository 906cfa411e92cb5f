"""SimHash fingerprints and near-duplicate components by pigeonring filtering.

The 64 bits are cut into ``SEGMENTS`` segments on a ring.  If two fingerprints differ in at most ``RADIUS`` bits, there is
a segment from which, for every length l, the chain of the next l segments differs in at most l * RADIUS / SEGMENTS bits.
With five segments and radius two the budgets of the chains are 0, 0, 1, 1 and 2: a pair meets where two neighbouring
segments are equal (the key of the candidate join), its longer chains are held against their budgets, and only then
the whole Hamming distance is taken.

Where many distinct fingerprints share a key (a large family of near copies), pairs would grow with the square of the
family.  There the same links are followed through midpoints: two fingerprints differ in at most two bits if, and only
if, flipping at most one bit of each can give the same value.  Each member is sent to its own value and the values at
one bit outside the shared key, and all who meet at a value are linked to the smallest.  A meeting holds at most 65
distinct fingerprints, so no group grows.

Edge cases: a null or word-less text has fingerprint 0 and is linked like any other; a text of one or two words is one
shingle; null doc_ids are grouped like others, and a group's id is its smallest non-null doc_id (null if it has none);
repeated rows have equal fingerprints and share a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.components import components
from tracelake.session import materialise

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 2, 5
#: Above so many distinct fingerprints at one key, links are found by midpoints instead of pairs.  Both are exact.
PAIRS_UP_TO = 64
#: Bytes of text that are hashed together; longer texts continue in the next piece.
PIECE_BYTES = 1 << 20
#: Bytes A-Z to a-z.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists that overlap by one word less than a shingle."""
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carried + text[at:end].split()
        at = end
        if at >= len(text) or len(words) >= SHINGLE:
            yield words
            words = words[len(words) - SHINGLE + 1 :] if len(words) >= SHINGLE else words
        carried = words


def fingerprint(text: str | None) -> int:
    """Bit k is set if it is set in over half of the hashes of the text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), 0
    for words in _pieces((text or "").encode().translate(_LOWER)):
        if len(words) >= SHINGLE:
            grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
        elif words and not total:
            grams = iter([b" ".join(words)])
        else:
            continue
        hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for start in range(0, len(bits), 255):  # sums of 255 fit a byte
            ones += bits[start : start + 255].sum(axis=0, dtype=np.uint8)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def with_fingerprint(docs: DataFrame, keep: Sequence[str], into: str = "fp") -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed bigint."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found.view(np.int64))], [*names, into])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(into, T.LongType())])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def _masks() -> list[int]:
    """The segments' masks; the first ones are a bit wider where 64 does not divide."""
    bounds = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(bounds)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _equal_run() -> int:
    """Length of the longest chain whose budget is 0."""
    return max(n for n in range(1, SEGMENTS + 1) if n * RADIUS // SEGMENTS == 0)


def _ring_mask(start: int, length: int) -> int:
    masks = _masks()
    return _signed(sum(masks[(start + k) % SEGMENTS] for k in range(length)))


def _keys(fps: DataFrame) -> DataFrame:
    """A row per fingerprint and starting segment, with the bits of the chain that has to be equal."""
    run = _equal_run()
    starts = F.array(*[F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_ring_mask(s, run))).alias("key")) for s in range(SEGMENTS)])
    return fps.select("fp", F.explode(starts).alias("_k")).select("fp", "_k.start", "_k.key")


def _chain_holds(differ: Column, start: Column) -> Column:
    """Whether every chain from ``start`` keeps its budget; the last chain is the whole Hamming check."""
    by_start = []
    for s in range(SEGMENTS):
        checks = [F.bit_count(differ.bitwiseAND(F.lit(_ring_mask(s, n)))) <= n * RADIUS // SEGMENTS for n in range(_equal_run() + 1, SEGMENTS + 1)]
        held = checks[0]
        for c in checks[1:]:
            held = held & c
        by_start.append((start == s) & held)
    out = by_start[0]
    for c in by_start[1:]:
        out = out | c
    return out


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, in whose components are all pairs within ``RADIUS`` bits."""
    keyed = materialise(_keys(fps))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    crowded = sizes.filter(F.col("n") > PAIRS_UP_TO).select("start", "key")
    few = keyed.join(sizes.filter(F.col("n") <= PAIRS_UP_TO).select("start", "key"), ["start", "key"], "left_semi")
    left, right = few.alias("l"), few.alias("r")
    differ = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    pairs = left.join(
        right,
        (F.col("l.start") == F.col("r.start")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & _chain_holds(differ, F.col("l.start")),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    many = keyed.join(crowded, ["start", "key"], "left_semi")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    key_mask = F.element_at(F.array(*[F.lit(_ring_mask(s, _equal_run())) for s in range(SEGMENTS)]), F.col("start") + 1)
    free = F.filter(flips, lambda f: f.bitwiseAND(key_mask) == 0)
    meet = many.select("start", "fp", F.explode(F.transform(free, lambda f: f.bitwiseXOR(F.col("fp")))).alias("at"))
    least = meet.groupBy("start", "at").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter(F.col("a") < F.col("top")).drop("top")
    met = meet.join(least, ["start", "at"]).filter(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(met.distinct())


def near_duplicates(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``fp``, ``root`` (a fingerprint that names the group) and ``component_id``, a row per document."""
    printed = materialise(with_fingerprint(docs, keep))
    fps = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(fps.select("fp")))
    rooted = materialise(
        fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    )
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return printed.join(rooted.select("fp", "root").join(ids, "root"), "fp")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in hexadecimal digits, and the component."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of smallest doc_id of each group, one row for each group; nulls come last, equal rows count once."""
    names = docs.columns
    # Two hashes of the whole row stand for it: never null, and equal for repeated rows alone.
    marks = {"_m1": F.xxhash64(*names), "_m2": F.xxhash64(F.lit(1), *reversed(names))}
    marked = docs.withColumns(marks)
    grouped = near_duplicates(marked, ["doc_id", *marks])
    chosen = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks)).alias("_c")).select("_c._m1", "_c._m2")
    return marked.join(chosen, [*marks], "left_semi").dropDuplicates([*marks]).select(*names)
