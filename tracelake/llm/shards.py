"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A node weighs what its shards weigh together.  A row descends level by level: from its key's hash each child of the node
it is at draws an exponential number of rate the child's weight, and the row goes to the child of the least draw, so that
children are chosen by weight.  Only the children of the chosen nodes draw, so the work for a row grows with the depth.

A node's draw depends on its own number and weight alone.  When weights change, rows move only where a weight on their
path changed: at the first level where a row's old and new place differ, one of the two nodes holds a changed shard, and
rows of subtrees without a change keep their places among each other.  A shard added by :func:`grown` is a subtree of its
own, so it takes rows into itself and moves no others.

Edge cases: a null key is hashed as the empty text and so has one shard; rows of equal key share a shard and have slots
of their own; a null text has no bytes; an empty table gives no rows.  Columns of the input that clash with a result's
name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ranged, run_offsets
from tracelake.session import materialise


LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Shard]:
    """Equal shards, numbered through racks and regions."""
    per_region = racks_per_region * shards_per_rack
    return [Shard(k // per_region, k // shards_per_rack, k) for k in range(n_shards)]


def grown(shards: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region and rack of its own."""
    region, rack, shard = (1 + max(getattr(s, level) for s in shards) for level in LEVELS)
    return [*shards, Shard(region, rack, shard, weight)]


def draw(key: Column, level: str, node: int, weight: float) -> Column:
    """Exponential draw of a row for a node, from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("/", key.cast("string"), F.lit(level), F.lit(str(node))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(uniform) / weight


def _child(key: Column, level: str, shards: Sequence[Shard]) -> Column:
    """The node of ``level`` with the least draw, the first of equal ones, among those that hold ``shards``."""
    weights: dict[int, float] = {}
    for s in shards:
        weights[getattr(s, level)] = weights.get(getattr(s, level), 0.0) + s.weight
    if len(weights) == 1:
        return F.lit(*weights)
    draws = [F.struct(draw(key, level, k, w).alias("draw"), F.lit(k).alias("node")) for k, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["node"]


def assign(rows: DataFrame, key: Column, shards: Sequence[Shard], prefix: str = "") -> DataFrame:
    """``rows`` with ``region``, ``rack`` and ``shard``, each with ``prefix`` before its name."""
    rows = rows.withColumn(f"{prefix}region", _child(key, "region", shards))
    for above, level in zip(LEVELS, LEVELS[1:]):
        below = {node: [s for s in shards if getattr(s, above) == node] for node in sorted({getattr(s, above) for s in shards})}
        at = F.col(f"{prefix}{above}")
        rows = rows.withColumn(f"{prefix}{level}", F.coalesce(*[F.when(at == node, _child(key, level, some)) for node, some in below.items()]))
    return rows


def with_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in ``order``, by ranges, so that no task holds a whole shard."""
    parts = ranged(rows, [F.col("shard"), *(F.col(c) for c in order)])
    offsets = run_offsets(parts, ["shard"], {"rows": F.count(F.lit(1))})
    joined = parts.join(offsets, ["_part", "shard"])
    return joined.withColumn("slot", F.col("_row") - F.col("_lo") + F.col("_before_rows")).drop("_part", "_row", "_lo", "_before_rows")


def write(rows: DataFrame, path: str) -> None:
    """Writes rows that have a shard and a slot into one folder per shard, in slot order, a file or more for each."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """Digest of every document with its place among ``n_shards`` and, for comparison, among one more."""
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tree = layout(n_shards)
    # Written before the ranges are cut, so that texts and draws are computed once.
    placed = materialise(assign(assign(rows, key, tree), key, grown(tree), "grown_"))
    return with_slots(placed, ["_key", "doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"
    )
