"""Row numbers and running sums that never need one task to see one whole group.

``Window.partitionBy(user)`` sorts a user in one task, a dead end when one user
owns a large share of the data.  The functions here range-partition the full sort key
instead, number rows inside each range, and add per-range offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.session import materialise


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _range_numbered(df: DataFrame, order: Sequence[str | Column], unwritten: Sequence[str] = ()) -> DataFrame:
    """Range-partitioned, sorted copy with ``_part`` and an increasing ``_row``.

    Written out once, because range bounds are sampled: two evaluations of the
    same plan may cut the ranges differently.
    """
    keys = _cols(order)
    return materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(*unwritten)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )


def _range_offsets(ranged: DataFrame, *totals: Column) -> DataFrame:
    """One row per range with the running totals of all earlier ranges.

    The input has one row per range, so the window over a single key holds at
    most as many rows as the shuffle has partitions.
    """
    per_range = ranged.groupBy("_part").agg(F.min("_row").alias("_lo"), *totals)
    names = [c for c in per_range.columns if c not in ("_part", "_lo")]
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        "_part", "_lo", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names]
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank", unwritten: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position of every row in one total order.  Columns of ``unwritten`` only order, and drop out."""
    ranged = _range_numbered(df, order, unwritten)
    offsets = _range_offsets(ranged, F.count(F.lit(1)).alias("n"))
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, F.col("_row") - F.col("_lo") + F.col("_before_n"))
        .drop("_part", "_row", "_lo", "_before_n")
    )


def global_prefix_sum(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str]) -> DataFrame:
    """Adds ``cum_<c>``, the inclusive running sum of each column in one total order."""
    ranged = _range_numbered(df, order)
    offsets = _range_offsets(ranged, *[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, "_part")
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(inside) + F.col(f"_before_{c}"))
    return out.drop("_part", "_row", "_lo", *[f"_before_{c}" for c in sums])


def _places(keys: Sequence[str]):
    """Batches of sorted rows with ``_place``, the 0-based place of each row in its run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            columns = [batch.column(k) for k in keys]
            for column in columns:
                new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), dtype=bool)
            first = [column[0].as_py() for column in columns]
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, 0))
            place = at - start
            if first == last:
                place[start == 0] += seen
            last, seen = [column[-1].as_py() for column in columns], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "_place"])

    return run


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos", keep: Sequence[str] | None = None) -> DataFrame:
    """0-based position of each row inside its key, under a total ``order``; rows without a key drop out.

    Rows are range-partitioned by key and order, numbered inside each range, and shifted by what earlier ranges hold of
    the key; a key that fills many ranges is numbered by as many tasks.  Only the first key of a range can have begun
    before it, so the shifts are as many as the ranges, and the rows move once.  ``keep`` names the columns to keep
    beside the keys (all, if None): what only the order needs is not written.
    """
    keys = list(keys)
    kept = df.columns if keep is None else [c for c in df.columns if c in keys or c in keep]
    ordered = [*_cols(keys), *_cols(order)]
    sorted_rows = df.filter(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    sorted_rows = sorted_rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select(*kept)
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField("_place", T.LongType(), False)])
    # Written once, because range bounds are sampled.
    ranged = materialise(sorted_rows.mapInArrow(_places(keys), schema).withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = ranged.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    edges = ends.select(F.explode(F.array("_first", "_last")).alias("_k")).select("_k.*").distinct()
    held = ranged.join(F.broadcast(edges), keys, "left_semi").groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = held.withColumn("_skip", F.sum("_n").over(earlier)).drop("_n").filter(F.col("_skip") > 0)
    return (
        ranged.join(F.broadcast(skips), ["_part", *keys], "left")
        .withColumn(name, (F.col("_place") + F.coalesce("_skip", F.lit(0))).cast("int"))
        .drop("_part", "_place", "_skip")
    )
