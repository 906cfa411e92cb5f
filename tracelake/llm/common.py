"""What the operators of this subpackage share: tables, words, row keys and exact running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.session import apply_settings, materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# A word is a run of anything but ASCII white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with its SQL twin if there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranged(df: DataFrame, order: Sequence[Column], running: tuple[str, str] | None = None) -> DataFrame:
    """Range-partitioned and sorted copy in the shared folder, with ``_part`` and a ``_row`` that grows with the order.

    With ``running``, a key column that leads the order and a bigint column, ``_inside`` is the sum of the second over
    the earlier rows of the same key in the same range.  Written once: range bounds are sampled, so two evaluations of
    one plan may cut differently.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    return materialise(_with_running_sum(rows, *running) if running else rows)


def _with_running_sum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``_inside``; one look at each row in its order, without another shuffle."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(key), batch.column(value).to_numpy()
            equal = np.asarray(pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False), dtype=bool)
            null = np.asarray(keys.is_null())
            new = np.concatenate([[True], ~(equal | (null[1:] & null[:-1]))])
            carried = last is not None and last[0] == keys[0].as_py()
            before = np.cumsum(values) - values
            first = np.nonzero(new)[0]
            inside = before - np.repeat(before[first], np.diff(np.append(first, len(keys))))
            if carried:
                inside[: first[1] if len(first) > 1 else None] += total
            last, total = (keys[-1].as_py(),), int(inside[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], [*names, "_inside"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_inside", T.LongType())]))


def run_offsets(rows: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """For each range and key: ``_lo``, the first ``_row``, and ``_before_<name>``, the key's total in all earlier ranges.

    A row per range and key at most, so a key's window holds no more rows than there are partitions.
    """
    runs = rows.groupBy("_part", *keys).agg(F.min("_row").alias("_lo"), *[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        "_part", *keys, "_lo", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, keeping the left key columns."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])
