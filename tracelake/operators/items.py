"""Dense ids, item-to-knowledge maps and the Q-matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.ranks import global_rank


def dense_ids(rows: DataFrame, col: str, base: int = 0, order: Sequence[str] | None = None) -> DataFrame:
    """(col, dense_id): ids in sorted order, or first-seen order under ``order``.

    Only distinct values are ranked, by the distributed global rank.
    """
    if order is None:
        return global_rank(rows.select(col).distinct(), [col], "_r").select(col, (F.col("_r") + base).alias("dense_id"))
    first = rows.groupBy(col).agg(F.min(F.struct(*order)).alias("_f"))
    flat = first.select(col, *[F.col(f"_f.{c}").alias(f"_f_{c}") for c in order])
    ranked = global_rank(flat, [*[f"_f_{c}" for c in order], col], "_r")
    return ranked.select(col, (F.col("_r") + base).alias("dense_id"))


def item_knowledge(catalog: DataFrame, codes: DataFrame, col: str = "concept") -> DataFrame:
    """(problem_id, knowledge_code): sorted 1-based knowledge codes of each problem."""
    rows = catalog.select("problem_id", F.explode(F.array_distinct("concepts")).alias(col)).join(codes, col)
    return rows.groupBy("problem_id").agg(F.sort_array(F.collect_set("dense_id")).alias("knowledge_code"))


def group_members(rows: DataFrame, granularity: str) -> DataFrame:
    """Distinct problems of each exercise or course."""
    pairs = rows.select(granularity, "problem_id").distinct()
    return pairs.groupBy(granularity).agg(F.sort_array(F.collect_list("problem_id")).alias("members"))


def q_matrix(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Logs with the 0-based knowledge indices of their item (a sparse multi-hot row)."""
    return rows.join(items, "problem_id").withColumn("knowledge", F.transform("knowledge_code", lambda k: k - 1)).drop("knowledge_code")
