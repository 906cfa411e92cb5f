"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is taken from the mean of all vectors, scaled to length 1 and rotated by a random rotation; the signs of its
components are its code.  The code stands for a vertex of a cube, and the inner product of vertex and vector is the
correction scalar: <vertex, query> / <vertex, vector> estimates <vector, query> without bias, and its error is within
``BOUND`` * sqrt((1 - s^2) / s^2 / (dimensions - 1)) with a probability that grows fast with ``BOUND`` (s the scalar).
For each query, the candidates of a block are ordered by their upper bounds, and exact inner products are taken from the
top until the next upper bound is under the query's 20th exact product.

Candidates and queries are dealt out in blocks by hash of their ids; each block of queries meets each block of
candidates once, in a task of its own, and sends its 20 best on.

Edge cases: null, empty or zero vectors and those with a null or non-finite component take no part, nor do rows without
a vec_id; vectors of another length than the query's are not its candidates; of rows that share a vec_id the smallest
vector stands for all; ties go to the smaller vec_id; a query with fewer candidates than wanted returns all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import materialise

#: Width of the error bound; at 1.9 a bound fails about once in a hundred, at 3.5 about once in 10,000.
BOUND = 3.5
#: Vectors in a block of candidates and in a block of queries, about.
BLOCK, QUERY_BLOCK = 16_384, 4_096
SEED = 7


def rotation(dimensions: int) -> np.ndarray:
    """A random rotation, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Packed codes of residuals with their correction scalars, and what the vectors add outside the residual."""

    packed: np.ndarray
    scalar: np.ndarray
    norm: np.ndarray
    along: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, mean: np.ndarray) -> Codes:
        residual = vectors - mean
        norm = np.linalg.norm(residual, axis=1)
        unit = residual / np.where(norm > 0, norm, 1)[:, None] @ rotation(len(mean))
        scalar = np.abs(unit).sum(axis=1) / np.sqrt(len(mean))
        return cls(np.packbits(unit >= 0, axis=1), np.where(norm > 0, scalar, 1.0), norm, vectors @ mean)

    def upper_bounds(self, queries: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, a row per query."""
        d = len(mean)
        residual = queries - mean
        q_norm = np.linalg.norm(residual, axis=1)
        unit = (residual / np.where(q_norm > 0, q_norm, 1)[:, None] @ rotation(d)).astype(np.float32)
        signs = np.unpackbits(self.packed, axis=1, count=d).astype(np.float32) * 2 - 1
        estimate = unit @ signs.T / (np.sqrt(d) * self.scalar).astype(np.float32)
        error = BOUND * np.sqrt(np.maximum(1 - self.scalar**2, 0) / self.scalar**2 / max(d - 1, 1)) + 1e-6
        bound = np.minimum(estimate + error, 1.0 + 1e-6) * self.norm * q_norm[:, None]
        return bound + self.along + (residual @ mean)[:, None]


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += queries[:, k] * vectors[:, k]
    return total


def best_in_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """For each query (query ids, vec_ids, scores) of its k best in the block, reranking while bounds allow more."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    codes = Codes.of(vectors, mean)
    found = []
    for start in range(0, len(queries), 256):
        bounds = codes.upper_bounds(queries[start : start + 256], mean)
        for row, bound in enumerate(bounds):
            q, own = queries[start + row], q_ids[start + row]
            bound[ids == own] = -np.inf
            taken, step = np.zeros(0, np.int64), 4 * k
            scores = np.zeros(0)
            left = len(ids)
            while left:
                step = min(step, left)
                if step < left:
                    top = np.argpartition(-bound, step - 1)[:step]
                else:
                    top = np.nonzero(bound > -np.inf)[0]
                if len(scores) >= k:
                    top = top[bound[top] >= np.partition(scores, -k)[-k]]
                if not len(top):
                    break
                products = exact(np.broadcast_to(q, (len(top), len(q))), vectors[top])
                taken, scores = np.concatenate([taken, top]), np.concatenate([scores, products])
                bound[top] = -np.inf
                left -= step
                step *= 2
            best = np.lexsort((ids[taken], -scores))[:k]
            found.append((np.full(len(best), own), ids[taken[best]], scores[best]))
    return found


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vec as array<double>, dims): a row per id, of vectors that take part."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(~bad & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dims", F.size("vec"))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k nearest of every query; ``is_query`` is a condition on ``id``."""
    rows = materialise(usable(vectors, id_column, column))
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    sizes = sizes.select("dims", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERY_BLOCK)).cast("int").alias("q_blocks"))
    means = (
        rows.select("dims", F.posexplode("vec").alias("at", "x")).groupBy("dims", "at").agg(F.avg("x").alias("x"))
        .groupBy("dims").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))  # as long as a vector
    )
    shape = materialise(sizes.join(means, "dims"))
    placed = rows.join(shape, "dims")
    draw = F.xxhash64("id", F.lit(SEED))
    candidates = placed.select(
        "dims", F.pmod(draw, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), "id", "vec"
    )
    queries = placed.filter(is_query).select(
        F.col("dims").alias("at_dims"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at_block"),
        F.pmod(draw, F.col("q_blocks")).cast("int").alias("at_q_block"),
        F.col("id").alias("q_id"),
        F.col("vec").alias("q_vec"),
        "mean",
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        found = best_in_block(
            left["q_id"].to_numpy(), np.stack(left["q_vec"].to_numpy()), right["id"].to_numpy(), np.stack(right["vec"].to_numpy()), np.array(left["mean"].iloc[0]), k
        )
        return pd.DataFrame({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    paired = queries.groupBy("at_dims", "at_block", "at_q_block").cogroup(candidates.groupBy("dims", "block", "q_block"))
    met = paired.applyInPandas(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
