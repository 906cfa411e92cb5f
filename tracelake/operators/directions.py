"""Level directions of concepts, difficulty injection and co-usage vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import vectors as V
from tracelake.operators.sequences import chunk
from tracelake.session import materialise

CO_USAGE_SIZE, CO_USAGE_WINDOW = 64, 5
SENTENCE = 1000
# Concepts whose matrices are decomposed together.
SOLVED_AT_ONCE = 256


def principal_directions(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """(concept, direction): first principal direction of the concept's problem vectors.

    Pointed so that the highest level projects above the lowest; a single
    problem gives its own unit vector.  Every task sums the products of its own
    rows per concept, those partial sums are added, and one d x d matrix per
    concept remains: a concept's rows are never gathered.
    """
    rows = catalog.select("problem_id", "level", F.explode("concepts").alias("concept")).join(vectors.select("problem_id", "vec"), "problem_id")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for concept, part in batch.groupby("concept", sort=False):
                x = np.stack(part["vec"].to_numpy())
                out.append((concept, float(len(x)), x.sum(0), (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=["concept", "n", "total", "gram"])

    sums = rows.select("concept", "vec").mapInPandas(partial, "concept string, n double, total array<double>, gram array<double>")
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c)))
    sums = sums.groupBy("concept").agg(F.sum("n").alias("n"), add("total").alias("total"), add("gram").alias("gram"))

    by_level = rows.groupBy("concept", "level").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean"))
    ends = by_level.groupBy("concept").agg(
        F.min_by("mean", "level").alias("low"), F.max_by("mean", "level").alias("high"), F.count(F.lit(1)).alias("levels")
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SOLVED_AT_ONCE):
                part = batch.iloc[start : start + SOLVED_AT_ONCE]
                n, total = part["n"].to_numpy(), np.stack(part["total"].to_numpy())
                d = total.shape[1]
                gram = np.stack(part["gram"].to_numpy()).reshape(-1, d, d)
                axis = np.linalg.eigh(gram - total[:, :, None] * total[:, None, :] / n[:, None, None])[1][:, :, -1]
                rise = np.einsum("ij,ij->i", axis, np.stack(part["high"].to_numpy()) - np.stack(part["low"].to_numpy()))
                axis = np.where(((part["levels"].to_numpy() >= 2) & (rise < 0))[:, None], -axis, axis)
                size = np.linalg.norm(total, axis=1, keepdims=True)
                alone = np.divide(total, size, out=np.zeros_like(total), where=size > 0)
                yield pd.DataFrame({"concept": part["concept"], "direction": list(np.where((n == 1)[:, None], alone, axis))})

    return sums.join(ends, "concept").mapInPandas(solve, "concept string, direction array<double>")


def problem_directions(catalog: DataFrame, directions: DataFrame) -> DataFrame:
    """(problem_id, direction): unit mean of the directions of a problem's concepts; zeros without any."""
    rows = catalog.select("problem_id", F.explode("concepts").alias("concept")).join(directions, "concept")
    means = rows.groupBy("problem_id").agg(vector_to_array(Summarizer.mean(array_to_vector("direction"))).alias("_m"))
    return means.select("problem_id", V.normalise(F.col("_m")).alias("direction"))


def inject(vectors: DataFrame, difficulty: DataFrame, directions: DataFrame) -> DataFrame:
    """``v + mu * direction`` per problem; missing parts leave the vector as it is."""
    joined = vectors.join(difficulty.select("problem_id", "mu"), "problem_id", "left").join(directions, "problem_id", "left")
    moved = V.add_scaled(F.col("vec"), F.col("direction"), F.coalesce("mu", F.lit(0.0)))
    return joined.withColumn("vec", F.coalesce(moved, F.col("vec"))).drop("mu", "direction")


def co_usage_vectors(rows: DataFrame, size: int = CO_USAGE_SIZE, window: int = CO_USAGE_WINDOW, seed: int = 42) -> DataFrame:
    """(problem_id, vec) from skip-gram over users' problem sequences.

    Sequences are cut into sentences of bounded length, the cut the estimator
    makes itself, so no long user is gathered.
    """
    sentences = chunk(rows.select("user_id", "pos", "problem_id"), SENTENCE, {"problem_id": None}, min_size=2)
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxSentenceLength=SENTENCE, seed=seed, inputCol="problem_id", outputCol="_v").fit(sentences)
    return model.getVectors().select(F.col("word").alias("problem_id"), vector_to_array("vector").alias("vec"))


#: Rows of a block that are compared with another block at once.
NEAREST_ROWS = 128


def nearest_items(vectors: DataFrame, k: int = 5, block: int = 16384) -> DataFrame:
    """(problem_id, rank, neighbor_id, score): exact nearest problems by cosine; ``problem_id`` is unique.

    Problems of equal vectors have the same scores, and of them the first ``k + 1`` by name stand for all.  So distinct
    unit vectors are packed into blocks; every pair of blocks is a matrix product, taken a few rows at a time, that
    returns only its own top ``k + 1``, so similarities of all pairs never leave a task.  A problem takes its vector's list
    without itself.  The work grows with the square of the distinct vectors, not of the problems.
    """
    unit = materialise(vectors.select("problem_id", V.normalise(F.col("vec")).alias("vec")))
    distinct = materialise(unit.select("vec").distinct().withColumn("_g", F.monotonically_increasing_id()))
    members = materialise(unit.join(distinct, "vec").select("problem_id", "_g"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("problem_id"))
    heads = members.withColumn("_k", place).filter(F.col("_k") <= k + 1).groupBy("_g").agg(F.collect_list("problem_id").alias("names"))
    blocks = max(-(-distinct.count() // block), 1)
    home, every = F.pmod(F.xxhash64("_g"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = distinct.select(F.col("_g").alias("own"), F.col("vec").alias("mine"), home.alias("lb"), every.alias("rb"))
    right = distinct.join(heads, "_g").withColumn("rb", home).withColumn("lb", every)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_g": [], "neighbor_id": [], "score": []})
        names, others = b["names"].to_numpy(), np.stack(b["vec"].to_numpy()).T
        own, mine = a["own"].to_numpy(), np.stack(a["mine"].to_numpy())
        top = min(k + 1, len(names))
        out = []
        for at in range(0, len(own), NEAREST_ROWS):
            scores = np.round(mine[at : at + NEAREST_ROWS] @ others, 9)
            least = np.partition(scores, -top, axis=1)[:, -top]
            for g, row, low in zip(own[at : at + NEAREST_ROWS], scores, least):
                near = sorted((-row[j], name) for j in np.nonzero(row >= low)[0] for name in names[j])
                out += [(g, name, -score) for score, name in near[: k + 1]]
        return pd.DataFrame(out, columns=["_g", "neighbor_id", "score"])

    tops = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(best, "_g long, neighbor_id string, score double")
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("score"), "neighbor_id"))
    item = F.struct("_k", "neighbor_id", "score")
    lists = tops.withColumn("_k", rank).filter(F.col("_k") <= k + 1).groupBy("_g").agg(F.sort_array(F.collect_list(item)).alias("_l"))
    others = F.slice(F.filter("_l", lambda x: x["neighbor_id"] != F.col("problem_id")), 1, k)
    each = members.join(lists, "_g").select("problem_id", F.posexplode(others).alias("_at", "_n"))
    return each.select("problem_id", "_n.neighbor_id", "_n.score", (F.col("_at") + 1).alias("rank"))
