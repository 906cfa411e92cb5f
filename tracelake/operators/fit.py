"""Item-response and Rasch fits as aggregation loops.

Answers are first combined to (user, problem, n, y), which bounds a user's rows
by the catalog.  One epoch is one join of those rows with both parameter sides
and one grouped sum; parameters live in one table and are written out every
epoch, so lineage stays flat and a lost executor costs one epoch at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.keys import hash_order
from tracelake.functions.vectors import clip_probability, dot, irf, sigmoid
from tracelake.session import materialise

# Fixed values of the optimiser and the penalties.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8
RASCH_EPOCHS, RASCH_LR = 6, 0.05
RASCH_USER_PENALTY, RASCH_ITEM_PENALTY = 0.1, 1.0
IRF_SCALE = 1.702


def answer_pairs(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, problem_id, n, y) over known problems with a result."""
    usable = logs.filter(F.col("is_correct").isNotNull()).join(catalog.select("problem_id"), "problem_id", "left_semi")
    return usable.groupBy("user_id", "problem_id").agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("y"))


def _start(keys: DataFrame, kind: str, key: str, init: Callable[[Column], list[Column]]) -> DataFrame:
    values = F.array(*init(F.col(key)))
    zero = F.transform(values, lambda _: F.lit(0.0))
    return keys.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), values.alias("p"), zero.alias("m"), zero.alias("v"))


def _adam(params: DataFrame, step: int, lr: float) -> DataFrame:
    m = F.zip_with("m", "g", lambda m, g: BETA1 * m + (1 - BETA1) * g)
    v = F.zip_with("v", "g", lambda v, g: BETA2 * v + (1 - BETA2) * g * g)
    out = params.withColumn("m", m).withColumn("v", v)
    move = F.zip_with("m", "v", lambda m, v: lr * (m / (1 - BETA1**step)) / (F.sqrt(v / (1 - BETA2**step)) + ADAM_EPS))
    return out.withColumn("p", F.zip_with("p", move, lambda p, d: p - d)).drop("g")


def two_sided_fit(
    pairs: DataFrame,
    params: DataFrame,
    width: int,
    gradients: Callable[[DataFrame], DataFrame],
    epochs: int,
    lr: float,
    penalty: Callable[[Column, Column], Column] | None = None,
    recentre: bool = False,
) -> DataFrame:
    """Adam epochs over ``params`` (kind 'u' or 'i', key, p, m, v).

    ``gradients`` takes pairs with both parameter arrays, ``u`` and ``i``, and adds ``gu``
    and ``gi``, each side's loss gradient as an array of ``width``.
    """
    pairs, params = materialise(pairs), materialise(params)
    for step in range(1, epochs + 1):
        users = params.filter(F.col("kind") == "u").select(F.col("key").alias("user_id"), F.col("p").alias("u"))
        items = params.filter(F.col("kind") == "i").select(F.col("key").alias("problem_id"), F.col("p").alias("i"))
        joined = gradients(pairs.join(users, "user_id").join(items, "problem_id"))
        sides = F.array(
            F.struct(F.lit("u").alias("kind"), F.col("user_id").alias("key"), F.col("gu").alias("g")),
            F.struct(F.lit("i").alias("kind"), F.col("problem_id").alias("key"), F.col("gi").alias("g")),
        )
        summed = joined.select(F.inline(sides)).groupBy("kind", "key").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(width)]).alias("_s"))
        grown = params.join(summed, ["kind", "key"], "left")
        total = F.transform("p", lambda x, k: F.coalesce(F.get("_s", k), F.lit(0.0)))
        if penalty is not None:
            total = F.zip_with(total, penalty(F.col("kind"), F.col("p")), lambda a, b: a + b)
        params = materialise(_adam(grown.withColumn("g", total).drop("_s"), step, lr))
        if recentre:
            mean = params.filter(F.col("kind") == "i").agg(F.avg(F.col("p")[0])).first()[0] or 0.0
            params = params.withColumn("p", F.when(F.col("kind") == "i", F.transform("p", lambda x: x - mean)).otherwise(F.col("p")))
    return params


def _filled(cols: list[Column], width: int) -> Column:
    return F.array(*cols, *[F.lit(0.0)] * (width - len(cols)))


def rasch(logs: DataFrame, catalog: DataFrame, epochs: int = RASCH_EPOCHS, lr: float = RASCH_LR, scale: float = 1.0, raw: bool = False) -> DataFrame:
    """(problem_id, mu): tanh of the recentred difficulty of every catalog problem (``raw`` skips tanh).

    The user penalty averages over all users seen, also those without a usable result.
    """
    pairs = answer_pairs(logs, catalog)
    n_users = logs.agg(F.countDistinct("user_id")).first()[0]
    n_items = catalog.count()
    n_rows = logs.filter(F.col("is_correct").isNotNull()).join(catalog.select("problem_id"), "problem_id", "left_semi").count()
    zero = lambda _: [F.lit(0.0)]
    params = _start(pairs.select("user_id").distinct(), "u", "user_id", zero).unionByName(_start(catalog, "i", "problem_id", zero))

    def gradients(rows: DataFrame) -> DataFrame:
        p = sigmoid(scale * (F.col("u")[0] - F.col("i")[0]))
        rows = rows.withColumn("_r", scale * (F.col("n") * p - F.col("y")) / F.lit(float(max(n_rows, 1))))
        return rows.withColumn("gu", F.array("_r")).withColumn("gi", F.array(-F.col("_r")))

    def penalty(kind: Column, p: Column) -> Column:
        weight = F.when(kind == "u", 2 * RASCH_USER_PENALTY / max(n_users, 1)).otherwise(2 * RASCH_ITEM_PENALTY / max(n_items, 1))
        return F.transform(p, lambda x: weight * x)

    fitted = two_sided_fit(pairs, params, 1, gradients, epochs, lr, penalty, recentre=True)
    value = F.col("p")[0] if raw else F.tanh(F.col("p")[0])
    return fitted.filter(F.col("kind") == "i").select(F.col("key").alias("problem_id"), value.alias("mu"))


def _hashed_init(key: Column, k: int) -> Column:
    """Start value in [-0.5, 0.5), fixed by key and dimension."""
    return F.conv(F.substring(hash_order(k, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) - 0.5


def _softplus(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def irt(logs: DataFrame, catalog: DataFrame, epochs: int = 10, lr: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Three-parameter fit: users (user_id, theta) and items (problem_id, a, b, c)."""
    pairs = answer_pairs(logs, catalog)
    total = F.lit(float(max(pairs.agg(F.sum("n")).first()[0] or 0, 1)))
    params = _start(pairs.select("user_id").distinct(), "u", "user_id", lambda _: [F.lit(0.0)]).unionByName(
        _start(pairs.select("problem_id").distinct(), "i", "problem_id", lambda _: [F.lit(0.0), F.lit(0.0), F.lit(-2.0)])
    )

    def gradients(rows: DataFrame) -> DataFrame:
        # One column per step: each is used by several later ones.
        u, i = F.col("u"), F.col("i")
        a, c, s, p, dp, dz = (F.col(f"_{x}") for x in ("a", "c", "s", "p", "dp", "dz"))
        gap = u[0] - i[1]
        rows = rows.withColumn("_a", _softplus(i[0])).withColumn("_c", sigmoid(i[2]))
        rows = rows.withColumn("_s", sigmoid(IRF_SCALE * a * gap))
        rows = rows.withColumn("_p", clip_probability(c + (1 - c) * s))
        rows = rows.withColumn("_dp", (F.col("n") * p - F.col("y")) / (p * (1 - p)) / total)
        rows = rows.withColumn("_dz", IRF_SCALE * dp * (1 - c) * s * (1 - s))
        rows = rows.withColumn("gu", _filled([dz * a], 3))
        return rows.withColumn("gi", F.array(dz * gap * sigmoid(i[0]), -dz * a, dp * (1 - s) * c * (1 - c)))

    fitted = two_sided_fit(pairs, params, 3, gradients, epochs, lr)
    users = fitted.filter(F.col("kind") == "u").select(F.col("key").alias("user_id"), F.col("p")[0].alias("theta"))
    items = fitted.filter(F.col("kind") == "i").select(
        F.col("key").alias("problem_id"), _softplus(F.col("p")[0]).alias("a"), F.col("p")[1].alias("b"), sigmoid(F.col("p")[2]).alias("c")
    )
    return users, items


def mirt(logs: DataFrame, catalog: DataFrame, dims: int = 3, epochs: int = 10, lr: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Multidimensional two-parameter fit: users (user_id, theta) and items (problem_id, a, b)."""
    pairs = answer_pairs(logs, catalog)
    total = F.lit(float(max(pairs.agg(F.sum("n")).first()[0] or 0, 1)))
    params = _start(pairs.select("user_id").distinct(), "u", "user_id", lambda key: [_hashed_init(key, k) for k in range(dims)]).unionByName(
        _start(pairs.select("problem_id").distinct(), "i", "problem_id", lambda key: [*[_hashed_init(key, k) for k in range(dims)], F.lit(0.0)])
    )

    def gradients(rows: DataFrame) -> DataFrame:
        u, i, a, r = F.col("u"), F.col("i"), F.col("_a"), F.col("_r")
        rows = rows.withColumn("_a", F.array(*[_softplus(i[k]) for k in range(dims)]))
        z = sum((a[k] * u[k] for k in range(dims)), F.lit(0.0)) - i[dims]
        rows = rows.withColumn("_r", (F.col("n") * sigmoid(z) - F.col("y")) / total)
        rows = rows.withColumn("gu", _filled([r * a[k] for k in range(dims)], dims + 1))
        return rows.withColumn("gi", F.array(*[r * u[k] * sigmoid(i[k]) for k in range(dims)], -r))

    fitted = two_sided_fit(pairs, params, dims + 1, gradients, epochs, lr)
    users = fitted.filter(F.col("kind") == "u").select(F.col("key").alias("user_id"), F.slice("p", 1, dims).alias("theta"))
    items = fitted.filter(F.col("kind") == "i").select(
        F.col("key").alias("problem_id"), F.transform(F.slice("p", 1, dims), _softplus).alias("a"), F.col("p")[dims].alias("b")
    )
    return users, items


def predict_irt(logs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``score`` from a three-parameter fit."""
    return logs.join(users, "user_id").join(items, "problem_id").withColumn("score", irf(F.col("theta"), F.col("a"), F.col("b"), F.col("c"), IRF_SCALE))


def predict_mirt(logs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return logs.join(users, "user_id").join(items, "problem_id").withColumn("score", sigmoid(dot(F.col("a"), F.col("theta")) - F.col("b")))


__all__: Sequence[str] = ("answer_pairs", "two_sided_fit", "rasch", "irt", "mirt", "predict_irt", "predict_mirt")
