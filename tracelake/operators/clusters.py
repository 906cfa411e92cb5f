"""Two-level clustering of problems and the labels of the clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions.keys import hash_order
from tracelake.functions.vectors import let
from tracelake.session import materialise

# Fixed values of the clustering and labelling.
MACRO_K, MICRO_K = 50, 5
RESTARTS, SEED = 10, 42
TFIDF_VOCABULARY = 5000
MACRO_WORDS, MICRO_WORDS = 1, 2


def macro_clusters(vectors: DataFrame, k: int = MACRO_K, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """(problem_id, vec, macro): the cheapest of several seeded k-means runs."""
    points = materialise(vectors.select("problem_id", "vec"))
    features = points.withColumn("features", array_to_vector("vec"))
    k = max(min(k, points.count()), 1)
    if k < 2:
        return points.withColumn("macro", F.lit(0))
    models = [KMeans(k=k, seed=seed + r, maxIter=20, featuresCol="features", predictionCol="macro").fit(features) for r in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(features).select("problem_id", "vec", "macro")


def _nearest(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the closest centre of their group: ``micro`` and ``cost``."""
    def gap(c: Column) -> Column:
        return F.aggregate(F.zip_with("vec", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    closest = F.array_min(F.transform("centres", lambda c: F.struct(gap(c).alias("cost"), c["micro"].alias("micro"))))
    return points.join(centres, keys).withColumn("_c", closest).select(*points.columns, "_c.micro", "_c.cost")


def micro_clusters(macro: DataFrame, k: int = MICRO_K, restarts: int = RESTARTS, seed: int = SEED, iterations: int = 10) -> DataFrame:
    """Adds ``micro``: k-means inside every macro cluster, all clusters and restarts at once.

    Centres are a small table (cluster, restart, k); each step assigns points
    row by row and averages them with a map-side-combined mean, so a cluster
    holding a large share of all problems is still spread over all tasks.
    """
    points = materialise(macro)
    runs = points.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    keys = ["macro", "run"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    first = runs.withColumn("_h", F.concat_ws("-", "run", hash_order(seed, F.col("run"), F.col("problem_id")))).withColumn("_k", order)
    first = first.filter(F.col("_k") <= k).select(*keys, F.struct((F.col("_k") - 1).alias("micro"), F.col("vec").alias("centre")).alias("_c"))
    centres = materialise(first.groupBy(*keys).agg(F.sort_array(F.collect_list("_c")).alias("centres")))
    for _ in range(iterations):
        assigned = _nearest(runs, centres, keys)
        means = assigned.groupBy(*keys, "micro").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("centre"))
        centres = materialise(means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("micro", "centre"))).alias("centres")))
    final = _nearest(runs, centres, keys)
    costs = final.groupBy(*keys).agg(F.sum("cost").alias("_cost"))
    best = costs.groupBy("macro").agg(F.min_by("run", F.struct(F.round("_cost", 9), "run")).alias("run"))
    return final.join(best, keys, "left_semi").select("problem_id", "vec", "macro", "micro")


def renumbered(clusters: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Cluster numbers by smallest member inside ``keys[:-1]``, independent of the start."""
    firsts = clusters.groupBy(*keys).agg(F.min("problem_id").alias("_first"))
    scope = keys[:-1] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy("_first")) - 1
    numbers = firsts.withColumn("_new", rank).drop("_first")
    return clusters.join(numbers, keys).drop(name).withColumnRenamed("_new", name)


def two_level_clusters(vectors: DataFrame, k1: int = MACRO_K, k2: int = MICRO_K, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """(problem_id, macro, micro), both renumbered by smallest member."""
    macro = renumbered(macro_clusters(vectors, k1, restarts, seed), ["macro"], "macro")
    micro = micro_clusters(macro, k2, restarts, seed)
    return renumbered(micro, ["macro", "micro"], "micro").select("problem_id", "macro", "micro")


# -- labels ------------------------------------------------------------------


def cluster_tokens(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, count) of clean tokens longer than one character.

    Raw tokens are counted first, so the noise rules run once per distinct
    token of a cluster instead of once per occurrence.
    """
    raw = texts.select(*keys, F.explode(X.raw_tokens(F.col(text))).alias("_raw")).groupBy(*keys, "_raw").agg(F.count(F.lit(1)).alias("_n"))
    clean = raw.withColumn("token", X.clean_token(F.col("_raw"))).filter(F.length("token") > 1)
    return clean.groupBy(*keys, "token").agg(F.sum("_n").alias("count"))


def frequency_labels(tokens: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(keys, label): the most frequent tokens of each cluster joined by '-', names breaking ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "token"))
    top = tokens.withColumn("_r", rank).filter(F.col("_r") <= words)
    listed = F.sort_array(F.collect_list(F.struct("_r", "token")))
    return top.groupBy(*keys).agg(listed.alias("_t")).select(*keys, F.array_join(F.col("_t.token"), "-").alias("label"))


def class_tfidf(tokens: DataFrame, documents: DataFrame, key: str, vocabulary: int = TFIDF_VOCABULARY) -> DataFrame:
    """(key, token, weight): count per document times ln(1 + K / clusters with the token)."""
    totals = tokens.groupBy("token").agg(F.sum("count").alias("_total"), F.count(F.lit(1)).alias("df"))
    kept = totals.orderBy(F.desc("_total"), "token").limit(vocabulary)
    docs = documents.groupBy(key).agg(F.count(F.lit(1)).alias("docs"))
    k = docs.agg(F.count(F.lit(1))).scalar()
    return tokens.join(kept, "token").join(docs, key).select(
        key, "token", (F.col("count") / F.col("docs") * F.log(1 + k / F.col("df"))).alias("weight")
    )


def semantic_ids(catalog: DataFrame, clusters: DataFrame) -> DataFrame:
    """(problem_id, semantic_id, macro_fallback, micro_fallback, collapsed) from frequency labels."""
    texts = catalog.select(
        "problem_id", X.cluster_text(F.col("problem_id"), F.col("text"), F.col("title"), F.col("concepts")).alias("ctext")
    ).join(clusters, "problem_id")
    macro = frequency_labels(cluster_tokens(texts, ["macro"], "ctext"), ["macro"], MACRO_WORDS).withColumnRenamed("label", "macro_label")
    micro = frequency_labels(cluster_tokens(texts, ["macro", "micro"], "ctext"), ["macro", "micro"], MICRO_WORDS).withColumnRenamed("label", "micro_label")
    labelled = catalog.join(clusters, "problem_id").join(macro, "macro", "left").join(micro, ["macro", "micro"], "left")
    return compose(labelled)


def compose(labelled: DataFrame) -> DataFrame:
    """Semantic ids from ``macro_label`` and ``micro_label`` with counted fallbacks and collapses."""
    fields = [F.col(c) for c in ("chapter", "concepts", "title", "text")]
    macro = X.clean_token(F.coalesce("macro_label", F.lit("")))
    micro = X.clean_token(F.coalesce("micro_label", F.lit("")))
    out = labelled.select(
        "problem_id",
        let(macro, lambda m: F.when(m == "", X.macro_fallback(*fields)).otherwise(m)).alias("_macro"),
        let(micro, lambda m: F.when(m == "", X.micro_fallback(*fields)).otherwise(m)).alias("_micro"),
        (macro == "").cast("int").alias("macro_fallback"),
        (micro == "").cast("int").alias("micro_fallback"),
    )
    out = out.withColumn("semantic_id", X.compose_label(F.col("_macro"), F.col("_micro")))
    return out.withColumn("collapsed", (F.col("semantic_id") == F.col("_macro")).cast("int")).drop("_macro", "_micro")


def generation_stats(ids: DataFrame) -> DataFrame:
    return ids.agg(
        F.count(F.lit(1)).alias("problem_count"), F.sum("macro_fallback").alias("macro_fallback_count"),
        F.sum("micro_fallback").alias("micro_fallback_count"), F.sum("collapsed").alias("duplicate_collapsed_count"),
    )


def enriched_catalog(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalog with semantic ids; a problem without one is an error."""
    found = catalog.join(ids.select("problem_id", "semantic_id"), "problem_id", "left")
    return found.withColumn("semantic_id", F.coalesce("semantic_id", F.raise_error(F.lit("problem without a semantic id")).cast("string")))
