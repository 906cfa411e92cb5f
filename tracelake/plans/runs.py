"""End-to-end runs: priors of a catalog, then contexts of every answer, as Parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import clusters, cooccur, diagnostic, directions, evidence, fit, graph, metrics, sequences, text_vectors, validate
from tracelake.sources.writers import manifest, write_manifest

ORDER = ("submit_time", "submit_time_raw", "log_id")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_priors(
    catalog: DataFrame,
    logs: DataFrame,
    out: str,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    suggestions: DataFrame | None = None,
    order: Sequence[str] = ORDER,
    k1: int = clusters.MACRO_K,
    k2: int = clusters.MICRO_K,
    restarts: int = clusters.RESTARTS,
) -> dict[str, DataFrame]:
    """Vectors, labels, difficulty, neighbours and graph of a catalog, each written below ``out``."""
    texts = catalog.select(
        "problem_id", clusters.X.cluster_text(F.col("problem_id"), F.col("text"), F.col("title"), F.col("concepts")).alias("ctext")
    )
    base = _stored(text_vectors.encode_distinct(texts, "ctext", encoder).select("problem_id", "vec"), f"{out}/base_vectors")
    groups = _stored(clusters.two_level_clusters(base, k1, k2, restarts), f"{out}/clusters")
    labels = _stored(clusters.semantic_ids(catalog, groups), f"{out}/semantic_ids")
    difficulty = _stored(fit.rasch(logs, catalog), f"{out}/difficulty")
    toward = directions.problem_directions(catalog, directions.principal_directions(catalog, base))
    vectors = _stored(directions.inject(base, difficulty, toward), f"{out}/vectors")
    known = sequences.known_only(logs, catalog)
    near = cooccur.fill_neighbors(cooccur.item_neighbors(known, list(order)), catalog, labels)
    neighbors = _stored(near, f"{out}/neighbors")
    pairs = cooccur.concept_pairs(catalog)
    edges = _stored(graph.local_edges(pairs, suggestions=suggestions), f"{out}/graph_edges")
    concept_neighbors = _stored(graph.neighbors(edges), f"{out}/concept_neighbors")
    pre = edges.filter(F.col("source") == "suggested_prerequisite").select("src", "dst", F.lit("pre").alias("rel_type"))
    profile = _stored(evidence.problem_profile(catalog, vectors, neighbors, pre, concept_neighbors), f"{out}/profile")
    return {"labels": labels, "difficulty": difficulty, "vectors": vectors, "neighbors": neighbors, "edges": edges, "profile": profile}


def build_contexts(spark: SparkSession, catalog: DataFrame, logs: DataFrame, priors: dict[str, DataFrame], out: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Contexts of every answer after a user's first one, with a manifest and a validation report."""
    rows = sequences.dense_position(logs, catalog, list(order)).withColumn("is_correct", F.coalesce("is_correct", F.lit(0)))
    rows = _stored(rows.select("user_id", "pos", "problem_id", "is_correct"), f"{out}/interactions")
    profiled = rows.join(priors["profile"], "problem_id")
    states = _stored(sequences.diagnostic_state(profiled.select("user_id", "pos", "problem_id", "is_correct", "vec")), f"{out}/states")
    weights, intercept = diagnostic.fit_diagnostic(states)
    s_dyn = diagnostic.with_probability(states, weights, intercept, "s_dyn").select("user_id", "pos", "s_dyn")
    stated = profiled.join(states.select("user_id", "pos", "e_diag"), ["user_id", "pos"])
    chosen = evidence.select(stated, diagnosis=(tuple(weights), intercept)).join(s_dyn, ["user_id", "pos"])
    summed = _stored(evidence.summary_fields(chosen, F.col("s_dyn")), f"{out}/selected")
    contexts = _stored(evidence.context_records(summed, evidence.evidence_records(summed, catalog, priors["labels"])), f"{out}/contexts")
    report = validate.report(
        validate.context_rules(contexts), validate.difficulty_rules(priors["difficulty"], catalog), validate.label_rules(metrics.label_audit(priors["labels"]))
    )
    _stored(report, f"{out}/validation")
    counts = contexts.agg(F.count(F.lit(1)).alias("contexts"), F.countDistinct("user_id").alias("users"))
    write_manifest(manifest(counts, history_window=evidence.HISTORY_WINDOW, second_weight=evidence.SECOND_WEIGHT), f"{out}/manifest")
    return contexts


