"""Concept graph: edges, neighbour lists, bounded search and graph bonuses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.cooccur import concept_pairs
from tracelake.session import materialise

# Fixed values of the concept graph.
MIN_COOCCURRENCE = 50
WEIGHT_SCALE = 200.0
LOCAL_THRESHOLD = 3
MIN_NEIGHBORS = 3
MAX_CONCEPT_NEIGHBORS = 64
MAX_PROBLEM_NEIGHBORS = 128
CANDIDATE_LIMIT = 8
MAX_PREREQUISITES = 2
MAX_RELATED = 3
PREREQUISITE_SCORE = 1_000_000.0
RELATED_SCORE = 500_000.0
MIN_CONFIDENCE = 0.7
MAX_SUGGESTED = 3
RELATION_WEIGHTS = {"pre": 1.0, "same": 0.8, "adj": 0.5}
MAX_HOPS = 3
HOP_DECAY = 1.0
PREREQUISITE_BONUS = 0.75 * math.exp(-0.8)
NEIGHBOR_BONUS = 0.5 * math.exp(-0.8)


def concept_rows(catalog: DataFrame, *cols: str) -> DataFrame:
    return catalog.select("problem_id", *cols, F.explode(F.array_distinct("concepts")).alias("concept"))


def level_mode(catalog: DataFrame) -> DataFrame:
    """Most common level of each concept, the smallest on ties."""
    exploded = catalog.select("level", F.explode("concepts").alias("concept"))
    return exploded.groupBy("concept").agg(F.mode("level", deterministic=True).alias("level"))


def _edge(src: Column, dst: Column, rel: str) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"))


def _typed(pairs: DataFrame, levels: DataFrame, source: str) -> DataFrame:
    """Edges of pairs (a, b, weight): lower level points to higher, equal levels point both ways."""
    la = levels.select(F.col("concept").alias("a"), F.col("level").alias("_la"))
    lb = levels.select(F.col("concept").alias("b"), F.col("level").alias("_lb"))
    a, b = F.col("a"), F.col("b")
    x, y = F.coalesce(F.col("_la"), F.lit(0)), F.coalesce(F.col("_lb"), F.lit(0))
    edges = (
        F.when(x < y, F.array(_edge(a, b, "pre")))
        .when(x > y, F.array(_edge(b, a, "pre")))
        .otherwise(F.array(_edge(a, b, "same"), _edge(b, a, "same")))
    )
    return (
        pairs.join(la, "a", "left")
        .join(lb, "b", "left")
        .select("weight", F.explode(edges).alias("_e"))
        .select("_e.*", "weight", F.lit(source).alias("source"))
    )


def _weighted(pairs: DataFrame, min_count: int, scale: float) -> DataFrame:
    return pairs.filter(F.col("freq") >= min_count).withColumn("weight", F.least(F.lit(1.0), F.col("freq") / F.lit(float(scale))))


def stat_edges(pairs: DataFrame, levels: DataFrame, min_count: int = MIN_COOCCURRENCE, scale: float = WEIGHT_SCALE) -> DataFrame:
    """Edges from concepts that share problems."""
    return _typed(_weighted(pairs, min_count, scale), levels, "stat")


def sequence_edges(pairs: DataFrame, min_count: int = MIN_COOCCURRENCE, scale: float = WEIGHT_SCALE) -> DataFrame:
    """Two-way ``adj`` edges from concepts practised close to each other."""
    both = F.array(_edge(F.col("a"), F.col("b"), "adj"), _edge(F.col("b"), F.col("a"), "adj"))
    return (
        _weighted(pairs, min_count, scale)
        .select("weight", F.explode(both).alias("_e"))
        .select("_e.*", "weight", F.lit("stat_seq").alias("source"))
    )


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Union; the same (src, dst, rel_type) keeps its largest weight, the earliest input on ties."""
    union = None
    for k, e in enumerate(edges):
        part = e.select("src", "dst", "rel_type", "weight", "source", F.lit(-k).alias("_turn"))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("src", "dst", "rel_type").agg(F.max(F.struct("weight", "_turn", "source")).alias("_b"))
    return best.select("src", "dst", "rel_type", "_b.weight", "_b.source")


def undirected(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(F.explode(both).alias("_e")).select("_e.*").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("u").alias("concept")).agg(F.count(F.lit(1)).alias("degree"))


def isolated(levels: DataFrame, edges: DataFrame, min_degree: int = 2) -> DataFrame:
    """Concepts with fewer than ``min_degree`` distinct neighbours."""
    return (
        levels.select("concept")
        .join(degrees(edges), "concept", "left")
        .select("concept", F.coalesce("degree", F.lit(0)).alias("degree"))
        .filter(F.col("degree") < min_degree)
    )


def reconcile(edges: DataFrame, suggested: DataFrame, levels: DataFrame, min_confidence: float = MIN_CONFIDENCE, top: int = MAX_SUGGESTED) -> DataFrame:
    """Merge suggested edges (concept, neighbor, rel_type, confidence) into a graph.

    Per concept the best suggestion of each neighbour counts, then the three
    most confident neighbours.  ``pre`` and ``same`` follow the level rule.
    """
    known = suggested.filter(F.col("confidence") >= min_confidence).join(
        levels.select(F.col("concept").alias("neighbor")), "neighbor", "left_semi"
    )
    best = known.groupBy("concept", "neighbor").agg(F.max(F.struct("confidence", "rel_type")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("_b.confidence"), "neighbor"))
    kept = best.withColumn("_rank", rank).filter(F.col("_rank") <= top).select(
        F.col("concept").alias("a"), F.col("neighbor").alias("b"), F.col("_b.confidence").alias("weight"), F.col("_b.rel_type").alias("rel")
    )
    by_level = _typed(kept.filter(F.col("rel") != "adj").drop("rel"), levels, "suggested")
    adj = kept.filter(F.col("rel") == "adj").withColumn("freq", F.col("weight"))
    by_adj = sequence_edges(adj.drop("weight"), 0, 1.0).withColumn("source", F.lit("suggested"))
    return merge_edges(edges, by_level, by_adj)


# -- statistics and candidates -----------------------------------------------


def concept_chapters(catalog: DataFrame) -> DataFrame:
    """Distinct (concept, chapter) pairs with a chapter."""
    return concept_rows(catalog, "chapter").filter(F.col("chapter") != "").select("concept", "chapter").distinct()


def chapter_counts(catalog: DataFrame) -> DataFrame:
    return concept_chapters(catalog).groupBy("concept").agg(F.count(F.lit(1)).alias("chapters"))


def _symmetric(pairs: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("concept"), F.col("b").alias("neighbor")), F.struct(F.col("b").alias("concept"), F.col("a").alias("neighbor")))
    return pairs.select("freq", F.explode(both).alias("_e")).select("_e.*", F.col("freq").cast("double").alias("score"))


def suggestion_candidates(catalog: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Up to ``limit`` candidate concepts: same chapter or among the most co-occurring, by name.

    Only the first names are kept, so each chapter contributes its ``limit + 1``
    first concepts instead of all its pairs.
    """
    chapters = concept_chapters(catalog)
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("concept"))
    heads = chapters.withColumn("_place", place).filter(F.col("_place") <= limit + 1).drop("_place")
    mates = chapters.join(heads.withColumnRenamed("concept", "candidate"), "chapter").select("concept", "candidate")
    top = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "neighbor"))
    frequent = (
        _symmetric(concept_pairs(catalog)).withColumn("_top", top).filter(F.col("_top") <= limit)
        .join(chapters.select("concept").distinct(), "concept", "left_semi")
        .select("concept", F.col("neighbor").alias("candidate"))
    )
    union = mates.unionByName(frequent).filter(F.col("concept") != F.col("candidate")).distinct()
    rank = F.row_number().over(Window.partitionBy("concept").orderBy("candidate"))
    return union.withColumn("rank", rank).filter(F.col("rank") <= limit)


def clean_suggestions(candidates: DataFrame, suggestions: DataFrame, max_pre: int = MAX_PREREQUISITES, max_related: int = MAX_RELATED) -> DataFrame:
    """Suggestions (concept, prerequisite_candidates, related_candidates, confidence) limited to offered candidates."""
    offered = candidates.groupBy("concept").agg(F.collect_set("candidate").alias("_offered"))

    def kept(c: str, limit: int) -> Column:
        return F.slice(F.filter(c, lambda x: F.array_contains("_offered", x)), 1, limit).alias(c)

    return suggestions.join(offered, "concept").select(
        "concept", kept("prerequisite_candidates", max_pre), kept("related_candidates", max_related), F.coalesce("confidence", F.lit("低")).alias("confidence")
    )


# -- neighbour lists ---------------------------------------------------------


def top_up(pairs: DataFrame, threshold: int = LOCAL_THRESHOLD, min_neighbors: int = MIN_NEIGHBORS) -> DataFrame:
    """Edges (src, dst, count) that lift sparse concepts to ``min_neighbors`` neighbours.

    The definition is sequential: concepts in name order, each taking its most
    frequent missing neighbours, an edge counting for both ends.  A concept
    only depends on smaller names that may pick it, so all concepts whose
    smaller pickers are settled are solved together, round by round.  A pick is
    always among the first ``2 * min_neighbors - 1`` candidates, which bounds
    the working table per concept.
    """
    spark = pairs.sparkSession
    candidates = _symmetric(pairs)
    strong = candidates.filter(F.col("score") >= threshold)
    base = (
        candidates.groupBy("concept")
        .agg(F.sum((F.col("score") >= threshold).cast("int")).alias("have"))
        .filter(F.col("have") < min_neighbors)
    )
    sparse = materialise(base)
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "neighbor"))
    options = materialise(
        candidates.join(sparse.select("concept"), "concept", "left_semi")
        .join(strong.select("concept", "neighbor"), ["concept", "neighbor"], "left_anti")
        .withColumn("place", place)
        .filter(F.col("place") <= 2 * min_neighbors - 1)
    )
    picked = spark.createDataFrame([], "src string, dst string, count double")
    open_ = sparse
    while not open_.isEmpty():
        gained = picked.join(open_.select(F.col("concept").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("concept")).agg(
            F.collect_set("src").alias("_by")
        )
        state = open_.join(gained, "concept", "left").withColumn("_by", F.coalesce("_by", F.array().cast("array<string>")))
        state = state.withColumn("need", F.lit(min_neighbors) - F.col("have") - F.size("_by"))
        full = state.filter(F.col("need") <= 0).select("concept")
        needy = state.filter(F.col("need") > 0)
        waiting = (
            options.join(needy.select("concept"), "concept", "left_semi")
            .filter(F.col("concept") < F.col("neighbor"))
            .select(F.col("neighbor").alias("concept"))
            .distinct()
        )
        ready = needy.join(waiting, "concept", "left_anti")
        order = F.row_number().over(Window.partitionBy("concept").orderBy("place"))
        new = (
            options.join(ready.select("concept", "need", "_by"), "concept")
            .filter(~F.array_contains("_by", F.col("neighbor")))
            .withColumn("_k", order)
            .filter(F.col("_k") <= F.col("need"))
            .select(F.col("concept").alias("src"), F.col("neighbor").alias("dst"), F.col("score").alias("count"))
        )
        settled = full.unionByName(ready.select("concept"))
        picked, open_ = materialise(picked.unionByName(new)), materialise(open_.join(settled, "concept", "left_anti"))
    return picked


def local_edges(pairs: DataFrame, threshold: int = LOCAL_THRESHOLD, suggestions: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """All undirected evidence (src, dst, source, score) of the graph."""
    out = pairs.filter(F.col("freq") >= threshold).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("cofreq").alias("source"), F.col("freq").cast("double").alias("score")
    )
    if fill:
        extra = top_up(pairs, threshold)
        out = out.unionByName(extra.select("src", "dst", F.lit("cofreq_topk").alias("source"), F.col("count").alias("score")))
    if suggestions is not None:
        pre = suggestions.select(
            F.explode("prerequisite_candidates").alias("src"), F.col("concept").alias("dst"),
            F.lit("suggested_prerequisite").alias("source"), F.lit(PREREQUISITE_SCORE).alias("score"),
        )
        related = suggestions.select(
            F.col("concept").alias("src"), F.explode("related_candidates").alias("dst"),
            F.lit("suggested_related").alias("source"), F.lit(RELATED_SCORE).alias("score"),
        )
        out = out.unionByName(pre).unionByName(related)
    return out


def neighbors(edges: DataFrame, limit: int = MAX_CONCEPT_NEIGHBORS) -> DataFrame:
    """(concept, rank, neighbor, score), best score first, names breaking ties."""
    both = F.array(F.struct(F.col("src").alias("concept"), F.col("dst").alias("neighbor")), F.struct(F.col("dst").alias("concept"), F.col("src").alias("neighbor")))
    scored = edges.select("score", F.explode(both).alias("_e")).groupBy("_e.concept", "_e.neighbor").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("score"), "neighbor"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def problem_neighbors(catalog: DataFrame, concept_neighbors: DataFrame, limit: int = MAX_PROBLEM_NEIGHBORS) -> DataFrame:
    """(problem_id, rank, concept, score): neighbour concepts a problem does not carry itself."""
    own = catalog.select("problem_id", "concepts", F.explode(F.array_distinct("concepts")).alias("concept"))
    reach = own.join(concept_neighbors, "concept").filter(~F.array_contains("concepts", F.col("neighbor")))
    scored = reach.groupBy("problem_id", F.col("neighbor").alias("concept")).agg(F.max(1.0 / F.col("rank")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("score"), "concept"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def graph_policy(catalog: DataFrame) -> DataFrame:
    """One row of settings beside the graph tables."""
    return catalog.agg(F.count(F.lit(1)).alias("problems")).select(
        "problems", F.lit(LOCAL_THRESHOLD).alias("local_threshold"), F.lit(MIN_NEIGHBORS).alias("min_neighbors"),
        F.lit(MAX_CONCEPT_NEIGHBORS).alias("max_concept_neighbors"), F.lit(MAX_PROBLEM_NEIGHBORS).alias("max_problem_neighbors"),
        F.lit(False).alias("chapter_clique_edges"),
    )


# -- bonuses and bounded search ----------------------------------------------


def bonus_sources(catalog: DataFrame, edges: DataFrame, concept_neighbors: DataFrame) -> DataFrame:
    """Per problem, the concepts that earn a history item the structural bonus.

    ``pre_sources`` are prerequisites of the problem's concepts and
    ``near_sources`` concepts that list one of them as neighbour, so the bonus
    of a pair is an overlap test against the target's arrays.
    """
    own = concept_rows(catalog)
    pre = edges.filter(F.col("rel_type") == "pre").select(F.col("dst").alias("concept"), "src")
    pre = own.join(pre, "concept").groupBy("problem_id").agg(F.collect_set("src").alias("pre_sources"))
    near = own.join(concept_neighbors.select(F.col("neighbor").alias("concept"), F.col("concept").alias("src")), "concept")
    near = near.groupBy("problem_id").agg(F.collect_set("src").alias("near_sources"))
    empty = F.array().cast("array<string>")
    return catalog.select("problem_id").join(pre, "problem_id", "left").join(near, "problem_id", "left").select(
        "problem_id", F.coalesce("pre_sources", empty).alias("pre_sources"), F.coalesce("near_sources", empty).alias("near_sources")
    )


def structural_bonus(history_concepts: Column, pre_sources: Column, near_sources: Column) -> Column:
    return (
        F.when(F.arrays_overlap(history_concepts, pre_sources), PREREQUISITE_BONUS)
        .when(F.arrays_overlap(history_concepts, near_sources), NEIGHBOR_BONUS)
        .otherwise(0.0)
    )


def hops(edges: DataFrame, max_hops: int = MAX_HOPS, decay: float = HOP_DECAY) -> DataFrame:
    """(src, dst, dist, phi) for every pair within ``max_hops`` directed steps.

    ``phi`` is the best last-step weight among shortest paths, discounted per
    extra step.  Each level joins the frontier to the edges and drops pairs
    already reached.
    """
    weight = F.coalesce(*[F.when(F.col("rel_type") == r, w) for r, w in RELATION_WEIGHTS.items()], F.lit(0.0))
    step = (
        edges.filter((F.col("src") != "") & (F.col("dst") != ""))
        .withColumn("omega", weight * F.col("weight"))
        .filter(F.col("omega") > 0)
        .groupBy("src", "dst")
        .agg(F.max("omega").alias("omega"))
    )
    level = step.filter(F.col("src") != F.col("dst")).withColumn("dist", F.lit(1))
    reached = level
    for dist in range(2, max_hops + 1):
        grown = (
            level.select("src", F.col("dst").alias("_mid"))
            .join(step.select(F.col("src").alias("_mid"), "dst", "omega"), "_mid")
            .filter(F.col("src") != F.col("dst"))
            .groupBy("src", "dst")
            .agg(F.max("omega").alias("omega"))
        )
        level = grown.join(reached.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(dist))
        reached = reached.unionByName(level)
    return reached.select("src", "dst", "dist", (F.col("omega") * F.exp(-decay * (F.col("dist") - 1))).alias("phi"))


def neighborhood(edges: DataFrame, seeds: DataFrame, key: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """Distinct (key, concept) within ``max_hops`` undirected steps of the key's seeds, seeds included."""
    step = undirected(edges)
    reached = seeds.select(key, "concept").distinct()
    frontier = reached
    for _ in range(max_hops):
        grown = frontier.join(step, F.col("concept") == F.col("u")).select(key, F.col("v").alias("concept")).distinct()
        frontier = grown.join(reached, [key, "concept"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached
