"""Co-occurrence and concept graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import cooccur as C
from tracelake.operators import graph as G
from tracelake.operators import sequences as S
from tracelake.registry.base import CATALOG, INTER, LOGS, query
from tracelake.registry.retrieval_queries import NEIGHBORS, item_neighbors
from tracelake.sources import driver_tables as D


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Thresholds suited to the size of the part table.
STAT_MIN, SEQ_MIN, SEQ_SCALE, LOCAL = 20, 50, 10_000.0, 20

PAIRS = f"""{CATALOG}, cc AS (SELECT problem_id, level, chapter, unnest(concepts) AS concept FROM catalog),
cp AS (SELECT a.concept AS a, b.concept AS b, count(*) AS freq FROM cc a JOIN cc b ON a.problem_id = b.problem_id AND a.concept < b.concept GROUP BY ALL),
lv AS (SELECT concept, level FROM (SELECT concept, level, count(*) AS n FROM cc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, level) = 1),
st AS (SELECT p.*, x.level AS la, y.level AS lb, least(1.0, freq / 200.0) AS weight FROM cp p JOIN lv x ON a = x.concept JOIN lv y ON b = y.concept WHERE freq >= {STAT_MIN}),
stat AS (SELECT a AS src, b AS dst, 'pre' AS rel_type, weight FROM st WHERE la < lb UNION ALL SELECT b, a, 'pre', weight FROM st WHERE la > lb
  UNION ALL SELECT a, b, 'same', weight FROM st WHERE la = lb UNION ALL SELECT b, a, 'same', weight FROM st WHERE la = lb)"""
SEQ_PAIRS = """known AS (SELECT i.user_id, i.pos, c.concepts FROM inter i JOIN catalog c USING (problem_id)),
lp AS (SELECT h.concepts AS x, t.concepts AS y FROM known t JOIN known h ON t.user_id = h.user_id AND h.pos < t.pos AND h.pos >= t.pos - 10),
lx AS (SELECT unnest(x) AS x, y FROM lp), lxy AS (SELECT x, unnest(y) AS y FROM lx),
sp AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS freq FROM lxy WHERE x <> y GROUP BY ALL)"""
SEQ_EDGES = f"""sw AS (SELECT a, b, least(1.0, freq / {SEQ_SCALE}) AS weight FROM sp WHERE freq >= {SEQ_MIN}),
seq AS (SELECT a AS src, b AS dst, 'adj' AS rel_type, weight FROM sw UNION ALL SELECT b, a, 'adj', weight FROM sw)"""
NEAR = f"""ce AS (SELECT a AS concept, b AS neighbor, CAST(freq AS DOUBLE) AS score FROM cp WHERE freq >= {LOCAL} UNION ALL SELECT b, a, freq FROM cp WHERE freq >= {LOCAL}),
cn AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, neighbor) AS rank FROM ce QUALIFY rank <= 64),
pr AS (SELECT c.problem_id, n.neighbor AS concept, max(1.0 / n.rank) AS score FROM cc c JOIN cn n USING (concept) JOIN catalog k ON k.problem_id = c.problem_id
  WHERE NOT list_contains(k.concepts, n.neighbor) GROUP BY ALL),
pn AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, concept) AS rank FROM pr QUALIFY rank <= 128)"""


def stat_edges(spark, sf):
    cat = D.catalog(spark, sf)
    return G.stat_edges(C.concept_pairs(cat), G.level_mode(cat), STAT_MIN)


def known_rows(spark, sf):
    return D.interactions(spark, sf, "problem_id").select("user_id", "pos", "problem_id")


def seq_edges(spark, sf):
    pairs = C.windowed_concept_pairs(known_rows(spark, sf), D.catalog(spark, sf))
    return G.sequence_edges(pairs, SEQ_MIN, SEQ_SCALE)


def concept_neighbors(spark, sf):
    return G.neighbors(G.local_edges(C.concept_pairs(D.catalog(spark, sf)), LOCAL, fill=False))


def _edge_cols(out):
    return out.select("src", "dst", "rel_type", F.round("weight", 6).alias("weight"))


@query("item_support", f"WITH {LOGS}, {NEIGHBORS} SELECT problem_id, n AS users FROM support")
def item_support(spark, sf):
    return C.item_support(S.distinct_prefix(D.logs(spark, sf), D.LOG_ORDER))


@query("item_pairs", f"WITH {LOGS}, {NEIGHBORS} SELECT p AS a, q AS b, c AS inter FROM co WHERE p < q")
def item_pairs(spark, sf):
    return C.item_pairs(S.distinct_prefix(D.logs(spark, sf), D.LOG_ORDER))


@query("jaccard_item_neighbors", f"WITH {LOGS}, {NEIGHBORS} SELECT problem_id, rank, neighbor_id, round(score, 6) AS score FROM neighbors")
def jaccard_item_neighbors(spark, sf):
    return item_neighbors(spark, sf).select("problem_id", *_long("rank"), "neighbor_id", F.round("score", 6).alias("score"))


@query("jaccard_item_neighbors_capped", f"WITH {LOGS}, {NEIGHBORS.replace('<= 1000000000', '<= 20')} SELECT problem_id, rank, neighbor_id, round(score, 6) AS score FROM neighbors")
def jaccard_item_neighbors_capped(spark, sf):
    """The named variant that counts only the first distinct problems of a user."""
    out = C.item_neighbors(D.logs(spark, sf), D.LOG_ORDER, cap=20)
    return out.select("problem_id", *_long("rank"), "neighbor_id", F.round("score", 6).alias("score"))


@query(
    "neighbor_backfill",
    f"""WITH {LOGS}, {CATALOG}, {NEIGHBORS}, strong AS (SELECT problem_id, neighbor_id, rank FROM neighbors WHERE rank <= 2),
lab AS (SELECT problem_id, text AS semantic_id FROM catalog),
extra AS (SELECT a.problem_id, b.problem_id AS neighbor_id, row_number() OVER (PARTITION BY a.problem_id ORDER BY b.problem_id) AS place
  FROM lab a JOIN lab b ON a.semantic_id = b.semantic_id AND a.problem_id <> b.problem_id
  WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.problem_id = a.problem_id AND s.neighbor_id = b.problem_id)),
u AS (SELECT problem_id, neighbor_id, 'jaccard' AS origin, rank AS place FROM strong UNION ALL SELECT problem_id, neighbor_id, 'label', place FROM extra)
SELECT problem_id, neighbor_id, origin, row_number() OVER (PARTITION BY problem_id ORDER BY origin, place) AS rank FROM u QUALIFY rank <= 5""",
)
def neighbor_backfill(spark, sf):
    strong = C.item_neighbors(D.logs(spark, sf), D.LOG_ORDER, k=2)
    cat = D.catalog(spark, sf)
    labels = cat.select("problem_id", F.col("text").alias("semantic_id"))
    return C.fill_neighbors(strong, cat, labels).select("problem_id", "neighbor_id", "origin", *_long("rank"))


@query("concept_pairs", f"WITH {PAIRS} SELECT a, b, freq FROM cp")
def concept_pairs(spark, sf):
    return C.concept_pairs(D.catalog(spark, sf))


@query("concept_level_mode", f"WITH {PAIRS} SELECT concept, CAST(level AS BIGINT) AS level FROM lv")
def concept_level_mode(spark, sf):
    return G.level_mode(D.catalog(spark, sf)).select("concept", *_long("level"))


@query("concept_edges_stat", f"WITH {PAIRS} SELECT src, dst, rel_type, round(weight, 6) AS weight FROM stat")
def concept_edges_stat(spark, sf):
    return _edge_cols(stat_edges(spark, sf))


@query("windowed_concept_pairs", f"WITH {INTER}, {CATALOG}, {SEQ_PAIRS} SELECT a, b, freq FROM sp")
def windowed_concept_pairs(spark, sf):
    return C.windowed_concept_pairs(known_rows(spark, sf), D.catalog(spark, sf))


@query("concept_edges_seq", f"WITH {INTER}, {CATALOG}, {SEQ_PAIRS}, {SEQ_EDGES} SELECT src, dst, rel_type, round(weight, 6) AS weight FROM seq")
def concept_edges_seq(spark, sf):
    return _edge_cols(seq_edges(spark, sf))


_MERGED = f"""{INTER}, {PAIRS}, {SEQ_PAIRS}, {SEQ_EDGES},
merged AS (SELECT src, dst, rel_type, max(weight) AS weight FROM (SELECT * FROM stat UNION ALL SELECT * FROM seq) GROUP BY ALL)"""


def merged(spark, sf):
    return G.merge_edges(stat_edges(spark, sf), seq_edges(spark, sf))


@query("edge_merge", f"WITH {_MERGED} SELECT src, dst, rel_type, round(weight, 6) AS weight FROM merged")
def edge_merge(spark, sf):
    return _edge_cols(merged(spark, sf))


@query(
    "isolated_concepts",
    f"""WITH {PAIRS}, un AS (SELECT src AS u, dst AS v FROM stat UNION SELECT dst, src FROM stat),
d AS (SELECT u AS concept, count(DISTINCT v) AS degree FROM un GROUP BY ALL)
SELECT lv.concept, coalesce(degree, 0) AS degree FROM lv LEFT JOIN d USING (concept) WHERE coalesce(degree, 0) < 2""",
)
def isolated_concepts(spark, sf):
    return G.isolated(G.level_mode(D.catalog(spark, sf)), stat_edges(spark, sf))


@query(
    "suggested_edges",
    f"""WITH {PAIRS}, sug AS (SELECT a AS concept, b AS neighbor, CASE WHEN freq % 3 = 0 THEN 'adj' WHEN freq % 3 = 1 THEN 'pre' ELSE 'same' END AS rel,
  least(1.0, freq / 25.0) AS confidence FROM cp),
kept AS (SELECT * FROM sug WHERE confidence >= 0.7 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, neighbor) <= 3),
k AS (SELECT kept.*, x.level AS la, y.level AS lb FROM kept JOIN lv x ON kept.concept = x.concept JOIN lv y ON neighbor = y.concept),
new AS (SELECT concept AS src, neighbor AS dst, 'adj' AS rel_type, confidence AS weight FROM k WHERE rel = 'adj' UNION ALL SELECT neighbor, concept, 'adj', confidence FROM k WHERE rel = 'adj'
  UNION ALL SELECT concept, neighbor, 'same', confidence FROM k WHERE rel <> 'adj' AND la = lb UNION ALL SELECT neighbor, concept, 'same', confidence FROM k WHERE rel <> 'adj' AND la = lb
  UNION ALL SELECT CASE WHEN la < lb THEN concept ELSE neighbor END, CASE WHEN la < lb THEN neighbor ELSE concept END, 'pre', confidence FROM k WHERE rel <> 'adj' AND la <> lb)
SELECT src, dst, rel_type, round(max(weight), 6) AS weight FROM (SELECT * FROM stat UNION ALL SELECT * FROM new) GROUP BY ALL""",
)
def suggested_edges(spark, sf):
    pairs = C.concept_pairs(D.catalog(spark, sf))
    rel = F.when(F.col("freq") % 3 == 0, "adj").when(F.col("freq") % 3 == 1, "pre").otherwise("same")
    suggested = pairs.select(
        F.col("a").alias("concept"), F.col("b").alias("neighbor"), rel.alias("rel_type"), F.least(F.lit(1.0), F.col("freq") / 25.0).alias("confidence")
    )
    return _edge_cols(G.reconcile(stat_edges(spark, sf), suggested, G.level_mode(D.catalog(spark, sf))))


@query("concept_chapters", f"WITH {PAIRS} SELECT concept, count(DISTINCT chapter) AS chapters FROM cc GROUP BY ALL")
def concept_chapters(spark, sf):
    return G.chapter_counts(D.catalog(spark, sf))


@query(
    "suggestion_candidates",
    f"""WITH {PAIRS}, ch AS (SELECT DISTINCT concept, chapter FROM cc), sy AS (SELECT a AS concept, b AS other, freq FROM cp UNION ALL SELECT b, a, freq FROM cp),
top AS (SELECT concept, other FROM sy QUALIFY row_number() OVER (PARTITION BY concept ORDER BY freq DESC, other) <= 8),
c AS (SELECT x.concept, y.concept AS candidate FROM ch x JOIN ch y USING (chapter) UNION SELECT concept, other FROM top)
SELECT concept, candidate, row_number() OVER (PARTITION BY concept ORDER BY candidate) AS rank FROM c WHERE concept <> candidate QUALIFY rank <= 8""",
)
def suggestion_candidates(spark, sf):
    return G.suggestion_candidates(D.catalog(spark, sf)).select("concept", "candidate", *_long("rank"))


@query("graph_neighbors", f"WITH {PAIRS}, {NEAR} SELECT concept, rank, neighbor, score FROM cn")
def graph_neighbors(spark, sf):
    return concept_neighbors(spark, sf).select("concept", *_long("rank"), "neighbor", "score")


@query("problem_neighbor_concepts", f"WITH {PAIRS}, {NEAR} SELECT problem_id, rank, concept, round(score, 6) AS score FROM pn")
def problem_neighbor_concepts(spark, sf):
    out = G.problem_neighbors(D.catalog(spark, sf), concept_neighbors(spark, sf))
    return out.select("problem_id", *_long("rank"), "concept", F.round("score", 6).alias("score"))


@query("graph_top_up")
def graph_top_up(spark, sf):
    """Edges that lift sparse concepts to three neighbours (sequential definition, no SQL twin)."""
    return G.top_up(C.concept_pairs(D.catalog(spark, sf)), 40)


@query("graph_policy", f"WITH {CATALOG} SELECT count(*) AS problems, 3 AS local_threshold, 3 AS min_neighbors, 64 AS max_concept_neighbors, 128 AS max_problem_neighbors FROM catalog")
def graph_policy(spark, sf):
    return G.graph_policy(D.catalog(spark, sf)).drop("chapter_clique_edges")


HOPS = """om AS (SELECT src, dst, max(weight * CASE rel_type WHEN 'pre' THEN 1.0 WHEN 'same' THEN 0.8 ELSE 0.5 END) AS omega FROM stat GROUP BY ALL),
d1 AS (SELECT src, dst, omega, 1 AS dist FROM om WHERE src <> dst),
d2 AS (SELECT x.src, y.dst, max(y.omega) AS omega, 2 AS dist FROM d1 x JOIN om y ON x.dst = y.src WHERE x.src <> y.dst
  AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.src = x.src AND d1.dst = y.dst) GROUP BY x.src, y.dst),
d3 AS (SELECT x.src, y.dst, max(y.omega) AS omega, 3 AS dist FROM d2 x JOIN om y ON x.dst = y.src WHERE x.src <> y.dst
  AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.src = x.src AND d1.dst = y.dst) AND NOT EXISTS (SELECT 1 FROM d2 WHERE d2.src = x.src AND d2.dst = y.dst) GROUP BY x.src, y.dst),
phi AS (SELECT src, dst, dist, omega * exp(-(dist - 1)) AS phi FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3))"""


@query("graph_hops3", f"WITH {PAIRS}, {HOPS} SELECT src, dst, CAST(dist AS BIGINT) AS dist, round(phi, 6) AS phi FROM phi")
def graph_hops3(spark, sf):
    return G.hops(stat_edges(spark, sf)).select("src", "dst", *_long("dist"), F.round("phi", 6).alias("phi"))


REACH = """un AS (SELECT src AS u, dst AS v FROM stat UNION SELECT dst, src FROM stat),
r1 AS (SELECT concept AS seed, concept AS node FROM lv UNION SELECT u, v FROM un),
r2 AS (SELECT seed, node FROM r1 UNION SELECT seed, v FROM r1 JOIN un ON node = u),
r3 AS (SELECT seed, node FROM r2 UNION SELECT seed, v FROM r2 JOIN un ON node = u)"""


@query("graph_neighborhood", f"WITH {PAIRS}, {REACH} SELECT DISTINCT seed, node AS concept FROM r3")
def graph_neighborhood(spark, sf):
    levels = G.level_mode(D.catalog(spark, sf))
    seeds = levels.select(F.col("concept").alias("seed"), "concept")
    return G.neighborhood(stat_edges(spark, sf), seeds, "seed")
