"""Heuristic and scored retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import cooccur as C
from tracelake.operators import retrieve as R
from tracelake.operators import sequences as S
from tracelake.registry.base import CATALOG, INTER, query
from tracelake.session import materialise
from tracelake.sources import driver_tables as D


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


NEIGHBORS = """firsts AS (SELECT user_id, problem_id, min({'a': submit_time, 'b': log_id}) AS f FROM logs GROUP BY ALL),
prefix AS (SELECT user_id, problem_id FROM firsts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f) <= 1000000000),
support AS (SELECT problem_id, count(*) AS n FROM prefix GROUP BY ALL),
co AS (SELECT a.problem_id AS p, b.problem_id AS q, count(*) AS c FROM prefix a JOIN prefix b ON a.user_id = b.user_id AND a.problem_id <> b.problem_id GROUP BY ALL),
neighbors AS (SELECT p AS problem_id, q AS neighbor_id, c / (sp.n + sq.n - c) AS score,
  row_number() OVER (PARTITION BY p ORDER BY c / (sp.n + sq.n - c) DESC, q) AS rank
  FROM co JOIN support sp ON p = sp.problem_id JOIN support sq ON q = sq.problem_id QUALIFY rank <= 5)"""

_JACCARD = "len(list_intersect(hc.concepts, tc.concepts)) / len(list_distinct(list_concat(hc.concepts, tc.concepts)))"


def _heuristic_sql(targets: str, levels: bool = True, lists: bool = True) -> str:
    level = "CASE WHEN hc.level < tc.level THEN 5.0 WHEN hc.level = tc.level THEN 2.0 ELSE 0.0 END" if levels else "0.0"
    bonus = "CASE WHEN n.rank IS NULL THEN 0.0 WHEN base < 5.0 THEN 8.0 ELSE 2.0 END" if lists else "0.0"
    return f"""WITH {INTER}, {CATALOG}, {NEIGHBORS}, targets AS ({targets}),
s AS (SELECT t.user_id, t.pos, t.problem_id, h.pos AS h_pos, h.problem_id AS h_problem_id, h.is_correct AS h_is_correct,
  10.0 * {_JACCARD} + {level} AS base
  FROM targets t JOIN inter h ON t.user_id = h.user_id AND h.pos < t.pos AND h.problem_id <> t.problem_id
  JOIN catalog tc ON t.problem_id = tc.problem_id JOIN catalog hc ON h.problem_id = hc.problem_id),
f AS (SELECT s.*, (base + {bonus}) * exp(-0.05 * (pos - h_pos)) AS score
  FROM s LEFT JOIN neighbors n ON n.problem_id = s.problem_id AND n.neighbor_id = s.h_problem_id)
SELECT user_id, pos, problem_id, h_pos, h_problem_id, CAST(h_is_correct AS BIGINT) AS h_is_correct, round(score, 6) AS score,
  row_number() OVER (PARTITION BY user_id, pos ORDER BY score DESC, h_pos) AS rank FROM f WHERE score > 0 QUALIFY rank <= 4"""


def _shape(out):
    return out.select("user_id", *_long("pos", "rank", "h_pos", "h_is_correct"), "problem_id", "h_problem_id", F.round("score", 6).alias("score"))


def item_neighbors(spark, sf):
    return C.item_neighbors(D.logs(spark, sf), D.LOG_ORDER)


def stored_neighbors(spark, sf):
    """Neighbour lists as a written table: catalog-sized, computed once, read by every later join."""
    return materialise(item_neighbors(spark, sf))


def profiled(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct")
    return R.with_profile(rows, D.catalog(spark, sf), stored_neighbors(spark, sf))


@query("history_retrieval_topk", _heuristic_sql("SELECT * FROM inter"))
def history_retrieval_topk(spark, sf):
    return _shape(R.heuristic(profiled(spark, sf)))


@query("history_retrieval_deep", _heuristic_sql("SELECT * FROM inter"))
def history_retrieval_deep(spark, sf):
    """The same with small tiles, so that most targets search tiles within their reach."""
    return _shape(R.heuristic(profiled(spark, sf), tile=8))


_LAST = "SELECT * FROM inter QUALIFY pos = max(pos) OVER (PARTITION BY user_id)"


def last_targets(spark, sf):
    """Logs of known problems, the last of each user, and the profile of problems as a written table."""
    profile = materialise(R.problem_profile(D.catalog(spark, sf), item_neighbors(spark, sf)))
    logs = D.interactions(spark, sf, "problem_id", "is_correct").join(profile.select("problem_id"), "problem_id", "left_semi")
    targets = S.last_target(logs, ["problem_id"])
    return logs, targets.select("user_id", F.col("target_t").alias("pos"), F.col("target_problem_id").alias("problem_id")), profile


def _last(spark, sf, **flags):
    logs, targets, profile = last_targets(spark, sf)
    return _shape(R.heuristic_for_targets(logs, targets, profile=profile, **flags))


@query("last_target_retrieval", _heuristic_sql(_LAST))
def last_target_retrieval(spark, sf):
    return _last(spark, sf)


@query("last_target_without_levels", _heuristic_sql(_LAST, levels=False))
def last_target_without_levels(spark, sf):
    return _last(spark, sf, use_levels=False)


@query("last_target_without_neighbors", _heuristic_sql(_LAST, lists=False))
def last_target_without_neighbors(spark, sf):
    return _last(spark, sf, use_neighbors=False)
