"""Ordering, look-back, chunk and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import vectors as V
from tracelake.functions.keys import hash_bucket
from tracelake.operators import full_history as FH
from tracelake.operators import sequences as S
from tracelake.plans.frames import history_rows
from tracelake.registry.base import CATALOG, INTER, LOGS, PAIRS20, VECS, query
from tracelake.sources import driver_tables as D


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query(
    "dense_position",
    f"""WITH {LOGS}, {CATALOG}, kept AS (
  SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY submit_time, log_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM logs l WHERE problem_id IN (SELECT problem_id FROM catalog))
SELECT user_id, CAST(pos AS BIGINT) AS pos, log_id, problem_id, CAST(is_correct AS BIGINT) AS is_correct FROM kept WHERE n >= 2""",
)
def dense_position(spark, sf):
    out = S.dense_position(D.logs(spark, sf), D.catalog(spark, sf))
    return out.select("user_id", *_long("pos"), "log_id", "problem_id", *_long("is_correct"))


@query(
    "event_position",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS log_id, ts,
  json_extract_string(props, '$.k') AS problem_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS is_correct FROM events)
SELECT user_id, log_id, problem_id, CAST(is_correct AS BIGINT) AS is_correct,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) - 1 AS BIGINT) AS pos FROM e""",
)
def event_position(spark, sf):
    out = S.dense_position(D.event_logs(spark, sf), min_logs=1)
    return out.select("user_id", "log_id", "problem_id", *_long("is_correct", "pos"))


@query(
    "history_window20",
    f"""WITH {INTER}, {PAIRS20}
SELECT user_id, CAST(pos AS BIGINT) AS pos, problem_id, CAST(h_pos AS BIGINT) AS h_pos, h_problem_id,
       CAST(h_is_correct AS BIGINT) AS h_is_correct FROM pairs""",
)
def history_window20(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct")
    out = history_rows(rows, 20, ["pos", "problem_id", "is_correct"])
    return out.select("user_id", *_long("pos"), "problem_id", *_long("h_pos"), "h_problem_id", *_long("h_is_correct"))


@query(
    "recent_trajectory",
    f"""WITH {INTER}, t AS (SELECT t.user_id, t.pos, string_agg(h.problem_id || ':' || h.is_correct, ' ' ORDER BY h.pos) AS trajectory
  FROM inter t JOIN inter h ON t.user_id = h.user_id AND h.pos >= t.pos - 10 AND h.pos < t.pos GROUP BY ALL)
SELECT i.user_id, i.pos, coalesce(trajectory, '') AS trajectory FROM inter i LEFT JOIN t USING (user_id, pos)""",
)
def recent_trajectory(spark, sf):
    out = S.recent_trajectory(D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct"), "problem_id")
    text = F.array_join(F.transform("trajectory", lambda x: F.concat(x["problem_id"], F.lit(":"), x["is_correct"])), " ")
    return out.select("user_id", *_long("pos"), text.alias("trajectory"))


@query(
    "leave_last_out",
    f"""WITH {INTER} SELECT user_id, pos AS target_t, problem_id AS target_problem_id, CAST(is_correct AS BIGINT) AS target_is_correct
FROM inter QUALIFY pos = max(pos) OVER (PARTITION BY user_id)""",
)
def leave_last_out(spark, sf):
    out = S.last_target(D.interactions(spark, sf, "problem_id", "is_correct"), ["problem_id", "is_correct"])
    return out.select("user_id", *_long("target_t"), "target_problem_id", *_long("target_is_correct"))


def _chunk_sql(length: int, pad: str, min_size: int = 1) -> str:
    padded = f"|| repeat(',{pad}', {length} - n)" if pad else ""
    return f"""WITH {INTER}, g AS (
  SELECT user_id, pos // {length} AS chunk, count(*) AS n, string_agg(problem_id, ',' ORDER BY pos) AS q,
         string_agg(CAST(is_correct AS VARCHAR), ',' ORDER BY pos) AS a FROM inter GROUP BY ALL)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, n AS size, q {padded} AS q, a {padded} AS a FROM g WHERE n >= {min_size}"""


def _chunk_text(out):
    return out.select("user_id", *_long("chunk", "size"), F.concat_ws(",", F.col("q").cast("array<string>")).alias("q"), F.concat_ws(",", F.col("a").cast("array<string>")).alias("a"))


def _qa(spark, sf):
    return D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", F.col("problem_id").cast("int").alias("q"), F.col("is_correct").alias("a"))


@query("chunk_fixed", _chunk_sql(50, "0"))
def chunk_fixed(spark, sf):
    return _chunk_text(S.chunk(_qa(spark, sf), 50, {"q": 0, "a": 0}))


@query("chunk_plus_one", _chunk_sql(21, "-1"))
def chunk_plus_one(spark, sf):
    return _chunk_text(S.chunk_plus_one(_qa(spark, sf), 20, ["q", "a"]))


@query("chunk_steps", _chunk_sql(30, "", 2))
def chunk_steps(spark, sf):
    return _chunk_text(S.chunk_steps(_qa(spark, sf), ["q", "a"], 30))


@query(
    "shift_pairs",
    f"""WITH {INTER} SELECT t.user_id, t.pos, h.problem_id AS prev_problem_id, CAST(h.is_correct AS BIGINT) AS prev_is_correct,
  t.problem_id, CAST(t.is_correct AS BIGINT) AS is_correct FROM inter t JOIN inter h ON t.user_id = h.user_id AND t.pos = h.pos + 1""",
)
def shift_pairs(spark, sf):
    out = S.shift_rows(D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct"), ["problem_id", "is_correct"])
    return out.select("user_id", *_long("pos"), "prev_problem_id", *_long("prev_is_correct"), "problem_id", *_long("is_correct"))


@query(
    "shift_chunks",
    f"""WITH {INTER}, c AS (SELECT user_id, pos // 20 AS chunk, list(problem_id ORDER BY pos) AS q FROM inter GROUP BY ALL)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, array_to_string(q[1:len(q)-1], ',') AS q_in, array_to_string(q[2:], ',') AS q_out
FROM c WHERE len(q) >= 2""",
)
def shift_chunks(spark, sf):
    rows = D.interactions(spark, sf, "problem_id").select("user_id", "pos", F.col("problem_id").alias("q"))
    out = S.shift_arrays(S.chunk_steps(rows, ["q"], 20), ["q"])
    return out.select("user_id", *_long("chunk"), F.array_join("q_in", ",").alias("q_in"), F.array_join("q_out", ",").alias("q_out"))


@query(
    "pad_batches",
    f"""WITH {INTER}, c AS (SELECT user_id, pos // 20 AS chunk, list(CAST(problem_id AS BIGINT) ORDER BY pos) AS q,
  list(is_correct ORDER BY pos) AS r FROM inter GROUP BY ALL),
b AS (SELECT *, CAST(('0x' || substr(sha256(user_id || '-' || chunk), 1, 8)) AS BIGINT) % 64 AS batch FROM c),
m AS (SELECT *, max(len(q)) OVER (PARTITION BY batch) AS longest FROM b)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, batch, CAST(longest AS BIGINT) AS length, CAST(len(q) AS BIGINT) AS unmasked,
  array_to_string(q, ',') || repeat(',0', longest - len(q)) AS q, array_to_string(r, ',') || repeat(',0', longest - len(r)) AS r FROM m""",
)
def pad_batches(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", F.col("problem_id").cast("int").alias("q"), F.col("is_correct").alias("r"))
    samples = S.chunk(rows, 20, {"q": None, "r": None}).withColumn("batch", hash_bucket(F.concat_ws("-", "user_id", "chunk"), 64))
    out = S.pad_batches(samples, "batch", "q", "r")
    total = F.aggregate("mask", F.lit(0), lambda s, x: s + x)
    return out.select(
        "user_id", *_long("chunk", "batch"), F.size("mask").cast("bigint").alias("length"), total.cast("bigint").alias("unmasked"),
        F.concat_ws(",", F.col("q").cast("array<string>")).alias("q"), F.concat_ws(",", F.col("r").cast("array<string>")).alias("r"),
    )


@query(
    "onehot_sparse",
    f"""WITH {INTER}, n AS (SELECT max(p_partkey) + 1 AS n FROM part)
SELECT user_id, pos // 50 AS sample, pos % 50 AS step,
  CAST(problem_id AS BIGINT) + CASE WHEN is_correct = 1 THEN 0 ELSE n END AS index FROM inter, n""",
)
def onehot_sparse(spark, sf):
    n = D.table(spark, sf, "part").agg(F.max("p_partkey") + 1).scalar()
    rows = _qa(spark, sf).withColumnRenamed("a", "is_correct")
    out = S.onehot_sparse(rows, "q", n, 50)
    return out.select("user_id", *_long("sample", "step", "index"))


@query(
    "onehot_vector",
    f"""WITH {INTER}, {VECS}, n AS (SELECT max(p_partkey) + 1 AS n, (SELECT max(len(embedding)) FROM embeddings) AS dim FROM part),
lens AS (SELECT user_id, max(pos) AS last FROM inter GROUP BY ALL),
steps AS (SELECT user_id, unnest(range(CAST((last // 50 + 1) * 50 AS BIGINT))) AS pos FROM lens)
SELECT s.user_id, s.pos // 50 AS sample, s.pos % 50 AS step, CAST(2 * n + dim AS BIGINT) AS size,
  CAST(CASE WHEN i.pos IS NULL THEN 0 ELSE 1 + dim END AS BIGINT) AS cells,
  CAST(CASE WHEN i.is_correct = 1 THEN CAST(i.problem_id AS BIGINT) ELSE CAST(i.problem_id AS BIGINT) + n END AS BIGINT) AS hot,
  CASE WHEN i.pos IS NOT NULL THEN 2 * n + dim - 1 END AS last_index,
  CAST(CAST(v.raw_vec[1] AS FLOAT) AS DOUBLE) AS first_value, CAST(CAST(v.raw_vec[-1] AS FLOAT) AS DOUBLE) AS last_value
FROM steps s CROSS JOIN n LEFT JOIN inter i ON s.user_id = i.user_id AND s.pos = i.pos LEFT JOIN vecs v ON v.problem_id = i.problem_id""",
)
def onehot_vector(spark, sf):
    n = D.table(spark, sf, "part").agg(F.max("p_partkey") + 1).scalar()
    dim = D.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", F.col("problem_id").cast("int").alias("q"), "is_correct")
    rows = rows.join(D.item_vectors(spark, sf).select("problem_id", "vec"), "problem_id", "left")
    out = S.onehot_vector(rows, "q", n, 50, "vec", dim)
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return out.select(
        "user_id", *_long("sample", "step", "size"), F.size("indices").cast("bigint").alias("cells"), at("indices", 1).cast("bigint").alias("hot"),
        at("indices", -1).cast("bigint").alias("last_index"), at("values", 2).cast("double").alias("first_value"), at("values", -1).cast("double").alias("last_value"),
    )


@query(
    "interaction_code",
    f"""WITH {INTER}, n AS (SELECT count(*) AS n FROM part)
SELECT user_id, pos, CAST(problem_id AS BIGINT) + 1 + n * is_correct AS code, 2 * (CAST(problem_id AS BIGINT) + 1) + is_correct AS code_interleaved,
  CAST(is_correct AS BIGINT) AS decoded FROM inter, n""",
)
def interaction_code(spark, sf):
    n = D.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    q, a = F.col("q") + 1, F.col("a")
    out = _qa(spark, sf).withColumn("code", S.interaction_code(q, a, n)).withColumn("code_interleaved", S.interaction_code(q, a, n, "interleaved"))
    out = out.withColumn("decoded", S.decode_answer(F.col("code"), n)).filter(F.col("decoded") >= -0.9)
    return out.select("user_id", *_long("pos", "code", "code_interleaved", "decoded"))


@query(
    "distinct_prefix",
    f"""WITH {LOGS}, f AS (SELECT user_id, problem_id, min({{'a': submit_time, 'b': log_id}}) AS f FROM logs GROUP BY ALL)
SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rank FROM f QUALIFY rank <= 20""",
)
def distinct_prefix(spark, sf):
    out = S.distinct_prefix(D.logs(spark, sf), D.LOG_ORDER, 20)
    return out.select("user_id", "problem_id", *_long("rank"))


@query(
    "position_decay",
    f"""WITH {INTER}, {PAIRS20} SELECT user_id, pos, round(sum(exp(-0.05 * (pos - h_pos)) * h_is_correct), 6) AS decayed FROM pairs GROUP BY ALL""",
)
def position_decay(spark, sf):
    rows = history_rows(D.interactions(spark, sf, "is_correct").select("user_id", "pos", "is_correct"), 20, ["pos", "is_correct"])
    score = S.position_decay(F.col("h_is_correct").cast("double"), F.col("pos") - F.col("h_pos"))
    return rows.groupBy("user_id", "block", "pos").agg(F.round(F.sum(score), 6).alias("decayed")).select("user_id", *_long("pos"), "decayed")


_SIM20 = f"""{INTER}, {CATALOG}, {VECS}, {PAIRS20},
sims AS (SELECT p.*, tc.level, hc.level AS h_level, list_inner_product(tv.vec, hv.vec) AS cos, tv.vec AS t_vec, hv.vec AS h_vec
  FROM pairs p JOIN unit tv ON p.problem_id = tv.problem_id JOIN unit hv ON p.h_problem_id = hv.problem_id
  JOIN catalog tc ON p.problem_id = tc.problem_id JOIN catalog hc ON p.h_problem_id = hc.problem_id)"""


def featured(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct")
    return S.with_item_features(rows, D.item_vectors(spark, sf), D.catalog(spark, sf))


def levelled(spark, sf):
    """Logs with level and ``vec_id``, and the unit vectors that these name."""
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct")
    items = D.catalog(spark, sf).select("problem_id", "level").join(D.item_vector_ids(spark, sf), "problem_id")
    return rows.join(items, "problem_id"), S.unit_vectors(D.vectors(spark, sf))


@query(
    "attention_state",
    f"""WITH {_SIM20}, s AS (SELECT *, cos - abs(h_level - level) - ln(1 + pos - h_pos) AS s FROM sims),
e AS (SELECT *, exp(s - max(s) OVER w) AS e FROM s WINDOW w AS (PARTITION BY user_id, pos)),
a AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id, pos) AS alpha FROM e)
SELECT user_id, pos, round(sum(alpha * cos), 6) AS state_dot, round(sum(alpha * h_is_correct), 6) AS state_correct,
  round(sum(CASE WHEN h_level < level THEN alpha ELSE 0 END), 6) AS state_lower, round(sum(CASE WHEN h_level = level THEN alpha ELSE 0 END), 6) AS state_equal,
  round(sum(CASE WHEN h_level > level THEN alpha ELSE 0 END), 6) AS state_higher FROM a GROUP BY ALL""",
)
def attention_state(spark, sf):
    rows, vectors = levelled(spark, sf)
    out = S.attention_state(rows, vectors=vectors).filter(F.col("pos") > 0)
    # The vector part is linear in the weights, so its product with the target vector has a scalar twin.
    out = out.withColumn("state_dot", V.dot(F.col("state_vec"), F.col("vec")))
    return out.select("user_id", *_long("pos"), *[F.round(c, 6).alias(c) for c in ("state_dot", "state_correct", "state_lower", "state_equal", "state_higher")])


@query(
    "diagnostic_state",
    f"""WITH {_SIM20}, w AS (SELECT * FROM sims WHERE h_pos >= pos - 10),
a AS (SELECT *, exp(cos) / sum(exp(cos)) OVER (PARTITION BY user_id, pos) AS alpha FROM w),
d AS (SELECT user_id, pos, sum(alpha * (2 * h_is_correct - 1) * cos) AS e_dot FROM a GROUP BY ALL)
SELECT i.user_id, i.pos, round(coalesce(e_dot, 0), 6) AS e_dot,
  round(0.5 * is_correct + 0.5 / (1 + exp(-(2.0 * coalesce(e_dot, 0) + 0.1))), 6) AS mastery
FROM inter i LEFT JOIN d USING (user_id, pos)""",
)
def diagnostic_state(spark, sf):
    rows, vectors = levelled(spark, sf)
    out = S.diagnostic_state(rows, vectors=vectors).withColumn("e_dot", V.dot(F.col("e_diag"), F.col("vec")))
    mastery = S.mastery(F.col("is_correct"), V.sigmoid(2.0 * F.col("e_dot") + 0.1))
    return out.select("user_id", *_long("pos"), (F.round("e_dot", 6) + 0.0).alias("e_dot"), F.round(mastery, 6).alias("mastery"))


@query(
    "distance_time",
    f"""WITH {_SIM20}, d AS (SELECT *, 1 + coalesce(sum(1 - greatest(-1, least(1, cos))) OVER (PARTITION BY user_id, pos ORDER BY h_pos DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dtc FROM sims)
SELECT user_id, pos, h_pos, round(dtc, 6) AS dtc, round(exp(-0.2 * dtc), 6) AS t_decay FROM d""",
)
def distance_time(spark, sf):
    rows, vectors = levelled(spark, sf)
    pairs = S.distance_time(S.similarity_band(rows, 20, ["pos"], vectors))
    return pairs.select("user_id", *_long("pos", "h_pos"), F.round("dtc", 6).alias("dtc"), F.round("t_decay", 6).alias("t_decay"))


@query(
    "softmax_distance_time",
    f"""WITH {INTER}, {VECS}, p AS (SELECT t.user_id, t.pos, h.pos AS h_pos, list_inner_product(tv.vec, hv.vec) AS cos
  FROM inter t JOIN inter h ON t.user_id = h.user_id AND h.pos < t.pos JOIN unit tv ON t.problem_id = tv.problem_id JOIN unit hv ON h.problem_id = hv.problem_id),
g AS (SELECT *, exp(cos) / sum(exp(cos)) OVER (PARTITION BY user_id, pos) AS gamma FROM p),
d AS (SELECT *, (pos - h_pos) * coalesce(sum(gamma) OVER (PARTITION BY user_id, pos ORDER BY h_pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM g)
SELECT user_id, pos, round(sum(d), 6) AS d_sum, round(sum(exp(-0.05 * d)), 6) AS decay_sum, count(*) AS n FROM d GROUP BY ALL""",
)
def softmax_distance_time(spark, sf):
    rows, vectors = levelled(spark, sf)
    out = FH.distance_sums(rows, S.TIME_DECAY, vectors=vectors)
    return out.select("user_id", *_long("pos"), F.round("d_sum", 6).alias("d_sum"), F.round("decay_sum", 6).alias("decay_sum"), "n")


@query(
    "cold_start_history",
    f"""WITH {INTER}, {CATALOG}, r AS (SELECT i.*, list_contains(concepts, 'red') AS is_new FROM inter i JOIN catalog USING (problem_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS k FROM r WHERE NOT is_new),
t AS (SELECT r.user_id, r.pos, r.problem_id, (SELECT count(*) FROM o WHERE o.user_id = r.user_id AND o.pos < r.pos) AS before FROM r WHERE is_new)
SELECT t.user_id, t.pos, t.problem_id, coalesce(string_agg(o.problem_id, ',' ORDER BY o.pos), '') AS history
FROM t LEFT JOIN o ON t.user_id = o.user_id AND o.k < before AND o.k >= before - 10 GROUP BY ALL""",
)
def cold_start_history(spark, sf):
    rows = D.interactions(spark, sf, "problem_id").select("user_id", "pos", "problem_id").join(
        D.catalog(spark, sf).select("problem_id", F.array_contains("concepts", "red").alias("is_new")), "problem_id"
    )
    out = S.old_history_for_new(rows, "is_new", 10, ["problem_id"])
    return out.select("user_id", *_long("pos"), "problem_id", F.array_join(F.col("history.problem_id"), ",").alias("history"))


@query(
    "lead_in_zero",
    f"""WITH {INTER} SELECT user_id, pos, CASE WHEN pos = 0 THEN 0.0 ELSE round(ln(1 + pos), 6) END AS context FROM inter""",
)
def lead_in_zero(spark, sf):
    out = D.interactions(spark, sf, "user_id")
    return out.select("user_id", *_long("pos"), S.zero_lead_in(F.round(F.log1p("pos"), 6), F.lit(0.0), F.col("pos")).alias("context"))
