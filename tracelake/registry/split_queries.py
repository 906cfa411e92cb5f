"""Split, sample, metric, report and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import vectors as V
from tracelake.operators import metrics as M
from tracelake.operators import retrieve as R
from tracelake.operators import sequences as S
from tracelake.operators import split as P
from tracelake.operators import validate as K
from tracelake.registry.base import CATALOG, INTER, LOGS, VECS, query
from tracelake.registry.evidence_queries import SELECTED, contexts
from tracelake.registry.retrieval_queries import _LAST, _heuristic_sql, last_targets
from tracelake.sources import driver_tables as D


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _rounded(df, skip=()):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _split_sql(keys: str, cuts: str, source: str = "logs", hashed: str | None = None) -> str:
    parts = hashed or keys
    return f"""WITH {LOGS}, k AS (SELECT DISTINCT {keys} FROM {source}),
r AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(chr(9), '42', {parts})), {keys}) - 1 AS rank, count(*) OVER () AS n FROM k)
SELECT {keys}, {cuts} AS role FROM r"""


@query("user_split", _split_sql("user_id", "CASE WHEN rank < floor(n * 0.8) THEN 'train' ELSE 'test' END"))
def user_split(spark, sf):
    return P.by_user(D.logs(spark, sf))


@query("sequence_split", _split_sql("user_id", "CASE WHEN rank < round_even(n * 0.8, 0) THEN 'train' WHEN rank < round_even(n * 0.8, 0) + floor((n - round_even(n * 0.8, 0)) / 2) THEN 'dev' ELSE 'test' END"))
def sequence_split(spark, sf):
    return P.by_sequence(D.logs(spark, sf))


@query("student_split", _split_sql("user_id", "CASE WHEN rank < floor(n * 0.8) THEN 'train' WHEN rank < floor(n * 0.9) THEN 'valid' ELSE 'test' END"))
def student_split(spark, sf):
    return P.by_user_three_way(D.logs(spark, sf))


@query("row_split", _split_sql("user_id, log_id", "CASE WHEN rank < floor(n * 0.8) THEN 'train' WHEN rank < floor(n * 0.9) THEN 'valid' ELSE 'test' END"))
def row_split(spark, sf):
    return P.by_row(D.logs(spark, sf), ["user_id", "log_id"])


_BUCKET = "CAST(('0x' || substr(sha256(user_id), 1, 8)) AS BIGINT) % 10"


@query("hash_bucket_split", f"WITH {INTER} SELECT user_id, pos, CASE WHEN {_BUCKET} = 0 THEN 'valid' ELSE 'train' END AS role FROM inter WHERE pos >= 1")
def hash_bucket_split(spark, sf):
    return P.by_hash_bucket(D.interactions(spark, sf, "user_id")).select("user_id", *_long("pos"), "role")


_CONCEPT_SPLIT = f"""{INTER}, {CATALOG}, con AS (SELECT DISTINCT unnest(concepts) AS concept FROM catalog),
cr AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(chr(9), '42', concept))) - 1 AS rank, count(*) OVER () AS n FROM con),
held AS (SELECT concept FROM cr WHERE rank < greatest(1, floor(n * 0.2))),
fl AS (SELECT i.*, list_has_any(c.concepts, (SELECT list(concept) FROM held)) AS is_new FROM inter i JOIN catalog c USING (problem_id)),
cs AS (SELECT *, coalesce(sum(CASE WHEN is_new THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old_before,
  sum(CASE WHEN is_new THEN 0 ELSE 1 END) OVER (PARTITION BY user_id) AS kept FROM fl),
split AS (SELECT *, CASE WHEN is_new AND old_before > 0 THEN 'test' WHEN is_new THEN 'skipped' WHEN kept >= 2 THEN 'train' ELSE 'dropped' END AS role FROM cs)"""


def concept_split(spark, sf):
    catalog = D.catalog(spark, sf)
    rows = D.interactions(spark, sf, "problem_id").select("user_id", "pos", "problem_id")
    return P.by_concept(rows, catalog, P.held_out_concepts(catalog))


@query("new_concept_split", f"WITH {_CONCEPT_SPLIT} SELECT user_id, pos, CAST(old_before AS BIGINT) AS old_before, role FROM split")
def new_concept_split(spark, sf):
    return concept_split(spark, sf).select("user_id", *_long("pos", "old_before"), "role")


_STATS = ", ".join(f"count(*) FILTER (role = '{r}') AS {n}" for r, n in (("train", "train_rows"), ("test", "test_targets"), ("skipped", "skipped_targets")))
_STATS += ", " + ", ".join(f"count(DISTINCT {c}) FILTER (role = '{r}') AS {r}_{n}" for r in ("train", "test") for c, n in (("problem_id", "problems"), ("user_id", "users")))


@query("split_stats", f"WITH {_CONCEPT_SPLIT} SELECT {_STATS} FROM split")
def split_stats(spark, sf):
    return P.split_stats(concept_split(spark, sf))


@query("sample_targets", f"WITH {INTER} SELECT user_id, pos FROM inter WHERE pos >= 1 ORDER BY sha256(concat_ws(chr(9), '42', user_id, CAST(pos AS VARCHAR))) LIMIT 500")
def sample_targets(spark, sf):
    return P.sample_targets(D.interactions(spark, sf, "user_id"), 500).select("user_id", *_long("pos"))


@query("sample_users", f"WITH {LOGS}, u AS (SELECT user_id, count(*) AS logs FROM logs GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM u ORDER BY sha256(concat_ws(chr(9), '42', user_id)) LIMIT 100")
def sample_users(spark, sf):
    return P.sample_users(D.logs(spark, sf), 100)


_ONE = f"""{INTER}, h AS (SELECT user_id, pos, problem_id, sha256(concat_ws(chr(9), '42', user_id, CAST(pos AS VARCHAR))) AS h FROM inter WHERE pos >= 1),
one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h, pos) = 1)"""


@query("sample_one_per_user", f"WITH {_ONE} SELECT user_id, pos, problem_id FROM one ORDER BY sha256(concat_ws(chr(9), '42', user_id)) LIMIT 200")
def sample_one_per_user(spark, sf):
    return P.sample_one_per_user(D.interactions(spark, sf, "problem_id"), 200).select("user_id", *_long("pos"), "problem_id")


# -- metrics -----------------------------------------------------------------

_PRED = """pred AS (SELECT round(1.0 / (1.0 + exp(-(l_quantity - 25.0) / 20.0 + 5.0 * l_discount)), 3) AS score,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""


def predictions(spark, sf):
    z = -(F.col("l_quantity") - 25.0) / 20.0 + 5.0 * F.col("l_discount")
    return D.table(spark, sf, "lineitem").select(
        F.round(1.0 / (1.0 + F.exp(z)), 3).alias("score"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("label")
    )


@query(
    "binary_metrics",
    f"""WITH {_PRED}, c AS (SELECT greatest(1e-7, least(1 - 1e-7, score)) AS s, label AS y FROM pred),
g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER () AS t, sum(pos) OVER () AS p FROM g),
m AS (SELECT any_value(p) AS p, any_value(t) AS t, sum(pos * (t - cn + (n + 1) / 2.0)) AS ranks, sum(pos / p * (cp / cn)) AS ap,
  sum(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN n ELSE 0 END) AS called FROM r)
SELECT round((ranks - p * (p + 1) / 2.0) / (p * (t - p)), 6) AS auc, round(ap, 6) AS pr_auc, round((tp + t - p - called + tp) / t, 6) AS acc,
  round(tp / called, 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (called + p), 6) AS f1,
  (SELECT round(avg(-y * ln(s) - (1 - y) * ln(1 - s)), 6) FROM c) AS bce, (SELECT round(sqrt(avg((s - y) * (s - y))), 6) FROM c) AS rmse,
  CAST(t AS BIGINT) AS sample_count, round(p / t, 6) AS positive_rate FROM m""",
)
def binary_metrics(spark, sf):
    return _rounded(M.binary_metrics(predictions(spark, sf)))


@query(
    "strict_threshold",
    f"""WITH {_PRED}, c AS (SELECT score, greatest(1e-10, least(1 - 1e-10, score)) AS s, label AS y FROM pred)
SELECT round(avg(CASE WHEN (score > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS acc, round(avg(-(y * ln(s) + (1 - y) * ln(1 - s))), 6) AS entropy FROM c""",
)
def strict_threshold(spark, sf):
    return _rounded(M.strict_threshold(predictions(spark, sf)))


@query(
    "prediction_sanity",
    f"""WITH {_PRED} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max,
  round(avg(label), 6) AS positive_rate FROM pred""",
)
def prediction_sanity(spark, sf):
    return _rounded(M.sanity_stats(predictions(spark, sf), F.col("score"), F.col("label")))


@query(
    "vector_sanity",
    """WITH v AS (SELECT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS v FROM embeddings)
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM v""",
)
def vector_sanity(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    return _rounded(M.vector_norms(vectors)).select("n", "mean", "min", "max")


@query("reuse_ratio", "SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text) / count(*), 6) AS reuse_ratio FROM documents")
def reuse_ratio(spark, sf):
    return _rounded(M.reuse_ratio(D.table(spark, sf, "documents"), "text"))


@query(
    "vocabulary_counts",
    f"""WITH {LOGS}, {CATALOG} SELECT count(DISTINCT problem_id) AS questions, count(DISTINCT user_id) AS users, count(*) AS logs,
  max(CAST(problem_id AS BIGINT)) + 1 AS inferred_size, (SELECT count(DISTINCT c) FROM (SELECT unnest(concepts) AS c FROM catalog)) AS concepts FROM logs""",
)
def vocabulary_counts(spark, sf):
    return M.counts(D.logs(spark, sf), D.catalog(spark, sf))


_LAB = "lab AS (SELECT problem_id, replace(text, ' ', '-') AS l FROM catalog)"
_POOL = """numbered AS (SELECT problem_id, row_number() OVER (ORDER BY sha256(concat_ws(chr(9), '42', problem_id))) - 1 AS slot FROM catalog),
pooled AS (SELECT t.user_id, t.pos, t.problem_id, n.problem_id AS h_problem_id, row_number() OVER (PARTITION BY t.user_id, t.pos ORDER BY draw) AS rank
  FROM targets t, range(1, 21) AS r(draw)
  JOIN numbered n ON n.slot = ('0x' || substr(sha256(concat_ws(chr(9), '42', t.user_id, CAST(t.pos AS VARCHAR), CAST(draw AS VARCHAR))), 1, 12))::BIGINT % (SELECT count(*) FROM catalog)
  WHERE n.problem_id <> t.problem_id QUALIFY rank <= 4)"""


@query(
    "retrieval_quality",
    f"""WITH {_heuristic_sql(_LAST)[5:].rsplit("SELECT user_id", 1)[0]}, {_LAB}, {_POOL},
ret AS (SELECT user_id, pos, problem_id, h_problem_id FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY user_id, pos ORDER BY score DESC, h_pos) <= 4),
rnd AS (SELECT t.user_id, t.pos, t.problem_id, h.problem_id AS h_problem_id FROM targets t JOIN inter h ON t.user_id = h.user_id AND h.pos < t.pos AND h.problem_id <> t.problem_id
  QUALIFY row_number() OVER (PARTITION BY t.user_id, t.pos ORDER BY sha256(concat_ws(chr(9), '42', t.user_id, CAST(t.pos AS VARCHAR), CAST(h.pos AS VARCHAR)))) <= 4),
u AS (SELECT 'retriever' AS strategy, * FROM ret UNION ALL SELECT 'history_random', * FROM rnd UNION ALL SELECT 'global_random', user_id, pos, problem_id, h_problem_id FROM pooled),
q AS (SELECT strategy, count(*) AS retrieved_pairs, avg(CASE WHEN a.l = b.l THEN 1.0 ELSE 0.0 END) AS sc,
  avg(CASE WHEN split_part(a.l, '-', 1) = split_part(b.l, '-', 1) THEN 1.0 ELSE 0.0 END) AS st
  FROM u JOIN lab a ON u.problem_id = a.problem_id JOIN lab b ON u.h_problem_id = b.problem_id GROUP BY ALL)
SELECT strategy, retrieved_pairs, round(sc, 6) AS same_cluster_rate, round(st, 6) AS same_top_rate,
  round(sc - (SELECT sc FROM q WHERE strategy = 'history_random'), 6) AS gain_history,
  round(sc - (SELECT sc FROM q WHERE strategy = 'global_random'), 6) AS gain_global FROM q""",
)
def retrieval_quality(spark, sf):
    rows, targets, profile = last_targets(spark, sf)
    labels = D.catalog(spark, sf).select("problem_id", F.replace("text", F.lit(" "), F.lit("-")).alias("semantic_id"))
    found = {
        "retriever": R.heuristic_for_targets(rows, targets, profile=profile),
        "history_random": R.random_from_history(rows, targets, labels),
        "global_random": R.random_from_pool(targets, labels),
    }
    each = [df.select(F.lit(name).alias("strategy"), "problem_id", "h_problem_id") for name, df in found.items()]
    return _rounded(M.retrieval_quality(each[0].unionByName(each[1]).unionByName(each[2]), labels))


@query("random_pool_baseline", f"WITH {INTER}, {CATALOG}, targets AS ({_LAST}), {_POOL} SELECT user_id, CAST(pos AS BIGINT) AS pos, problem_id, rank, h_problem_id FROM pooled")
def random_pool_baseline(spark, sf):
    """Four hash-drawn problems of the whole catalog per user's last target."""
    targets = S.last_target(D.interactions(spark, sf, "problem_id"), ["problem_id"]).select("user_id", F.col("target_t").alias("pos"), F.col("target_problem_id").alias("problem_id"))
    out = R.random_from_pool(targets, D.catalog(spark, sf))
    return out.select("user_id", F.col("pos").cast("bigint").alias("pos"), "problem_id", F.col("rank").cast("bigint").alias("rank"), "h_problem_id")


_LABELS = "lab AS (SELECT problem_id, replace(text, ' ', '-') || CASE WHEN level = 6 THEN '-misc' ELSE '' END AS semantic_id FROM catalog)"


def labels_with_noise(spark, sf):
    noise = F.when(F.col("level") == 6, "-misc").otherwise("")
    return D.catalog(spark, sf).select("problem_id", F.concat(F.replace("text", F.lit(" "), F.lit("-")), noise).alias("semantic_id"))


_COLORS = "('red', 'blue', 'green', 'black', 'yellow', 'purple', 'orange', 'brown', 'gray', 'pink', 'left', 'right', 'misc')"


@query(
    "semantic_audit",
    f"""WITH {CATALOG}, {_LABELS}, p AS (SELECT string_split(semantic_id, '-') AS p FROM lab),
x AS (SELECT p, len(list_filter(p, lambda x: x IN {_COLORS})) > 0 AS noise, len(p) >= 2 AND len(list_distinct(p)) = 1 AS dup FROM p)
SELECT count(*) AS total_ids, count(*) FILTER (noise OR dup) AS flagged_ids, count(*) FILTER (len(p) = 1) AS single_token_ids, count(*) FILTER (len(p) <> 1) AS pair_ids,
  CAST(0 AS BIGINT) AS empty_ids, count(*) FILTER (dup) AS duplicate_tokens, count(*) FILTER (noise) AS contains_noise, round(count(*) FILTER (noise OR dup) / count(*), 4) AS flagged_ratio FROM x""",
)
def semantic_audit(spark, sf):
    return M.label_audit(labels_with_noise(spark, sf))


@query(
    "suspicious_tokens",
    f"WITH {CATALOG}, {_LABELS}, t AS (SELECT unnest(string_split(semantic_id, '-')) AS token FROM lab) SELECT token, count(*) AS n FROM t WHERE token IN {_COLORS} GROUP BY ALL ORDER BY n DESC, token LIMIT 50",
)
def suspicious_tokens(spark, sf):
    return M.suspicious_tokens(labels_with_noise(spark, sf))


@query("cluster_report", f"WITH {CATALOG} SELECT text AS semantic_id, count(*) AS members, round(count(*) / (SELECT count(*) FROM catalog), 6) AS share FROM catalog GROUP BY ALL")
def cluster_report(spark, sf):
    return _rounded(M.cluster_report(D.catalog(spark, sf).select("problem_id", F.col("text").alias("semantic_id"))))


@query(
    "largest_clusters",
    f"""WITH {CATALOG}, s AS (SELECT text AS semantic_id, count(*) AS members FROM catalog GROUP BY ALL ORDER BY members DESC, semantic_id LIMIT 3)
SELECT s.semantic_id, members, problem_id, row_number() OVER (PARTITION BY s.semantic_id ORDER BY sha256(concat_ws(chr(9), '42', problem_id))) AS rank
FROM s JOIN catalog c ON c.text = s.semantic_id QUALIFY rank <= 3""",
)
def largest_clusters(spark, sf):
    out = M.largest_clusters(D.catalog(spark, sf).select("problem_id", F.col("text").alias("semantic_id")))
    return out.select("semantic_id", "members", "problem_id", *_long("rank"))


# -- validation --------------------------------------------------------------


@query(
    "alignment_check",
    f"""WITH {INTER}, {CATALOG}, b AS (SELECT user_id, pos FROM inter JOIN catalog USING (problem_id) WHERE level < 6),
j AS (SELECT a.user_id AS ua, b.user_id AS ub FROM inter a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos),
la AS (SELECT user_id, count(*) AS n FROM inter GROUP BY ALL), lb AS (SELECT user_id, count(*) AS n FROM b GROUP BY ALL)
SELECT 'only_left' AS rule, count(*) FILTER (ub IS NULL) AS violations FROM j UNION ALL SELECT 'only_right', count(*) FILTER (ua IS NULL) FROM j
UNION ALL SELECT 'length_differs', count(*) FILTER (la.n IS DISTINCT FROM lb.n) FROM la FULL JOIN lb ON la.user_id = lb.user_id""",
)
def alignment_check(spark, sf):
    rows = D.interactions(spark, sf, "problem_id").select("user_id", "pos", "problem_id")
    some = rows.join(D.catalog(spark, sf).filter(F.col("level") < 6).select("problem_id"), "problem_id", "left_semi")
    return K.alignment(rows, some)


_RULES = ("stage1_count", "selected_count", "summary_header", "template_without_summary", "rank_not_dense", "unknown_role", "support_decimals", "question_too_long", "ellipsis_missing")


@query(
    "context_rules",
    f"""WITH {SELECTED}, l AS (SELECT user_id, pos, list(h_pos ORDER BY rank) AS l FROM chosen GROUP BY ALL)
SELECT unnest({list(_RULES)}) AS rule, CAST(0 AS BIGINT) AS violations, CAST(1 AS BIGINT) AS passed
UNION ALL SELECT 'not_time_sorted', count(*) FILTER (l <> list_sort(l)), 1 FROM l""",
)
def context_rules(spark, sf):
    """Every rule on generated contexts; violations must be zero except the informative order count."""
    return K.report(K.context_rules(contexts(spark, sf)))


@query(
    "label_rules",
    f"""WITH {CATALOG}, {_LABELS}, p AS (SELECT string_split(semantic_id, '-') AS p FROM lab),
x AS (SELECT len(list_filter(p, lambda x: x IN {_COLORS})) > 0 AS noise, len(p) >= 2 AND len(list_distinct(p)) = 1 AS dup FROM p),
a AS (SELECT CAST(max(noise) AS BIGINT) AS n, CAST(max(dup) AS BIGINT) AS d, CASE WHEN count(*) FILTER (noise OR dup) / count(*) > 0.2 THEN 1 ELSE 0 END AS f FROM x)
SELECT 'label_noise' AS rule, n AS violations, 1 - n AS passed FROM a UNION ALL SELECT 'label_duplicates', d, 1 - d FROM a
UNION ALL SELECT 'label_empty', CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT 'label_flagged_ratio', f, 1 - f FROM a UNION ALL SELECT 'label_coverage', 0, 1""",
)
def label_rules(spark, sf):
    size = D.catalog(spark, sf).agg(F.count(F.lit(1))).scalar()
    return K.report(K.label_rules(M.label_audit(labels_with_noise(spark, sf)), catalog_size=size))


@query("label_stability", f"WITH {CATALOG} SELECT 'value_changed' AS rule, count(*) FILTER (level = 6) AS violations FROM catalog")
def label_stability(spark, sf):
    plain = D.catalog(spark, sf).select("problem_id", F.replace("text", F.lit(" "), F.lit("-")).alias("semantic_id"))
    return K.stability(plain, labels_with_noise(spark, sf))


@query(
    "vector_coverage",
    f"""WITH {INTER}, {VECS} SELECT 'main_missing' AS rule, count(*) FILTER (u.problem_id IS NULL) AS violations FROM inter i LEFT JOIN unit u USING (problem_id)
UNION ALL SELECT 'main_unknown', 0 UNION ALL SELECT 'main_repeated', 0""",
)
def vector_coverage(spark, sf):
    rows = D.interactions(spark, sf, "problem_id").select("user_id", F.col("pos").alias("target_t"), "problem_id")
    vectors = rows.join(D.item_vectors(spark, sf), "problem_id").withColumn("kind", F.lit("main"))
    return K.vector_rules(rows, vectors, ["main"])


@query(
    "irt_score",
    f"""WITH {INTER}, {CATALOG} SELECT user_id, pos, round(0.1 + 0.9 / (1 + exp(-1.702 * (0.5 + level / 6.0) * ((is_correct - 0.5) - (level - 3) / 3.0))), 6) AS p3,
  round(1 / (1 + exp(-(level * 0.2 + is_correct * 0.3) + 0.5)), 6) AS p2 FROM inter JOIN catalog USING (problem_id)""",
)
def irt_score(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "is_correct").select("user_id", "pos", "problem_id", "is_correct").join(D.catalog(spark, sf).select("problem_id", "level"), "problem_id")
    p3 = V.irf(F.col("is_correct") - 0.5, 0.5 + F.col("level") / 6.0, (F.col("level") - 3) / 3.0, 0.1)
    p2 = V.mirf(F.array(F.col("level").cast("double"), F.col("is_correct").cast("double")), F.array(F.lit(0.2), F.lit(0.3)), F.lit(0.5))
    return rows.select("user_id", *_long("pos"), F.round(p3, 6).alias("p3"), F.round(p2, 6).alias("p2"))
