"""Readers, writers and text functions, exercised on data Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import keys as H
from tracelake.functions import text as X
from tracelake.functions import vectors as V
from tracelake.operators import sequences as S
from tracelake.registry.base import CATALOG, INTER, LOGS, query
from tracelake.session import scratch_path
from tracelake.sources import driver_tables as D
from tracelake.sources import readers as R
from tracelake.sources import writers as W
from tracelake.streaming.incremental import materialise_missing


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _sequences(spark, sf):
    rows = D.interactions(spark, sf, "problem_id", "exercise_id", "is_correct").select(
        "user_id", "pos", F.col("problem_id").cast("int").alias("p"), F.col("exercise_id").cast("int").alias("q"), F.col("is_correct").alias("a")
    )
    return S.chunk(rows, 200, {"p": None, "q": None, "a": None})


def _sequence_sql(cols: str) -> str:
    return f"""WITH {INTER}, s AS (SELECT user_id, pos // 200 AS c, string_agg(problem_id, ',' ORDER BY pos) AS p, string_agg(exercise_id, ',' ORDER BY pos) AS q,
  string_agg(CAST(is_correct AS VARCHAR), ',' ORDER BY pos) AS a, CAST(count(*) AS VARCHAR) AS header FROM inter GROUP BY ALL) SELECT {cols} FROM s"""


def _csv(c):
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)


@query("three_line_round_trip", _sequence_sql("header, q, a"))
def three_line_round_trip(spark, sf):
    path = scratch_path(spark)
    W.write_sequences(_sequences(spark, sf), path)
    return R.read_sequences(spark, path).select("header", _csv("q"), _csv("a"))


@query("four_line_round_trip", _sequence_sql("user_id AS header, p, q, a"))
def four_line_round_trip(spark, sf):
    path = scratch_path(spark)
    W.write_sequences(_sequences(spark, sf), path, 4, header="user_id")
    return R.read_sequences(spark, path, 4).select("header", _csv("p"), _csv("q"), _csv("a"))


@query(
    "sequence_pairs",
    f"""WITH {INTER} SELECT '[' || string_agg('[' || exercise_id || ',' || is_correct || ']', ',' ORDER BY pos) || ']' AS value FROM inter GROUP BY user_id, pos // 200""",
)
def sequence_pairs(spark, sf):
    return W.sequence_pairs(_sequences(spark, sf))


def _students(spark, sf):
    """Nested student records in input order, the shape of a raw export."""
    logs = D.interactions(spark, sf).withColumn("chunk", F.floor(F.col("pos") / 1000))
    item = F.struct(
        "log_id", "problem_id", F.col("is_correct").cast("string").alias("is_correct"),
        F.when(F.col("is_correct") == 1, F.col("submit_time_raw")).otherwise(F.translate("submit_time_raw", "-", "/")).alias("submit_time"), "exercise_id", "course_id",
    )
    return logs.groupBy("user_id", "chunk").agg(F.collect_list(item).alias("seq")).drop("chunk")


@query(
    "student_json_load",
    f"""WITH {LOGS}, r AS (SELECT *, CASE WHEN is_correct = 1 THEN strftime(submit_time, '%Y-%m-%d %H:%M:%S') ELSE strftime(submit_time, '%Y/%m/%d %H:%M:%S') END AS raw FROM logs)
SELECT user_id, log_id, problem_id, CAST(is_correct AS BIGINT) AS is_correct,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY submit_time, raw, log_id) - 1 AS BIGINT) AS pos FROM r""",
)
def student_json_load(spark, sf):
    path = scratch_path(spark)
    W.write_json(_students(spark, sf), path)
    return R.read_interactions(spark, path).select("user_id", "log_id", "problem_id", *_long("is_correct", "pos"))


@query(
    "catalog_json_load",
    f"""WITH {CATALOG} SELECT problem_id, text, title, chapter, CAST(level AS BIGINT) AS level, array_to_string(list_sort(concepts), ',') AS concepts FROM catalog""",
)
def catalog_json_load(spark, sf):
    raw = D.catalog(spark, sf)
    quote = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    literal = F.concat(F.lit("{'content': "), quote("text"), F.lit(", 'title': "), quote("title"), F.lit(", 'location': "), quote("location"), F.lit(", 'body': None}"))
    as_json = F.to_json(F.struct(F.col("text").alias("content"), "title", "location"))
    path = scratch_path(spark)
    W.write_json(
        raw.select(
            "problem_id", F.when(F.col("level") % 2 == 0, as_json).otherwise(literal).alias("detail"),
            F.concat(F.col("level").cast("string"), F.lit(".0")).alias("cognitive_dimension"), F.array_union("concepts", F.array(F.lit(""))).alias("concepts"),
        ),
        path,
    )
    out = R.read_catalog(spark, path)
    return out.select("problem_id", "text", "title", "chapter", *_long("level"), F.array_join(F.array_sort("concepts"), ",").alias("concepts"))


@query(
    "catalog_rejects",
    "SELECT CAST(p_partkey AS VARCHAR) AS problem_id, 'unreadable level' AS reason FROM part WHERE p_size > 40",
)
def catalog_rejects(spark, sf):
    level = F.when(F.col("p_size") > 40, "high").otherwise(F.col("p_size").cast("string"))
    raw = D.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("problem_id"), F.lit(None).cast("string").alias("id"), level.alias("cognitive_dimension")
    )
    return R.catalog_rejects(raw).select("problem_id", "reason")


@query(
    "edge_csv_round_trip",
    "SELECT p_brand AS src, p_type AS dst, 'adj' AS rel_type, round(count(*) / 100.0, 6) AS weight FROM part GROUP BY ALL",
)
def edge_csv_round_trip(spark, sf):
    edges = D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).agg((F.count(F.lit(1)) / 100.0).alias("weight"))
    edges = edges.withColumn("rel_type", F.lit("adj")).withColumn("source", F.lit("stat"))
    path = scratch_path(spark)
    W.write_edges(edges.unionByName(edges.withColumn("weight", F.lit(0.0))), path)
    return R.read_edges(spark, path).select("src", "dst", "rel_type", F.round("weight", 6).alias("weight"))


@query("cache_last_wins", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS summary_text FROM events GROUP BY ALL")
def cache_last_wins(spark, sf):
    events = D.table(spark, sf, "events")
    lines = F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.col("props").alias("summary_text")))
    ordered = events.select("event_id", lines.alias("value")).unionByName(events.select("event_id", F.lit("{broken").alias("value")))
    path = scratch_path(spark)
    # Ranges of event ids become files in order, so "last" is the largest event.
    ordered.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return R.read_cache(spark, path)


@query("shard_round_trip", f"WITH {LOGS} SELECT user_id, count(*) AS n FROM logs GROUP BY ALL")
def shard_round_trip(spark, sf):
    path = scratch_path(spark)
    W.write_sharded(D.logs(spark, sf), path, 4)
    return W.read_shards(spark, path, 4).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_append", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def incremental_append(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark)
    compute = lambda df: df.select("doc_id", F.length("text").cast("bigint").alias("n"))
    materialise_missing(docs.filter(F.col("lang") == "en"), path, ["doc_id"], compute, "doc_id bigint, n bigint")
    return materialise_missing(docs, path, ["doc_id"], compute, "doc_id bigint, n bigint")


@query("missing_keys", "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def missing_keys(spark, sf):
    from tracelake.streaming.incremental import missing_keys as missing

    wanted = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return missing(wanted, D.table(spark, sf, "events").select("user_id"), ["user_id"])


@query("run_manifest", f"WITH {LOGS} SELECT count(*) AS logs, count(DISTINCT user_id) AS users, 20 AS history_window, 'strict' AS variant FROM logs")
def run_manifest(spark, sf):
    counts = D.logs(spark, sf).agg(F.count(F.lit(1)).alias("logs"), F.countDistinct("user_id").alias("users"))
    return W.manifest(counts, history_window=20, variant="strict")


@query("preview_rows", f"WITH {INTER} SELECT user_id, pos, problem_id FROM inter ORDER BY user_id, pos LIMIT 20")
def preview_rows(spark, sf):
    return D.interactions(spark, sf, "problem_id").select("user_id", *_long("pos"), "problem_id").orderBy("user_id", "pos").limit(20)


# -- text and key functions over whole texts ---------------------------------

_STOPS = ", ".join(f"'{w}'" for w in (*X.STOP_WORDS, *X.MARKUP_STOP_WORDS, X.PLACEHOLDER))
_PUNCT = r"[\s\-_`~!@#$%^&*+=|\\/:;\"''<>,.?()\[\]{{}}]+".replace("{{}}", "{}")


@query(
    "token_noise",
    f"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS raw FROM documents), t AS (SELECT DISTINCT raw FROM w),
n AS (SELECT raw, regexp_replace(replace(replace(trim(raw), '&nbsp;', 'nbsp'), '&#', ''), '^{_PUNCT}|{_PUNCT}$', '', 'g') AS token FROM t)
SELECT raw, CASE WHEN token = '' OR lower(token) IN ({_STOPS}) OR contains(token, '____') OR starts_with(lower(token), 'mathjax')
  OR (starts_with(lower(token), 'math') AND ends_with(lower(token), 'inline')) OR regexp_full_match(token, '[a-zA-Z]{{1,3}}[0-9]{{1,4}}') THEN '' ELSE token END AS token FROM n""",
)
def token_noise(spark, sf):
    words = D.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("raw")).distinct()
    return words.select("raw", X.clean_token(F.col("raw")).alias("token"))


@query(
    "display_texts",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t, text FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS short, replace(substr(text, 1, 200), chr(10), ' ') AS excerpt FROM t""",
)
def display_texts(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text")).alias("short"), X.content_excerpt(F.col("text")).alias("excerpt"))


@query(
    "content_keys",
    f"""WITH {INTER} SELECT user_id || chr(9) || pos || chr(9) || problem_id AS key,
  sha1('{{"a":"' || problem_id || '","b":' || is_correct || '}}') AS sig, CAST(('0x' || substr(sha256(user_id), 1, 8)) AS BIGINT) % 10 AS bucket FROM inter""",
)
def content_keys(spark, sf):
    return D.interactions(spark, sf, "problem_id", "is_correct").select(
        H.context_key(F.col("user_id"), F.col("pos"), F.col("problem_id")).alias("key"),
        H.signature(a=F.col("problem_id"), b=F.col("is_correct")).alias("sig"), H.hash_bucket(F.col("user_id")).cast("bigint").alias("bucket"),
    )


@query(
    "labels_and_levels",
    f"""WITH {CATALOG} SELECT problem_id, chapter AS main_chapter, CAST(level AS BIGINT) AS level, split_part(title || '-' || text, '-', 1) AS top, format('{{:.4f}}', level / 7.0) AS ratio FROM catalog""",
)
def labels_and_levels(spark, sf):
    cat = D.catalog(spark, sf)
    return cat.select(
        "problem_id", X.main_chapter(F.col("location")).alias("main_chapter"), X.safe_level(F.concat(F.col("level").cast("string"), F.lit(".7"))).cast("bigint").alias("level"),
        X.top_label(F.concat_ws("-", "title", "text")).alias("top"), X.fixed_decimals(F.col("level") / 7.0).alias("ratio"),
    )


@query(
    "fallback_labels",
    f"""WITH {CATALOG}, w AS (SELECT problem_id, string_split(text, ' ') AS words, chapter FROM catalog)
SELECT problem_id, lower(chapter) AS macro, coalesce(list_filter(words, lambda x: x NOT IN ({_STOPS}))[1], lower(chapter)) AS micro,
  CASE WHEN lower(chapter) = micro THEN micro ELSE lower(chapter) || '-' || micro END AS label FROM w""",
)
def fallback_labels(spark, sf):
    cat = D.catalog(spark, sf).withColumn("concepts", F.split("text", " "))
    fields = [F.col(c) for c in ("chapter", "concepts", "title", "text")]
    out = cat.select("problem_id", X.macro_fallback(*fields).alias("macro"), X.micro_fallback(*fields).alias("micro"))
    return out.withColumn("label", X.compose_label(F.col("macro"), F.col("micro")))


@query(
    "cluster_texts",
    f"""WITH {CATALOG} SELECT problem_id, trim(text || ' ' || array_to_string(list_filter(string_split(text, ' '), lambda x: x NOT IN ({_STOPS})), ' ')) AS ctext FROM catalog""",
)
def cluster_texts(spark, sf):
    cat = D.catalog(spark, sf)
    return cat.select("problem_id", X.cluster_text(F.col("problem_id"), F.col("text"), F.col("title"), F.split("text", " ")).alias("ctext"))


def _summaries(spark, sf):
    """Model-style answers built from the label table: fences, reasoning blocks and broken rules included."""
    lab = D.table(spark, sf, "labels")
    item = lambda c: F.array(F.struct(c.alias("concept"), F.array(F.lit("1"), F.lit("x")).alias("evidence_ids"), F.lit("高").alias("confidence")))
    body = F.to_json(
        F.struct(
            item(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("mastered_concepts"), item(F.lit("w")).alias("weak_concepts"),
            F.lit("平稳").alias("transfer_state"), F.when(F.col("toxic") == 1, "未知").otherwise("低").alias("risk_level"),
            F.lit("中").alias("evidence_quality"), F.when(F.col("quality") == 1, "掌握良好").otherwise("").alias("diagnosis"),
        )
    )
    return lab.select("doc_id", F.concat(F.lit("<think>plan {x}</think>```json\n"), body, F.lit("\n```")).alias("answer"))


@query(
    "summary_check",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'risk:level' WHEN quality <> 1 THEN 'diagnosis:empty' ELSE 'ok' END AS problem,
  '稳定掌握点：c' || doc_id || ' 持续薄弱点：w' AS points, round(4 / 80.0, 6) * quality AS size_feature FROM labels""",
)
def summary_check(spark, sf):
    text = _summaries(spark, sf).withColumn("clean", X.clean_model_output(F.col("answer")))
    parsed = text.withColumn("s", X.parse_summary(F.col("clean")))
    context = X.summary_context(F.col("s"), F.lit(""))
    return parsed.select(
        "doc_id", F.coalesce(X.summary_error(F.col("clean")), F.lit("ok")).alias("problem"),
        F.regexp_extract(context, "(稳定掌握点：.* 持续薄弱点：[^ ]*)", 1).alias("points"),
        F.round(X.summary_features(F.col("s"))[4], 6).alias("size_feature"),
    )


@query(
    "vector_math",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
c AS (SELECT label, list_transform(range(64), lambda k: list_avg(list_transform(list(v), lambda x: x[k + 1]))) AS m FROM v GROUP BY ALL),
s AS (SELECT vec_id, list_cosine_similarity(v, m) AS cos, sqrt(list_inner_product(v, v)) AS norm, v.label FROM v JOIN c USING (label))
SELECT vec_id, round(cos, 6) AS cos, round(norm, 6) AS norm, round(exp(cos) / sum(exp(cos)) OVER (PARTITION BY label), 6) AS share, round(1 / (1 + exp(-cos)), 6) AS logistic FROM s""",
)
def vector_math(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = D.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    centres = v.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
    out = v.join(centres, "label").select("vec_id", "label", V.cosine(F.col("v"), F.col("m")).alias("c"), V.norm(F.col("v")).alias("norm"))
    out = V.softmax_within(out, ["label"], "c", "share")
    return out.select("vec_id", F.round("c", 6).alias("cos"), *[F.round(x, 6).alias(x) for x in ("norm", "share")], F.round(V.sigmoid(F.col("c")), 6).alias("logistic"))


@query(
    "qmatrix",
    f"""WITH {LOGS}, {CATALOG}, k AS (SELECT concept, row_number() OVER (ORDER BY concept) AS code FROM (SELECT DISTINCT unnest(concepts) AS concept FROM catalog)),
m AS (SELECT problem_id, list_sort(list(code - 1)) AS idx FROM (SELECT problem_id, unnest(concepts) AS concept FROM catalog) JOIN k USING (concept) GROUP BY ALL)
SELECT user_id, log_id, problem_id, CAST(is_correct AS BIGINT) AS is_correct, array_to_string(idx, ',') AS knowledge FROM logs JOIN m USING (problem_id)""",
)
def qmatrix(spark, sf):
    from tracelake.operators.items import dense_ids, item_knowledge, q_matrix

    catalog = D.catalog(spark, sf)
    codes = dense_ids(catalog.select(F.explode("concepts").alias("concept")), "concept", base=1)
    out = q_matrix(D.logs(spark, sf), item_knowledge(catalog, codes))
    return out.select("user_id", "log_id", "problem_id", *_long("is_correct"), F.concat_ws(",", F.col("knowledge").cast("array<string>")).alias("knowledge"))


@query("dense_ids_sorted", "SELECT CAST(p_partkey AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) AS dense_id FROM part")
def dense_ids_sorted(spark, sf):
    from tracelake.operators.items import dense_ids

    return dense_ids(D.catalog(spark, sf), "problem_id", base=1).select(F.col("problem_id").alias("value"), *_long("dense_id"))


@query(
    "dense_ids_first_seen",
    f"WITH {LOGS}, f AS (SELECT exercise_id, min({{'a': submit_time, 'b': log_id}}) AS f FROM logs GROUP BY ALL) SELECT exercise_id AS value, row_number() OVER (ORDER BY f) - 1 AS dense_id FROM f",
)
def dense_ids_first_seen(spark, sf):
    from tracelake.operators.items import dense_ids

    out = dense_ids(D.logs(spark, sf), "exercise_id", order=["submit_time", "log_id"])
    return out.select(F.col("exercise_id").alias("value"), *_long("dense_id"))


@query(
    "item_groups",
    f"WITH {LOGS} SELECT exercise_id, count(DISTINCT problem_id) AS problems, array_to_string(list_sort(list(DISTINCT problem_id)), ',') AS members FROM logs GROUP BY ALL",
)
def item_groups(spark, sf):
    from tracelake.operators.items import group_members

    out = group_members(D.logs(spark, sf), "exercise_id")
    return out.select("exercise_id", F.size("members").cast("bigint").alias("problems"), F.array_join("members", ",").alias("members"))
