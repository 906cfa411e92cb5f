"""Artifact validation: every rule becomes one row (rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import ELLIPSIS, LEVEL_VALUES, TRUNCATE_AT, summary_error
from tracelake.operators.evidence import HISTORY_WINDOW, ROLE_LABELS, STAGE1_TOP

# Fixed values of the quality rules.
MAX_FLAGGED, MAX_FALLBACK = 0.20, 0.35
SELECTED_TOP = 6
HEADER = "[GLOBAL SUMMARY]"
GRAPH_KEYS = ("prerequisite_candidates", "related_candidates", "confidence")
GRAPH_OPTIONAL_KEYS = ("chapters", "candidate_concepts")


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of rows breaking each rule, in one pass, as (rule, violations)."""
    counted = df.agg(*[F.coalesce(F.sum(F.coalesce(cond, F.lit(True)).cast("bigint")), F.lit(0)).alias(name) for name, cond in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return counted.select(F.inline(pairs))


def label_rules(audit: DataFrame, generation: DataFrame | None = None, catalog_size: Column | int | None = None) -> DataFrame:
    """Quality of semantic labels from the audit row (and the fallback counts of their generation)."""
    rules = {
        "label_noise": F.col("contains_noise") > 0,
        "label_duplicates": F.col("duplicate_tokens") > 0,
        "label_empty": F.col("empty_ids") > 0,
        "label_flagged_ratio": F.col("flagged_ratio") > MAX_FLAGGED,
    }
    if catalog_size is not None:
        size = F.lit(catalog_size) if isinstance(catalog_size, int) else catalog_size
        rules["label_coverage"] = F.col("total_ids") != size
    out = _rules(audit, rules)
    if generation is not None:
        total = F.greatest(F.col("problem_count"), F.lit(1))
        out = out.unionByName(
            _rules(generation, {f"{k}_fallback_ratio": F.col(f"{k}_fallback_count") / total > MAX_FALLBACK for k in ("macro", "micro")})
        )
    return out


def stability(stored: DataFrame, recomputed: DataFrame, key: str = "problem_id", value: str = "semantic_id") -> DataFrame:
    """Keys whose stored and recomputed values differ or exist on one side only."""
    both = stored.select(key, F.col(value).alias("_a")).join(recomputed.select(key, F.col(value).alias("_b")), key, "full_outer")
    return _rules(both, {"value_changed": ~F.col("_a").eqNullSafe(F.col("_b"))})


def setting_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """Settings (name, value) of two stages: shared names agree, none is blank."""
    both = first.select("name", F.col("value").alias("_a")).join(second.select("name", F.col("value").alias("_b")), "name")
    return _rules(both, {"setting_mismatch": F.col("_a") != F.col("_b"), "setting_blank": F.trim("_a") == ""})


def difficulty_rules(difficulty: DataFrame, catalog: DataFrame, value: str = "mu") -> DataFrame:
    """Every problem has a finite difficulty and not all are zero."""
    joined = catalog.select("problem_id").join(difficulty.select("problem_id", F.col(value).alias("_v")), "problem_id", "left")
    finite = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    rows = _rules(joined, {"difficulty_missing": F.col("_v").isNull(), "difficulty_not_finite": F.col("_v").isNotNull() & ~finite})
    flat = joined.agg(F.coalesce(F.max(F.abs("_v")), F.lit(0.0)).alias("_max"))
    return rows.unionByName(_rules(flat, {"difficulty_all_zero": F.col("_max") <= 1e-8}))


def graph_payload_rules(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON suggestion payloads: required and allowed keys, lists, confidence values."""
    keys = F.json_object_keys(payload)
    allowed = F.array(*[F.lit(k) for k in (*GRAPH_KEYS, *GRAPH_OPTIONAL_KEYS)])
    is_list = lambda k: F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit("")).startswith("[")
    missing = [~F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in GRAPH_KEYS]
    return _rules(
        payloads,
        {
            "payload_invalid": keys.isNull(),
            "payload_key_missing": keys.isNotNull() & reduce(lambda a, b: a | b, missing),
            "payload_key_unknown": keys.isNotNull() & (F.size(F.array_except(keys, allowed)) > 0),
            "candidates_not_a_list": keys.isNotNull() & ~(is_list(GRAPH_KEYS[0]) & is_list(GRAPH_KEYS[1])),
            "confidence_invalid": ~F.coalesce(F.get_json_object(payload, "$.confidence").isin(*LEVEL_VALUES), F.lit(False)),
        },
    )


def no_prerequisites(edges: DataFrame) -> DataFrame:
    """With suggestions switched off, the graph holds no suggested prerequisite."""
    return _rules(edges, {"unexpected_prerequisite": F.col("source") == "suggested_prerequisite"})


def fit_history_rules(history: DataFrame, epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The best validation loss is not above the first one."""
    row = history.agg(F.min(loss).alias("_best"), F.min_by(loss, epoch).alias("_first"))
    return _rules(row, {"fit_history_missing": F.col("_best").isNull(), "fit_not_improved": F.coalesce(F.col("_best") > F.col("_first") + 1e-8, F.lit(False))})


def context_rules(contexts: DataFrame, top: int = STAGE1_TOP, window: int = HISTORY_WINDOW) -> DataFrame:
    """All violations of context records, and the informative count of unsorted evidence."""
    expected = F.least(F.lit(top), F.lit(window), F.col("target_t"))
    e = F.col("evidence")
    any_item = lambda cond: F.coalesce(F.exists(e, cond), F.lit(False))
    ranks = F.transform(e, lambda x: x["rank"])
    positions = F.transform(e, lambda x: x["history_pos"])
    return _rules(
        contexts,
        {
            "stage1_count": F.col("stage1_count") != expected,
            "selected_count": F.col("selected_count") != F.least(F.lit(SELECTED_TOP), F.col("stage1_count")),
            "summary_header": F.col("main_context_text").contains(HEADER),
            "template_without_summary": ~F.col("template_context_text").contains(F.col("summary.summary_text")),
            "rank_not_dense": (F.size(e) > 0) & (ranks != F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1)))),
            "unknown_role": any_item(lambda x: ~x["role"].isin(*ROLE_LABELS.values())),
            "support_decimals": any_item(lambda x: ~x["support_score"].rlike(r"\.[0-9]{4}$")),
            "question_too_long": any_item(lambda x: F.length(x["question_text"]) > TRUNCATE_AT + len(ELLIPSIS)),
            "ellipsis_missing": any_item(lambda x: (F.length(x["question_text"]) > TRUNCATE_AT) & ~x["question_text"].endswith(ELLIPSIS)),
            "not_time_sorted": positions != F.sort_array(positions),
        },
    )


INFORMATIVE = ("not_time_sorted",)


def vector_rules(contexts: DataFrame, vectors: DataFrame, kinds: list[str], keys: tuple[str, ...] = ("user_id", "target_t")) -> DataFrame:
    """Each vector kind covers every context exactly once and nothing else."""
    out = []
    for kind in kinds:
        mine = vectors.filter(F.col("kind") == kind).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        both = contexts.select(*keys, F.lit(1).alias("_c")).join(mine, list(keys), "full_outer")
        out.append(
            _rules(
                both,
                {
                    f"{kind}_missing": F.col("_n").isNull(),
                    f"{kind}_unknown": F.col("_c").isNull(),
                    f"{kind}_repeated": F.coalesce(F.col("_n") > 1, F.lit(False)),
                },
            )
        )
    return reduce(DataFrame.unionByName, out)


def coverage_rules(contexts: DataFrame, summary: str = "llm_summary_text", context: str = "llm_context_text") -> DataFrame:
    """Summaries exist for all contexts or none, are valid, and come with their context text."""
    has = F.trim(F.coalesce(F.col(summary), F.lit(""))) != ""
    row = contexts.agg(F.sum(has.cast("bigint")).alias("_with"), F.count(F.lit(1)).alias("_all"))
    partial = _rules(row, {"summary_partial_coverage": (F.col("_with") > 0) & (F.col("_with") < F.col("_all"))})
    return partial.unionByName(
        _rules(contexts, {"summary_invalid": has & summary_error(F.col(summary)).isNotNull(), "summary_context_missing": has & (F.trim(F.coalesce(F.col(context), F.lit(""))) == "")})
    )


def alignment(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("user_id", "pos")) -> DataFrame:
    """Rows of two keyed tables without a partner, and users whose lengths differ."""
    a = left.select(*keys, F.lit(1).alias("_a"))
    b = right.select(*keys, F.lit(1).alias("_b"))
    rows = _rules(a.join(b, list(keys), "full_outer"), {"only_left": F.col("_b").isNull(), "only_right": F.col("_a").isNull()})
    la, lb = (t.groupBy(keys[0]).agg(F.count(F.lit(1)).alias(n)) for t, n in ((left, "_na"), (right, "_nb")))
    lengths = _rules(la.join(lb, keys[0], "full_outer"), {"length_differs": ~F.col("_na").eqNullSafe(F.col("_nb"))})
    return rows.unionByName(lengths)


def report(*rule_tables: DataFrame) -> DataFrame:
    """(rule, violations, passed) of all checks; informative rules always pass."""
    rules = reduce(DataFrame.unionByName, rule_tables)
    passed = (F.col("violations") == 0) | F.col("rule").isin(*INFORMATIVE)
    return rules.withColumn("passed", passed.cast("bigint"))
