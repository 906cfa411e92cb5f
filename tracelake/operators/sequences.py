"""Per-user ordering, look-back features, chunking and training layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import vectors as V
from tracelake.operators import stack
from tracelake.operators.similarity import add_band
from tracelake.plans.frames import history, history_rows, look_back, with_blocks
from tracelake.plans.ranks import positions

HISTORY_WINDOW = 20
DIAGNOSTIC_WINDOW = 10
ALPHA_TIME = 0.2
TIME_DECAY = 0.05
MASTERY_BETA = 0.5
COUNT_BLOCK = 1 << 16


# -- order and position ------------------------------------------------------


def known_only(logs: DataFrame, catalog: DataFrame) -> DataFrame:
    return logs.join(catalog.select("problem_id"), "problem_id", "left_semi")


def dense_position(
    logs: DataFrame,
    catalog: DataFrame | None = None,
    order: Sequence[str] = ("submit_time", "submit_time_raw", "log_id"),
    min_logs: int = 2,
) -> DataFrame:
    """Drop unknown problems, number the rest per user, drop users with too few logs."""
    kept = logs if catalog is None else known_only(logs, catalog)
    ranked = positions(kept.drop("pos"), ["user_id"], list(order))
    if min_logs <= 1:
        return ranked
    long_enough = ranked.filter(F.col("pos") == min_logs - 1).select("user_id")
    return ranked.join(long_enough, "user_id", "left_semi")


def running_count(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Number of earlier rows of the same user where ``flag`` holds.

    Counted inside blocks of positions, then offset by the totals of earlier blocks.
    """
    marked = rows.withColumn("_flag", flag.cast("int")).withColumn("_blk", F.floor(F.col("pos") / COUNT_BLOCK))
    totals = marked.groupBy("user_id", "_blk").agg(F.sum("_flag").alias("_n"))
    earlier = Window.partitionBy("user_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("user_id", "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(totals, ["user_id", "_blk"])
        .withColumn(name, (F.coalesce(F.sum("_flag").over(inside), F.lit(0)) + F.col("_skip")).cast("int"))
        .drop("_flag", "_blk", "_skip")
    )


def distinct_prefix(logs: DataFrame, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Distinct problems of each user; with ``cap`` the first so many, with ``rank`` in the order first met.

    The (user, problem) minimum combines map-side, and the rank filter is
    applied before the shuffle as well as after it, so no task sees a whole
    long user.
    """
    if cap is None:
        return logs.select("user_id", "problem_id").distinct()
    first = logs.groupBy("user_id", "problem_id").agg(F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("_first"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("_first")


def last_target(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Leave-last-out: one row per user with the last log as target."""
    last = rows.groupBy("user_id").agg(F.max(F.struct("pos", *cols)).alias("_t"))
    return last.select("user_id", F.col("_t.pos").alias("target_t"), *[F.col(f"_t.{c}").alias(f"target_{c}") for c in cols])


def recent_trajectory(rows: DataFrame, label: str, n: int = 10) -> DataFrame:
    """Adds ``trajectory``: the last ``n`` (label, outcome) pairs before each row."""
    return history(rows, n, [label, "is_correct"]).withColumnRenamed("history", "trajectory").drop("block")


def position_decay(score: Column, lag: Column, rate: float = TIME_DECAY) -> Column:
    return score * F.exp(-rate * lag)


# -- vector look-back --------------------------------------------------------


def with_item_features(rows: DataFrame, vectors: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Adds the unit item vector (and level) of each log's problem."""
    out = rows.join(vectors.select("problem_id", V.normalise(F.col("vec")).alias("vec")), "problem_id")
    if catalog is not None:
        out = out.join(catalog.select("problem_id", "level"), "problem_id")
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): the unit vectors that problems name by ``vec_id``."""
    return vectors.select("vec_id", V.normalise(F.col("vec")).alias("vec"))


TARGET = ["user_id", "block", "pos"]


def similarity_band(rows: DataFrame, n: int = HISTORY_WINDOW, cols: Sequence[str] = ("pos", "is_correct", "level"), vectors: DataFrame | None = None) -> DataFrame:
    """Adds ``history`` (last ``n`` logs) and ``band`` (similarity to each of them), oldest first, for unit vectors ``vec``.

    With ``vectors`` (vec_id, vec), rows carry ``vec_id`` instead, and no vector is shuffled with a log.
    """
    return add_band(rows, n, vectors=vectors, history=cols).filter(~F.col("lead")).drop("lead")


def history_similarity(rows: DataFrame, n: int = HISTORY_WINDOW, cols: Sequence[str] = ("pos", "is_correct", "level"), vectors: DataFrame | None = None) -> DataFrame:
    """Long history rows with ``cos``, the similarity to the target."""
    banded = similarity_band(rows, n, cols, vectors)
    zipped = F.zip_with("history", "band", lambda h, b: h.withField("cos", b))
    long = banded.withColumn("_h", F.explode(zipped)).drop("history", "band")
    return long.select("*", *[F.col(f"_h.{c}").alias(f"h_{c}") for c in cols], "_h.cos").drop("_h")


def attention_state(rows: DataFrame, n: int = HISTORY_WINDOW, vectors: DataFrame | None = None) -> DataFrame:
    """Attention-pooled history: vector part, pooled result and three level relations.

    ``rows`` need ``pos, is_correct, level, vec`` with unit vectors, or ``vec_id``
    and ``vectors`` beside them.  Without history every part is zero.
    """
    return stack.pooled_states(rows, n, attention=True, vectors=vectors)


def diagnostic_state(rows: DataFrame, n: int = DIAGNOSTIC_WINDOW, vectors: DataFrame | None = None) -> DataFrame:
    """Adds ``e_diag``, the signed attention state; a zero vector where there is no history."""
    return stack.pooled_states(rows, n, attention=False, vectors=vectors)


def mastery(correct: Column, probability: Column, beta: float = MASTERY_BETA) -> Column:
    return (1 - beta) * correct + beta * probability


def distances(band: Column) -> Column:
    """Semantic distance of each history item: 1 plus the dissimilarity of all later items."""
    away = F.transform(band, lambda x: 1.0 - V.clip(x, -1.0, 1.0))
    tail = lambda a, k: F.aggregate(F.slice(a, k + 2, F.size(a)), F.lit(1.0), lambda s, x: s + x)
    return V.let(away, lambda a: F.transform(a, lambda _, k: tail(a, k)))


def distance_time(banded: DataFrame, alpha: float = ALPHA_TIME) -> DataFrame:
    """Long rows (target, h_pos, dtc, t_decay) from :func:`similarity_band`."""
    zipped = F.zip_with("history", distances(F.col("band")), lambda h, d: F.struct(h["pos"].alias("h_pos"), d.alias("dtc")))
    long = banded.select("user_id", "pos", F.inline(zipped))
    return long.withColumn("t_decay", F.exp(-alpha * F.col("dtc")))


# -- chunks and training layouts ---------------------------------------------


def chunk(rows: DataFrame, length: int, pads: dict[str, object], min_size: int = 1) -> DataFrame:
    """One row per (user, chunk of ``length`` positions) with one array per column.

    ``pads`` maps columns to the value that fills the last chunk; None leaves it short.
    A stride of ``length`` never opens an empty chunk on an exact multiple.
    """
    cols = list(pads)
    grouped = (
        rows.withColumn("chunk", F.floor(F.col("pos") / length).cast("int"))
        .groupBy("user_id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *cols))).alias("_rows"))
        .withColumn("size", F.size("_rows"))
        .filter(F.col("size") >= min_size)
    )
    out = grouped.select("user_id", "chunk", "size", *[F.col(f"_rows.{c}").alias(c) for c in cols])
    for c, pad in pads.items():
        if pad is not None:
            filler = F.lit(pad) if not isinstance(pad, Column) else pad
            out = out.withColumn(c, F.concat(c, F.array_repeat(filler, F.lit(length) - F.col("size"))))
    return out


def chunk_plus_one(rows: DataFrame, length: int, ids: Sequence[str], zeros: Sequence[str] = ()) -> DataFrame:
    """Chunks of ``length + 1``: ids padded with -1, masks with 0."""
    return chunk(rows, length + 1, {**{c: -1 for c in ids}, **{c: 0 for c in zeros}})


def chunk_steps(rows: DataFrame, cols: Sequence[str], step: int = 200) -> DataFrame:
    """Unpadded chunks; those with fewer than two items are dropped."""
    return chunk(rows, step, {c: None for c in cols}, min_size=2)


def shift_arrays(chunks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inputs ``x[:-1]`` and targets ``x[1:]`` of chunk arrays."""
    out = chunks
    for c in cols:
        n = F.size(c)
        out = out.withColumn(f"{c}_in", F.slice(c, F.lit(1), n - 1)).withColumn(f"{c}_out", F.slice(c, F.lit(2), n - 1))
    return out


def shift_rows(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form of the shift: each row with the previous row's values as ``prev_<c>``."""
    out = look_back(rows, {f"prev_{c}": (F.first(c), 1) for c in cols})
    return out.filter(F.col("pos") > 0).drop("block")


def pad_batches(samples: DataFrame, batch: str, ids: str, targets: str, eval_mask: str | None = None, pad: int = -1) -> DataFrame:
    """Pad id and target arrays to the longest of their batch and add the mask.

    The mask is 1 where both ids are present (and the eval mask allows it);
    masked cells become 0.
    """
    longest = samples.groupBy(batch).agg(F.max(F.size(ids)).alias("_max"))
    out = samples.join(longest, batch)

    def filled(c: str, value: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(value), F.col("_max") - F.size(c)))

    out = out.withColumn(ids, filled(ids, pad)).withColumn(targets, filled(targets, pad))
    present = F.zip_with(ids, targets, lambda a, b: ((a != pad) & (b != pad)).cast("int"))
    if eval_mask:
        present = F.zip_with(present, filled(eval_mask, 0), lambda a, b: a * b)
    out = out.withColumn("mask", present)
    for c in (ids, targets):
        out = out.withColumn(c, F.zip_with(c, "mask", lambda a, m: F.when(m == 1, a).otherwise(0)))
    return out.drop("_max")


def onehot_sparse(rows: DataFrame, question: str, n_questions: Column | int, max_step: int, correct_first: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Sparse one-hot rows (user, sample, step, index) of width ``2 n``, with the columns ``keep``.

    ``index`` is q for a correct answer and q + n otherwise, or the other way
    round with ``correct_first=False``.  Padding steps have no row.
    """
    q, n = F.col(question), F.lit(n_questions) if isinstance(n_questions, int) else n_questions
    first_half = (F.col("is_correct") == 1) if correct_first else (F.col("is_correct") == 0)
    return rows.select(
        "user_id",
        F.floor(F.col("pos") / max_step).cast("int").alias("sample"),
        (F.col("pos") % max_step).cast("int").alias("step"),
        F.when(first_half, q).otherwise(q + n).cast("int").alias("index"),
        *keep,
    )


def onehot_vector(rows: DataFrame, question: str, n_questions: Column | int, max_step: int, vec: str, dim: int) -> DataFrame:
    """One-hot rows with a vector behind them, one per step of whole samples of ``max_step`` steps.

    ``size``, ``indices`` and ``values`` are the layout of a sparse vector of width ``2 n + dim``: the one-hot cell, then
    the ``dim`` components of ``vec``.  Steps after a user's last log pad its last sample; they have no cells.  A vector
    that is null or of another width is an error, as a step without one would shift all features after it.
    """
    n = F.lit(n_questions) if isinstance(n_questions, int) else n_questions
    hot = onehot_sparse(rows, question, n, max_step, keep=[vec])
    width = F.when(F.col(vec).isNull(), F.lit(-1)).otherwise(F.size(vec))
    wrong = F.raise_error(F.concat(F.lit(f"vector width is not {dim} but "), width.cast("string"))).cast("array<float>")
    checked = F.when(width == dim, F.col(vec).cast("array<float>")).otherwise(wrong)
    behind = F.slice(F.sequence((2 * n).cast("int"), (2 * n + dim).cast("int")), 1, dim)
    cells = F.concat(F.array("index"), behind)
    ones = F.concat(F.array(F.lit(1.0).cast("float")), checked)
    full = hot.select("user_id", "sample", "step", cells.alias("indices"), ones.alias("values"))
    last = rows.groupBy("user_id").agg(F.max("pos").alias("_last")).filter((F.col("_last") + 1) % max_step != 0)
    missing = F.sequence((F.col("_last") % max_step + 1).cast("int"), F.lit(max_step - 1))
    padding = last.select("user_id", F.floor(F.col("_last") / max_step).cast("int").alias("sample"), F.explode(missing).alias("step"))
    padding = padding.withColumns({"indices": F.array().cast("array<int>"), "values": F.array().cast("array<float>")})
    return full.unionByName(padding).withColumn("size", (2 * n + dim).cast("int"))


def interaction_code(q: Column, a: Column, n: Column | int, variant: str = "offset") -> Column:
    """Question and answer as one id; ``q`` is 1-based for ``offset``."""
    n = F.lit(n) if isinstance(n, int) else n
    if variant == "offset":
        return q + n * a
    if variant == "interleaved":
        return 2 * q + a
    if variant == "correct_first":
        return F.when(a == 1, q).otherwise(q + n)
    raise ValueError(f"unknown variant {variant!r}")


def decode_answer(x: Column, n: Column | int) -> Column:
    """Answer of an ``offset`` code; padding (0) decodes below -0.9 and is to be filtered."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor((x - 1) / n)


def zero_lead_in(value: Column, zero: Column, pos: Column) -> Column:
    """The first position of a sequence carries no context."""
    return F.when(pos == 0, zero).otherwise(value)


def old_history_for_new(rows: DataFrame, is_new: str, length: int, cols: Sequence[str]) -> DataFrame:
    """Targets flagged ``is_new`` with their last ``length`` earlier rows that are not.

    Old rows are packed into arrays of ``length`` by their rank among the old
    rows; a target reads its own pack and the one before, so neither side
    forms a group longer than ``length``.
    """
    ranked = running_count(rows, ~F.col(is_new), "old_before")
    packs = (
        ranked.filter(~F.col(is_new))
        .withColumn("pack", F.floor(F.col("old_before") / length))
        .groupBy("user_id", "pack")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("old_before").alias("k"), "pos", *[c for c in cols if c != "pos"]))).alias("items"))
    )
    targets = ranked.filter(F.col(is_new)).withColumn("pack", F.floor(F.col("old_before") / length))
    here = packs.withColumnRenamed("items", "_here")
    before = packs.select("user_id", (F.col("pack") + 1).alias("pack"), F.col("items").alias("_before"))
    joined = targets.join(here, ["user_id", "pack"], "left").join(before, ["user_id", "pack"], "left")
    empty = F.slice(F.coalesce("_here", "_before"), 1, 0)
    both = F.concat(F.coalesce("_before", empty), F.coalesce("_here", empty))
    return joined.withColumn(
        "history",
        F.filter(both, lambda x: (x["k"] < F.col("old_before")) & (x["k"] >= F.col("old_before") - length)),
    ).drop("_here", "_before", "pack")


def renest(rows: DataFrame, values: DataFrame, value: str, missing: Column) -> DataFrame:
    """Per-user chunks of ``value`` in position order, gaps filled with ``missing``."""
    joined = rows.select("user_id", "pos").join(values.select("user_id", "pos", value), ["user_id", "pos"], "left")
    return chunk(joined.withColumn(value, F.coalesce(F.col(value), missing)), 1024, {value: None})


__all__ = [n for n in dir() if not n.startswith("_")]
