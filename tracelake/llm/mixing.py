"""Mixing sources to target weights along a curriculum that changes over training.

Each source has a weight schedule, piecewise linear over training time 0 to 1.  Its integral is the source's weight in
the whole mix.  Targets share the budget by these weights, up to ``repeats`` times a source's own words; what is over is
shared again by weight among the rest.  Cumulative demand of a source at time t is its target times the share of the
integral up to t.  The documents of a source stand in a seeded hash order; the words before a copy of a document are
where its demand begins, and inverting the demand gives the copy's training position.  Documents are range-sorted by
position.

Edge cases: a null text has no words; a null source is a source, ordered last; a source without words has target 0 and
position-less documents; where the copy in which the demand ends is cut, it gives the words up to that end, otherwise
the copy is whole if its middle lies before the end; rows that are equal in every ordering column are interchangeable;
an empty table gives no rows.  Input columns starting with ``_`` are reserved, and
those called size, source_size, target, taken, position or words are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import n_words, null_safe, ranged, run_offsets
from tracelake.session import materialise

Knots = Sequence[tuple[float, float]]

#: Schedules by turns: weight 1 grows towards the end, weight 2 is level, weight 3 fades.
CURRICULUM: tuple[Knots, ...] = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)),
)


def integral(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def inverse_demand(share: Column, knots: Knots) -> Column:
    """The time at which a schedule has given ``share`` (0 to 1) of its integral.

    In a piece that starts at t0 with weight w and slope s, the area y is reached after 2y / (w + sqrt(w^2 + 2sy)).
    """
    total = integral(knots)
    out, start = F.lit(knots[-1][0]), 0.0
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        if area > 0:
            y = share * total - F.lit(start)
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * y, F.lit(0.0)))
            time = F.lit(t0) + F.when(y > 0, 2 * y / (F.lit(w0) + root)).otherwise(F.lit(0.0))
            pieces.append(((start + area) / total, F.least(time, F.lit(t1))))
            start += area
    for end, time in reversed(pieces):
        out = F.when(share <= end, time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Knots], budget: float, repeats: int) -> DataFrame:
    """``source``, ``source_size``, ``_turn`` (which schedule) and ``target`` of each row (source, source_size).

    Filling up to the caps: with sources sorted by cap per weight, the first k are capped, and the level of the others is
    what is left of the budget by what is left of the weights.  The level that holds is the one at or under the next
    source's ratio, the highest such.  Both orders are by ranges, with running sums, so that many sources need no single task.
    """
    first = ranged(sizes, [F.col("source").asc_nulls_last()])
    places = run_offsets(first.withColumn("_all", F.lit(0)), ["_all"], {"n": F.count(F.lit(1))}).drop("_all")
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    turned = (
        first.join(places, "_part")
        .withColumn("_turn", ((F.col("_row") - F.col("_lo") + F.col("_before_n")) % len(schedules)).cast("int"))
        .drop("_part", "_row", "_lo", "_before_n")
        .withColumn("_weight", F.element_at(weights, F.col("_turn") + 1))
        .withColumn("_cap", F.col("source_size") * repeats)
    )
    order = [F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()]
    lined = ranged(turned, order).withColumn("_all", F.lit(0))
    before = run_offsets(lined, ["_all"], {"cap": F.sum("_cap"), "weight": F.sum("_weight")}).drop("_all", "_lo")
    earlier = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    totals = turned.agg(F.sum("source_size").alias("_size"), F.sum("_weight").alias("_weights"))
    levels = (
        lined.join(before, "_part")
        .crossJoin(F.broadcast(totals))  # one row
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(earlier), F.lit(0)) + F.col("_before_cap"))
        .withColumn("_gone", F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)) + F.col("_before_weight"))
        .withColumn("_level", (F.col("_size") * budget - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
    )
    level = levels.filter(F.col("_level") <= F.col("_cap") / F.col("_weight")).agg(F.max("_level").alias("_level"))
    return turned.crossJoin(F.broadcast(level)).select(  # one row
        "source",
        "source_size",
        "_turn",
        F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double"))).alias("target"),
    )


def plan(
    docs: DataFrame,
    order: Sequence[Column],
    schedules: Sequence[Knots] = CURRICULUM,
    budget: float = 1.0,
    repeats: int = 3,
    cut: bool = True,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``, an array of (position, words) per copy taken.

    ``order`` is the order in a source; its first column should be a hash, so that the order is a shuffle.  ``_order`` is the position
    of the first copy, or, past 1, of where a longer training would take it.
    """
    sized = docs.withColumn("size", n_words("text") if size is None else size)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, schedules, budget, repeats))
    rows = ranged(sized, [F.col("source").asc_nulls_last(), *order], running=("source", "size"))
    offsets = run_offsets(rows, ["source"], {"size": F.sum("size")})
    placed = null_safe(rows, offsets, ["_part", "source"]).withColumn("_start", F.col("_inside") + F.col("_before_size"))
    placed = null_safe(placed, targets, ["source"])
    goal = F.round("target").cast("long")
    starts = [F.col("_start") + k * F.col("source_size") for k in range(repeats)]
    if cut:
        words = [F.greatest(F.least(goal - s, F.col("size")), F.lit(0)) for s in starts]
    else:
        words = [F.when(s + F.col("size") / 2 < goal, F.col("size")).otherwise(F.lit(0)) for s in starts]

    def position(start: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least(start / F.col("target"), F.lit(1.0))).otherwise(F.lit(1.0))
        by_turn = [inverse_demand(share, s) for s in schedules]
        out = by_turn[-1]
        for k in reversed(range(len(by_turn) - 1)):
            out = F.when(F.col("_turn") == k, by_turn[k]).otherwise(out)
        return out

    copies = F.array(*[F.struct(position(s).alias("position"), w.cast("long").alias("words")) for s, w in zip(starts, words)])
    late = 1.0 + F.coalesce(F.col("_start") / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
    return (
        placed.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
        .withColumn("taken", sum(words[1:], words[0]).cast("long"))
        .withColumn("_order", F.coalesce(F.try_element_at("copies", F.lit(1))["position"], late))
        .drop("_part", "_row", "_lo", "_inside", "_before_size", "_start", "_turn")
    )


def mixed_rows(planned: DataFrame) -> DataFrame:
    """A row per copy taken, with ``position`` and ``words``, range-sorted by position."""
    copies = planned.select("*", F.explode("copies").alias("_copy"))
    placed = copies.withColumns({"position": F.col("_copy.position"), "words": F.col("_copy.words")}).drop("_copy", "copies")
    return placed.repartitionByRange("position", "_order").sortWithinPartitions("position", "_order")


def hash_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_shuffle``, the digest of doc_id, and ``_tie`` for equal ids: together the seeded order in a source."""
    return docs.withColumns(
        {"_shuffle": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), "_tie": F.xxhash64("doc_id", "text")}
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """A row per document, range-sorted by its first training position."""
    planned = plan(
        hash_order(docs).select("doc_id", "source", n_words("text").alias("_n"), "_shuffle", "_tie"),
        [F.col("_shuffle"), F.col("_n"), F.col("_tie")],
        size=F.col("_n"),
    )
    return (
        planned.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("copies", F.lit(1))["position"].alias("position"), "_order")
        .repartitionByRange("_order", "doc_id")
        .sortWithinPartitions("_order")
        .drop("_order")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, whole, each as often as it is taken."""
    names = docs.columns
    planned = plan(hash_order(docs), [F.col("_shuffle"), F.col("_tie")], cut=False)
    return mixed_rows(planned).select(*names)
