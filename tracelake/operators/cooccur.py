"""Co-occurrence counts and Jaccard neighbours of problems and concepts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.sequences import distinct_prefix
from tracelake.plans.frames import history
from tracelake.plans.ranks import global_rank
from tracelake.session import materialise

NEIGHBOR_K = 5
#: Values of a key in one array, and problems of a user up to which all pairs are formed.
CHUNK, LIGHT = 512, 1024
#: Users of a problem in one run of rows; the problems beside it are dealt into so many parts.
RUN_USERS = 4096


def pairs_of_sorted(items: DataFrame, key: str, value: str, names: tuple[str, str] = ("a", "b"), chunk: int = CHUNK) -> DataFrame:
    """Unordered pairs ``a < b`` of the distinct values of one key.

    A key's values travel as arrays, and pairs appear only right above the aggregate that counts them.  A key of more than
    ``chunk`` values has them dealt into chunks by hash, and each two chunks meet in a row of their own, so that no array
    grows with a key.
    """
    items = items.select(key, value).filter(F.col(value).isNotNull())
    large = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
    dealt = items.join(large, key, "left").withColumn("_chunk", F.pmod(F.xxhash64(value), F.ceil(F.coalesce("_n", F.lit(1)) / chunk)))
    sets = dealt.groupBy(key, "_chunk").agg(F.sort_array(F.collect_set(value)).alias("_set"), F.first("_n").alias("_n"))
    left = sets.select(key, "_set", F.posexplode("_set").alias("_k", names[0]))
    tail = F.slice("_set", F.col("_k") + 2, F.greatest(F.size("_set"), F.lit(1)))
    inside = left.select(names[0], F.explode(tail).alias(names[1]))
    parts = sets.filter(F.col("_n").isNotNull()).select(key, "_chunk", "_set")
    across = parts.alias("l").join(parts.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._chunk") < F.col("r._chunk")))
    across = across.select(F.explode("l._set").alias("x"), F.col("r._set").alias("_other")).select("x", F.explode("_other").alias("y"))
    return inside.unionByName(across.select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1])))


def item_pairs(prefix: DataFrame) -> DataFrame:
    """Users per unordered problem pair, from distinct-problem prefixes."""
    return pairs_of_sorted(prefix, "user_id", "problem_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))


def item_support(prefix: DataFrame) -> DataFrame:
    return prefix.groupBy("problem_id").agg(F.count(F.lit(1)).alias("users"))


def item_neighbors(logs: DataFrame, order: Sequence[str], k: int = NEIGHBOR_K, cap: int | None = None, light: int = LIGHT) -> DataFrame:
    """(problem_id, rank, neighbor_id, score): the ``k`` problems with the highest user Jaccard.

    With ``cap``, the measure is over the first ``cap`` distinct problems of each user.

    If no user has more than ``light`` problems, each user's problems travel once to each of them and are counted there
    (:func:`_counted_at_problems`); no pair is shuffled.

    Else users of at most ``light`` problems give pairs, which are counted.  The counts alone bound scores from below, so a
    problem's k-th of these is a threshold.  A problem that reaches it shares so many users that one of them is among the
    problem's first users, light ones taken first (prefix filter); only where these reach into the others, more pairs are
    looked up.  The users left out are added for those pairs whose sizes let them still reach the threshold.  So a user
    with very many problems gives no pairs of his own, and no result is lost.
    """
    # Pairs are counted by hashed ids; names come back with the supports.
    prefix = materialise(distinct_prefix(logs, order, cap).select("user_id", "problem_id", F.xxhash64("problem_id").alias("_id")))
    support = prefix.groupBy("_id", "problem_id").agg(F.count(F.lit(1)).alias("_n"))
    heavy = materialise(prefix.groupBy("user_id").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > light))
    if not heavy.limit(1).count():
        return _counted_at_problems(prefix.select("user_id", "problem_id"), k)
    few = prefix.join(heavy, "user_id", "left_anti")
    pairs = pairs_of_sorted(few, "user_id", "_id", ("_a", "_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("inter"))
    for side in ("a", "b"):
        pairs = pairs.join(support.select(F.col("_id").alias(f"_{side}"), F.col("problem_id").alias(side), F.col("_n").alias(f"_n{side}")), f"_{side}")
    ends = [F.struct(F.col(x).alias("problem_id"), F.col(f"_n{x}").alias("n_p"), F.col(y).alias("neighbor_id"), F.col(f"_n{y}").alias("n_q")) for x, y in ("ab", "ba")]
    both = pairs.select("inter", F.explode(F.array(*ends)).alias("_e")).select("_e.*", "inter")
    both = _with_heavy_users(both, prefix.join(heavy, "user_id").select("user_id", "_size", "problem_id"), support, k)
    return _best(both, k).select("problem_id", "rank", "neighbor_id", "score")


def _steps(ids: Column) -> Column:
    """Sorted numbers below 2**30 as the steps between them: a short each, or two from 2**15 on, the first negative."""
    step = F.transform(ids, lambda x, i: x - F.when(i > 0, F.get(ids, i - 1)).otherwise(0))
    split = F.transform(step, lambda d: F.when(d < 1 << 15, F.array(d)).otherwise(F.array(-F.shiftright(d, 15) - 1, d.bitwiseAND((1 << 15) - 1))))
    return F.flatten(split).cast("array<short>")


def _numbers(steps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List and value of every number of the lists made by :func:`_steps`."""
    row = np.repeat(np.arange(len(steps)), pc.list_value_length(steps).to_numpy(zero_copy_only=False))
    flat = steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    high = flat < 0
    step = np.where(high, 0, flat)
    step[1:] += np.where(high[:-1], (-flat[:-1] - 1) << 15, 0)
    row, step = row[~high], step[~high]
    total = np.cumsum(step)
    return row, total - (total - step)[np.searchsorted(row, row)]


def _counted_at_problems(prefix: DataFrame, k: int) -> DataFrame:
    """:func:`item_neighbors` of users of few problems, from their distinct (user_id, problem_id).

    Problems are numbered by support and name, so the supports of all numbers are told by the first number of each support
    (their count grows with the root of the rows), and numbers of one support are in the order of names.
    Lists travel as steps between sorted numbers, where there are fewer than 2**30 problems.
    """
    ids = materialise(global_rank(prefix.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")), ["n", "problem_id"], "id").withColumn("id", F.col("id").cast("int")))
    levels = ids.groupBy("n").agg(F.min("id").alias("first")).orderBy("first").toArrow()
    packed = ids.agg(F.max("id")).first()[0] or 0
    pack = _steps if packed < 1 << 30 else lambda x: x
    told = prefix.sparkSession.sparkContext.broadcast(tuple(levels.column(c).to_numpy().astype(np.int64) for c in ("first", "n")))
    sets = prefix.join(ids, "problem_id").groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.collect_list(F.struct("id", "n")).alias("_p"))
    each = sets.select("ids", pack(F.col("ids")).alias("packed"), F.explode("_p").alias("_p"))
    each = each.select(F.col("_p.id").alias("p"), F.ceil(F.col("_p.n") / RUN_USERS).cast("int").alias("_parts"), "ids", "packed")
    parts = each.select("p", "_parts", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "ids", "packed")
    own = F.when(F.col("_parts") > 1, pack(F.filter("ids", lambda q: q % F.col("_parts") == F.col("part")))).otherwise(F.col("packed"))
    runs = parts.select("p", "part", own.alias("ids")).repartition("p", "part").sortWithinPartitions("p", "part")

    def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if packed < 1 << 30:
            return _numbers(lists)
        return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def supports(numbers: np.ndarray) -> np.ndarray:
        first, n = told.value
        return n[np.searchsorted(first, numbers, "right") - 1]

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        p, part = (table.column(c).to_numpy().astype(np.int64) for c in ("p", "part"))
        starts = np.concatenate([[True], (p[1:] != p[:-1]) | (part[1:] != part[:-1])])
        number, head = np.cumsum(starts) - 1, p[starts]
        row, q = unpacked(table.column("ids").combine_chunks())
        run = number[row]
        other = q != head[run]
        pair, inter = np.unique(run[other] << 32 | q[other], return_counts=True)
        run, q = pair >> 32, pair & 0xFFFFFFFF
        n_q = supports(q)
        score = inter / (supports(head)[run] + n_q - inter)
        order = np.lexsort((q, -score, run))
        run, q, n_q, score = run[order], q[order], n_q[order], score[order]
        first = np.searchsorted(run, np.arange(len(head)))
        last = np.searchsorted(run, np.arange(len(head)), "right") - 1
        floor = score[np.minimum(first + k - 1, last)[run]] if len(run) else score
        # Of equal scores and supports the first names are enough; equal scores of other supports may come before them.
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (score[1:] != score[:-1]) | (n_q[1:] != n_q[:-1])
        at = np.arange(len(run))
        kept = (score >= floor) & (at - np.maximum.accumulate(np.where(new, at, 0)) < k)
        return pa.RecordBatch.from_arrays([pa.array(head[run[kept]], pa.int32()), pa.array(q[kept], pa.int32()), pa.array(score[kept])], ["p", "q", "score"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            p, part = (batch.column(c).to_numpy() for c in ("p", "part"))
            cut = int(np.nonzero((p != p[-1]) | (part != part[-1]))[0].max(initial=-1)) + 1
            if held and (cut or any(held[0].column(c)[0] != batch.column(c)[0] for c in ("p", "part"))):
                yield best([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield best([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield best(held)

    found = runs.mapInArrow(over, "p int, q int, score double")
    for side, name in (("p", "problem_id"), ("q", "neighbor_id")):
        found = found.join(ids.select(F.col("id").alias(side), F.col("problem_id").alias(name)), side)
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("score"), "neighbor_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("problem_id", "rank", "neighbor_id", "score")


def _best(both: DataFrame, k: int) -> DataFrame:
    scored = both.withColumn("score", F.col("inter") / (F.col("n_p") + F.col("n_q") - F.col("inter")))
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.desc("score"), "neighbor_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_heavy_users(both: DataFrame, held: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """``both`` with the users of ``held`` counted too, for all pairs that can be among the ``k`` best of their first problem."""
    both = materialise(both)
    sizes = support.select("problem_id", F.col("_n").alias("n")).join(held.groupBy("problem_id").agg(F.count(F.lit(1)).alias("held")), "problem_id", "left")
    floors = _best(both, k).filter(F.col("rank") == k).select("problem_id", F.col("score").alias("floor"))
    sizes = sizes.join(floors, "problem_id", "left").fillna(0, ["held"]).fillna(0.0, ["floor"])
    # Users of a problem that must be looked up so that none who reaches the floor is missed; light ones come first.
    sizes = materialise(sizes.withColumn("more", F.col("n") - F.ceil(F.col("floor") * F.col("n") - 1e-9) + 1 - (F.col("n") - F.col("held"))))
    place = F.row_number().over(Window.partitionBy("problem_id").orderBy("_size", "user_id"))
    first = held.join(sizes.filter(F.col("more") > 0).select("problem_id", "more"), "problem_id").withColumn("_place", place).filter(F.col("_place") <= F.col("more"))
    found = first.select("user_id", "problem_id").join(held.select("user_id", F.col("problem_id").alias("neighbor_id")), "user_id")
    found = found.filter(F.col("problem_id") != F.col("neighbor_id")).select("problem_id", "neighbor_id").distinct()
    known = both.select("problem_id", "neighbor_id", "inter").unionByName(found.withColumn("inter", F.lit(0).cast("long")))
    known = known.groupBy("problem_id", "neighbor_id").agg(F.sum("inter").alias("inter"))
    p = sizes.select("problem_id", F.col("n").alias("n_p"), F.col("held").alias("held_p"), "floor")
    q = sizes.select(F.col("problem_id").alias("neighbor_id"), F.col("n").alias("n_q"), F.col("held").alias("held_q"))
    most = F.col("inter") + F.least("held_p", "held_q")
    able = known.join(p, "problem_id").join(q, "neighbor_id").filter(most >= F.col("floor") * (F.col("n_p") + F.col("n_q") - most) - 1e-9)
    able = materialise(able.select("problem_id", "neighbor_id", "n_p", "n_q", "inter"))
    shared = able.select("problem_id", "neighbor_id").join(held.select("problem_id", "user_id"), "problem_id")
    shared = shared.join(held.select(F.col("problem_id").alias("neighbor_id"), "user_id"), ["neighbor_id", "user_id"]).groupBy("problem_id", "neighbor_id").agg(F.count(F.lit(1)).alias("_more"))
    full = able.join(shared, ["problem_id", "neighbor_id"], "left").withColumn("inter", F.col("inter") + F.coalesce("_more", F.lit(0)))
    return full.drop("_more").filter(F.col("inter") > 0)


def fill_neighbors(neighbors: DataFrame, catalog: DataFrame, labels: DataFrame, k: int = NEIGHBOR_K) -> DataFrame:
    """Lists shorter than ``k`` take problems with the same label, in catalog order.

    A list needs at most ``k`` candidates beyond itself and its own members,
    so the first ``2k + 1`` problems of a label always suffice: the rank filter
    keeps that many per label and no pair of a large label is ever formed.
    """
    listed = neighbors.select("problem_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "score")
    listed = listed.filter(F.col("problem_id") != F.col("neighbor_id")).join(
        catalog.select(F.col("problem_id").alias("neighbor_id")), "neighbor_id", "left_semi"
    )
    have = listed.groupBy("problem_id").agg(F.collect_set("neighbor_id").alias("_have"))
    short = (
        catalog.select("problem_id")
        .join(have, "problem_id", "left")
        .filter(F.coalesce(F.size("_have"), F.lit(0)) < k)
        .join(labels.filter(F.col("semantic_id") != "").select("problem_id", "semantic_id"), "problem_id")
    )
    in_catalog = labels.filter(F.col("semantic_id") != "").join(catalog.select("problem_id"), "problem_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("semantic_id").orderBy("problem_id"))
    heads = in_catalog.withColumn("place", place).filter(F.col("place") <= 2 * k + 1)
    extra = (
        short.join(heads.select("semantic_id", "place", F.col("problem_id").alias("neighbor_id")), "semantic_id")
        .filter((F.col("problem_id") != F.col("neighbor_id")) & ~F.coalesce(F.array_contains("_have", F.col("neighbor_id")), F.lit(False)))
        .select("problem_id", "neighbor_id", F.lit(0.0).alias("score"), F.lit("label").alias("origin"), "place")
    )
    union = listed.select("problem_id", "neighbor_id", "score", F.lit("jaccard").alias("origin"), F.col("rank").alias("place")).unionByName(extra)
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy("origin", "place"))
    return union.withColumn("rank", rank).filter(F.col("rank") <= k).drop("place")


def concept_pairs(catalog: DataFrame) -> DataFrame:
    """Problems per unordered pair of distinct concepts."""
    exploded = catalog.select("problem_id", F.explode("concepts").alias("concept"))
    return pairs_of_sorted(exploded, "problem_id", "concept").groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def windowed_concept_pairs(rows: DataFrame, catalog: DataFrame, width: int = 10) -> DataFrame:
    """Log pairs at most ``width`` apart, counted per unordered pair of different concepts.

    ``rows`` carry positions among known problems.  The earlier concepts are
    tallied inside the row's bounded window array before anything is shuffled.
    """
    known = rows.join(catalog.select("problem_id", F.array_distinct("concepts").alias("concepts")), "problem_id")
    framed = history(known, width, ["concepts"])
    each = framed.select(
        F.explode("concepts").alias("_x"), F.flatten(F.col("history.concepts")).alias("_earlier")
    ).select("_x", F.explode("_earlier").alias("_y"))
    return (
        each.filter(F.col("_x") != F.col("_y"))
        .groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
