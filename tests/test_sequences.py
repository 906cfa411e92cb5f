"""Positions, frames, chunks and layouts, including long users and shuffled input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import full_history as FH
from tracelake.operators import sequences as S
from tracelake.plans import ranks
from tracelake.plans.frames import history
from tracelake.sources import readers as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One user holds a third of all rows and most of its logs share one time."""
    rng = random.Random(1)
    rows = [("hot", rng.choice([0, 0, 0, 5, 9]), f"l{i:05d}", f"p{i % 7}", i % 2) for i in range(600)]
    rows += [(f"u{i % 40}", rng.randrange(50), f"m{i:05d}", f"p{i % 11}", i % 3 % 2) for i in range(1200)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "user_id string, submit_time int, log_id string, problem_id string, is_correct int")


def expected_positions(rows):
    users = {}
    for r in rows:
        users.setdefault(r.user_id, []).append((r.submit_time, r.log_id))
    return {(u, log): k for u, logs in users.items() for k, (_, log) in enumerate(sorted(logs))}


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_of_a_skewed_key(skewed, partitions):
    got = ranks.positions(skewed.repartition(partitions), ["user_id"], ["submit_time", "log_id"]).collect()
    assert {(r.user_id, r.log_id): r.pos for r in got} == expected_positions(skewed.collect())


def test_global_rank_and_prefix_sum(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.v == r["rank"] for r in ranks.global_rank(df, ["v"]).collect())
    assert all(r.cum_v == r.v * (r.v + 1) // 2 for r in ranks.global_prefix_sum(df, ["v"], ["v"]).collect())


@pytest.mark.parametrize("block", [4, 1024])
def test_history_frames_cross_blocks(skewed, block):
    from tracelake.plans.frames import look_back

    rows = ranks.positions(skewed, ["user_id"], ["submit_time", "log_id"])
    got = look_back(rows, {"h": (F.collect_list("pos"), 20)}, block=max(block, 20)).collect()
    assert len(got) == 1800
    assert all(r.h == list(range(max(0, r.pos - 20), r.pos)) for r in got)
    sizes = {r.pos: len(r.history) for r in history(rows.filter("user_id = 'hot'"), 20, ["pos"]).collect() if r.pos in (0, 1, 20, 21)}
    assert sizes == {0: 0, 1: 1, 20: 20, 21: 20}


def test_dense_position_drops_unknown_and_short(spark):
    logs = spark.createDataFrame([("a", 1, "x", "k"), ("a", 2, "y", "?"), ("a", 3, "z", "k"), ("b", 1, "w", "k")], "user_id string, submit_time int, log_id string, problem_id string")
    catalog = spark.createDataFrame([("k",)], "problem_id string")
    got = S.dense_position(logs, catalog, order=["submit_time", "log_id"]).collect()
    assert sorted((r.user_id, r.log_id, r.pos) for r in got) == [("a", "x", 0), ("a", "z", 1)]


def test_chunk_edges(spark):
    for length, chunks in ((1, 1), (5, 1), (6, 1), (7, 2)):
        rows = spark.createDataFrame([("u", i, i, 1) for i in range(length)], "user_id string, pos int, q int, m int")
        got = S.chunk_plus_one(rows, 5, ["q"], ["m"]).orderBy("chunk").collect()
        assert len(got) == chunks and all(len(r.q) == 6 for r in got)
        assert [x for r in got for x in r.q if x != -1] == list(range(length))
        assert sum(sum(r.m) for r in got) == length
    assert S.chunk_steps(rows, ["q"], 6).count() == 1


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(q, a) for q in (1, 2, 3) for a in (0, 1)], "q int, a int").withColumn("x", S.interaction_code(F.col("q"), F.col("a"), 3))
    assert all(r.a == r.d for r in df.withColumn("d", S.decode_answer(F.col("x"), 3)).collect())
    assert df.select(S.decode_answer(F.lit(0), 3).alias("d")).first().d == -1


def test_running_count_across_blocks(skewed, monkeypatch):
    monkeypatch.setattr(S, "COUNT_BLOCK", 16)
    rows = ranks.positions(skewed, ["user_id"], ["submit_time", "log_id"])
    got = S.running_count(rows, F.col("is_correct") == 1, "n").orderBy("user_id", "pos").collect()
    seen = {}
    for r in got:
        assert r.n == seen.get(r.user_id, 0)
        seen[r.user_id] = r.n + r.is_correct


def test_band_and_distance_match_numpy(spark):
    from tracelake.operators.similarity import add_band

    rng = np.random.default_rng(0)
    rows = [(u, p, rng.normal(size=4).tolist()) for u, n in (("a", 70), ("b", 3), ("c", 1)) for p in range(n)]
    vec = {(u, p): np.asarray(v) for u, p, v in rows}
    df = spark.createDataFrame(rows, "user_id string, pos int, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = add_band(df, 5, lead=10, block=12).filter(~F.col("lead")).withColumn("dtc", S.distances(F.col("band"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 74
    for r in got:
        sims = [vec[r.user_id, j] @ vec[r.user_id, r.pos] for j in range(max(0, r.pos - 5), r.pos)]
        assert r.band == pytest.approx(sims)
        away = [1 - max(-1, min(1, s)) for s in sims]
        assert r.dtc == pytest.approx([1 + sum(away[k + 1 :]) for k in range(len(away))])


def test_shared_vectors_are_looked_up_after_the_shuffle(spark, monkeypatch):
    from tracelake.plans import frames

    rng = np.random.default_rng(4)
    rows = [(u, p, int(rng.integers(0, 6)), int(rng.integers(0, 9)), p % 2) for u, n in (("a", 70), ("b", 3), ("c", 1)) for p in range(n)]
    logs = spark.createDataFrame(rows, "user_id string, pos int, level int, vec_id long, is_correct int")
    known = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(8)], "vec_id long, vec array<double>")
    vectors = S.unit_vectors(known)
    joined = logs.join(vectors, "vec_id").drop("vec_id")
    monkeypatch.setattr(S.stack, "sorted_blocks", lambda df, n, **k: frames.sorted_blocks(df, n, block=12, **k))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")

    def results(rows, **given):
        band = S.similarity_band(rows, 5, ["pos", "level"], **given).select("user_id", "pos", "history", "band")
        state = S.attention_state(rows, 5, **given).select("user_id", "pos", "state_vec", "state_lower")
        signed = S.diagnostic_state(rows, 5, **given).select("user_id", "pos", "e_diag", "vec")
        return [sorted(map(tuple, df.collect())) for df in (band, state, signed)]

    try:
        want = results(joined)
        assert results(logs, vectors=vectors) == want
        plan = S.attention_state(logs, 5, vectors=vectors)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin [vec_id" in plan
        monkeypatch.setattr(frames, "VECTOR_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert results(logs, vectors=vectors) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by = {(u, p): h for u, p, h, _ in want[0]}
    mine = {u: sorted((p, lv) for x, p, lv, v, _ in rows if x == u and v < 8) for u in "abc"}
    for (u, p), h in by.items():
        # The last five rows of the user that have a vector, oldest first.
        assert [tuple(x) for x in h] == [x for x in mine[u] if x[0] < p][-5:]


def test_full_history_distance(spark):
    rng = np.random.default_rng(2)
    vec = {u: rng.normal(size=(n, 4)) for u, n in (("u", 30), ("v", 1), ("w", 9))}
    vec = {u: x / np.linalg.norm(x, axis=1)[:, None] for u, x in vec.items()}
    df = spark.createDataFrame([(u, i, [float(y) for y in v]) for u, x in vec.items() for i, v in enumerate(x)], "user_id string, pos long, vec array<double>")
    got = FH.distance_sums(df, 0.05, tile=8).collect()
    assert len(got) == 29 + 8
    for r in got:
        e = np.exp(vec[r.user_id][: r.pos] @ vec[r.user_id][r.pos])
        d = [(r.pos - i) * e[i + 1 :].sum() / e.sum() for i in range(r.pos)]
        assert (r.d_sum, r.decay_sum, r.n) == (pytest.approx(sum(d)), pytest.approx(np.exp(-0.05 * np.array(d)).sum()), r.pos)


def test_old_history_for_new(spark):
    rng = random.Random(4)
    flags = [rng.random() < 0.4 for _ in range(60)]
    rows = spark.createDataFrame([("u", i, f"p{i}", f) for i, f in enumerate(flags)], "user_id string, pos int, problem_id string, is_new boolean")
    for r in S.old_history_for_new(rows, "is_new", 7, ["problem_id"]).collect():
        assert [h.problem_id for h in r.history] == [f"p{i}" for i in range(r.pos) if not flags[i]][-7:]


def test_readers_edge_cases(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"students": [{"user_id": "", "seq": [{"log_id": "b", "problem_id": "p", "is_correct": 1, "submit_time": "2020-01-02 03:04:05"},'
        ' {"log_id": "a", "user_id": "u9", "problem_id": "p", "is_correct": null, "submit_time": "2020/01/02 03:04:05"}, {"log_id": "z", "submit_time": "x"}]}]}'
    )
    got = R.read_interactions(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r.user_id, r.log_id, r.is_correct) for r in got] == [("u9", "z", None), ("u9", "b", 1), ("u9", "a", None)]
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="no list of students"):
        R.read_interactions(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.jsonl").write_text('{"key":"a","summary_text":"1"}\n{oops\n{"key":"","summary_text":"0"}\n{"key":"a","summary_text":"2"}\n')
    assert [tuple(r) for r in R.read_cache(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", "2")]
    (tmp_path / "seq.txt").write_text("5\n1,1,7,7,9,\n0,1,1,1,0\n2\n3,4\n1,0\n")
    got = R.read_sequences(spark, str(tmp_path / "seq.txt")).orderBy("seq_no").collect()
    assert [(r.q, r.a) for r in got] == [([1, 1, 7, 7, 9], [0, 1, 1, 1, 0]), ([3, 4], [1, 0])]
    (tmp_path / "items.csv").write_text('item_id,knowledge_code\n1,"[2, 3]"\n2,4\n')
    assert {r.item_id: r.knowledge_code for r in R.read_items(spark, str(tmp_path / "items.csv")).collect()} == {1: [2, 3], 2: [4]}


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = R.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert all(r.value == f"line {r.line_no}" for r in lines.collect())
        assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_onehot_with_vectors_pads_whole_samples(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1, [0.5, 0.25]), ("a", 1, 2, 0, [1.0, 0.0]), ("a", 2, 0, 0, [0.0, 2.0]), ("b", 0, 2, 1, [3.0, 4.0]), ("b", 1, 1, 0, [5.0, 6.0])], "user_id string, pos int, q int, is_correct int, vec array<double>")
    got = {(r.user_id, r.sample, r.step): (r.indices, r["values"]) for r in S.onehot_vector(rows, "q", 3, 2, "vec", 2).collect()}
    assert got == {
        ("a", 0, 0): ([1, 6, 7], [1.0, 0.5, 0.25]), ("a", 0, 1): ([5, 6, 7], [1.0, 1.0, 0.0]), ("a", 1, 0): ([3, 6, 7], [1.0, 0.0, 2.0]),
        ("a", 1, 1): ([], []), ("b", 0, 0): ([2, 6, 7], [1.0, 3.0, 4.0]), ("b", 0, 1): ([4, 6, 7], [1.0, 5.0, 6.0]),
    }
    assert S.onehot_vector(rows.limit(0), "q", 3, 2, "vec", 2).count() == 0
    for broken in (F.lit(None).cast("array<double>"), F.array(F.lit(1.0))):
        with pytest.raises(Exception, match="vector width"):
            S.onehot_vector(rows.withColumn("vec", broken), "q", 3, 2, "vec", 2).collect()


def test_positions_move_rows_once_and_write_what_is_kept(skewed, spark):
    rows = skewed.unionByName(spark.createDataFrame([(None, 1, "z", "p", 1)], skewed.schema)).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ranks.positions(rows, ["user_id"], ["submit_time", "log_id"], keep=["problem_id", "log_id"])
        assert got.columns == ["user_id", "log_id", "problem_id", "pos"]
        assert {(r.user_id, r.log_id): r.pos for r in got.collect()} == expected_positions(skewed.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
