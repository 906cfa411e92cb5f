import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, pack string"


def brute(rows, every):
    """rows: (vec_id, vector, label) of usable rows; all results, each anchor row on its own."""
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows]
    out = []
    for i, v, y in whole:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in whole if j != i and len(w) == len(v)]
        for ps, j in sorted((s, j) for s, j, z in scored if z == y)[:5]:
            inside = sorted((s, n) for s, n, z in scored if z != y and 30 * -ps <= 100 * -s <= 90 * -ps)[:10]
            out += [(i, j, k + 1, n, -ps, -s) for k, (s, n) in enumerate(inside)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_small_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 4 * 24 * 70)
    monkeypatch.setattr(negatives, "PACK_BYTES", 4 * 24 * 20)
    monkeypatch.setattr(negatives, "SEGMENT", 5)
    monkeypatch.setattr(negatives, "TOGETHER", 7)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 24))
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + rng.standard_normal(24)) * (0.02 if k % 11 else 3)], 0 if k % 3 == 0 else k % 6) for k in range(700)]
    rows += [(k, rows[0][1], k % 4) for k in range(700, 760)]  # copies of one vector
    rows += [(3, rows[8][1], 0), (20, rows[9][1], 1), (20, rows[9][1], 1)]  # repeated ids
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = found(negatives.hard_negatives(df.repartition(3), F.col("id") % 20 == 0))
    assert got == brute(rows, 20) and len(got) > 500


def test_lists_leave_out_what_norms_cover():
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((500, 64)) * np.linspace(40, 1, 64)).astype(np.int64)
    index = negatives.Index(vectors)
    rows, depth = index.lists(0.5 * index.largest)
    assert sorted(rows) == list(range(500)) and (np.diff(depth) <= 0).all()
    assert 0 < depth.sum() < 0.7 * 4 * 500
    for r, d in zip(rows, depth):
        assert d == 4 or np.linalg.norm(vectors[r][index.order][16 * d :]) < 0.5 * index.largest
    scores = vectors[:50] @ vectors.T
    for share in (0.9, 0.5, 0.1, -1.0):
        limits = share * np.abs(scores).max(axis=1)
        a, r, s = index.above(vectors[:50], limits)
        assert sorted(zip(a, r)) == sorted(zip(*np.nonzero(scores >= limits[:, None]))) and (s == scores[a, r]).all()


def test_edges(spark):
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [], 0), (None, [1.0, 1.0], 0), (6, [1.0, 1.0], None)]
    good = [(0, [1.0, 0.0], 0), (7, [1.0, 0.5], 0), (8, [-1.0, 0.0], 0), (9, [0.0, 1.0], 0), (11, [0.5, 0.0], 1), (12, [0.5, 0.0], 2), (13, [0.9, 0.0], 1), (14, [0.91, 0.0], 1)]
    good += [(15, [0.0, 0.0], 1), (16, [0.3, 0.0], 3), (17, [-0.5, 0.0], 1), (100, [0.0, 0.0], 5), (200, [2.0, 0.0, 1.0], 0), (18, [1.0, 0.0, 1.0], 0), (19, [0.5, 0.0, 0.5], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad + good], SCHEMA)
    got = found(negatives.hard_negatives(df, F.col("id") % 100 == 0))
    assert got == brute(good, 100)
    assert [r[3] for r in got if r[:2] == (0, 7)] == [13, 11, 12] and (200, 18, 1, 19, 196608, 98304) in got
    huge = spark.createDataFrame([(0, [3e38, 1.0], 0, 1, "x"), (1, [3e38, 1.0], 0, 1, "x"), (2, [9e3, 1.0], 1, 1, "x")], SCHEMA)
    assert len(found(negatives.hard_negatives(huge, F.col("id") % 100 == 0))) == 1
    assert negatives.hard_negatives(df.filter("false"), F.col("id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0], 0, 1, "x") for k in range(300)], SCHEMA)
    assert negatives.hard_negatives(same, F.col("id") % 100 == 0).count() == 0
