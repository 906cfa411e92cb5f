import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import search


def brute(vectors, k, every=20):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors.items() if c != q and len(w) == len(v)]
            out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(c, s) for _, c, s in sorted(rows)] for q, rows in out.items()}


def recall(got, want):
    return np.mean([len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / max(len(want[q]), 1) for q in want])


def test_recall_against_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 300)
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((5, 24)) * 2
    data = {k: [float(np.float32(x)) for x in centres[k % 5] + rng.standard_normal(24) * (1 + k % 3)] for k in range(900)}
    rows = spark.createDataFrame([(k, v, 1, 2.0) for k, v in data.items()], "vec_id long, embedding array<float>, rank int, score double")
    got, want = found(search.nearest(rows, F.col("id") % 20 == 0)), brute(data, 20)
    assert recall(got, want) > 0.99
    for q in want:
        assert all(abs(s - dict(brute({q: data[q], c: data[c]}, 1, 1)[q])[c]) < 1e-12 for c, s in got[q])


def test_scores_and_bounds():
    rng = np.random.default_rng(1)
    vectors, mean = rng.standard_normal((400, 64)), np.full(64, 0.1)
    bounds = search.Codes.of(vectors, mean).upper_bounds(vectors[:50], mean)
    assert (bounds >= vectors[:50] @ vectors.T).mean() > 0.999
    assert np.allclose(search.rotation(9) @ search.rotation(9).T, np.eye(9))


def test_edges(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (9, [2.0, 0.0]), (8, [-1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    got = found(search.nearest(rows, F.col("id") % 20 == 0))
    assert got[0] == [(7, 2.0), (9, 2.0), (20, 0.0), (8, -1.0)]
    assert [c for c, _ in got[20]] == [0, 7, 8, 9] and 40 not in got
    assert search.nearest(rows.filter(F.lit(False)), F.col("id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(100)], "vec_id long, embedding array<float>")
    assert [c for c, _ in found(search.nearest(same, F.col("id") % 20 == 0))[0]] == list(range(1, 21))
