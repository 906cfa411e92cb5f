"""Fits and vectors of the named queries do their whole job."""

from tracelake.operators import diagnostic as G
from tracelake.operators.text_vectors import DIMENSIONS
from tracelake.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_text_vectors_come_back_whole(spark):
    assert {len(r.vec) for r in QUERIES["text_vectors"](spark, SF).collect()} == {DIMENSIONS}


def test_mirt_runs_at_its_own_dimensions(spark):
    assert {r.a.count(",") for r in QUERIES["mirt_fit"](spark, SF).collect()} == {2}


def test_a_fit_of_all_targets_draws_none(spark, monkeypatch):
    rows = spark.createDataFrame([("u", i, i % 2, [1.0, float(i % 3)], [float(i % 2), 0.5]) for i in range(40)], "user_id string, pos long, is_correct int, vec array<double>, e_diag array<double>")
    written, write = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: written.append(df.count()) or write(df))
    G.fit_diagnostic(rows, max_pairs=None)
    G.fit_diagnostic(rows, max_pairs=10)
    assert written == [39, 10]
