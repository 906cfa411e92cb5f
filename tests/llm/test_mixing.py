import re

import pytest
from pyspark.sql import functions as F

from tracelake.llm import mixing


def filled(sizes, weights, budget):
    """Targets by pouring: cap who is over, share the rest again."""
    target, open_ = {}, dict(sizes)
    left = budget
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if 3 * sizes[s] < level * weights[s]]
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_and_taken(spark):
    sizes = {"a": 10, "b": 3, "c": 900, "d": 0, "e": 50, "f": 1, None: 40}
    rows = [(k * 1000 + j, s, "w " * 1) for k, (s, n) in enumerate(sizes.items()) for j in range(n)] + [(-1, "d", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = [s for s in sorted(k for k in sizes if k)] + [None]
    want = filled(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()))
    got = mixing.mix_digest(docs).toPandas().merge(docs.drop("text").toPandas(), on="doc_id")
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for source, rows_ in got.groupby(got["source"].fillna("none")):
        key = None if source == "none" else source
        assert rows_["source_size"].unique().tolist() == [sizes[key]]
        assert rows_["target"].iloc[0] == pytest.approx(want[key])
        assert rows_["taken"].sum() == pytest.approx(want[key], abs=0.51)
    again = mixing.mix_digest(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_positions_follow_the_demand(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rows = mixing.mixed_rows(mixing.plan(mixing.hash_order(docs), [F.col("_shuffle")])).toPandas()
    assert rows["position"].is_monotonic_increasing
    for turn, knots in enumerate(mixing.CURRICULUM):
        own = rows[rows["source"] == str(turn)]
        for t in (0.2, 0.5, 0.8):
            grid = [min(t, 1.0) * k / 2000 for k in range(2001)]
            height = lambda x: next(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if x <= b[0])  # noqa: E731, B023
            share = sum((height(x) + height(y)) / 2 * (y - x) for x, y in zip(grid, grid[1:])) / mixing.integral(knots)
            assert (own["position"] <= t).mean() == pytest.approx(share, abs=0.01)


def test_edges(messy, empty):
    got = mixing.mix_digest(messy).toPandas()
    assert len(got) == messy.count() and got["position"].notna().sum() == (got["taken"] > 0).sum()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in messy.collect())
    assert got["size"].sum() == words == pytest.approx(got["taken"].sum(), abs=3)
    assert mixing.mix_digest(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns and {r.text for r in mixed.collect()} <= {r.text for r in messy.collect()}
