import hashlib
import math
import zlib

from pyspark.sql import functions as F

from tracelake.llm import shards
from tracelake.llm.shards import Shard


def brute(key, tree):
    at = tree
    for level in ("region", "rack", "shard"):
        weights = {}
        for s in at:
            weights[getattr(s, level)] = weights.get(getattr(s, level), 0) + s.weight

        def draw(node):
            bits = int(hashlib.md5(f"{key}/{level}/{node}".encode()).hexdigest()[:13], 16)  # noqa: B023
            return -math.log((bits + 0.5) / (1 << 52)) / weights[node]  # noqa: B023

        node = min(sorted(weights), key=draw)
        at = [s for s in at if getattr(s, level) == node]
    return at[0].shard


def test_descent_slots_and_growth(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), (F.col("id") % 5).cast("string")).alias("text"))
    rows = shards.shard_documents(docs, 16).collect()
    assert len(rows) == 2000
    for r in rows:
        text = f"é{r.doc_id % 5}".encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        assert r.shard == brute(r.doc_id, shards.layout(16)) and r.grown_shard == brute(r.doc_id, shards.grown(shards.layout(16)))
        assert r.grown_shard in (r.shard, 16)
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_weights_confine_movement(spark):
    tree = [Shard(0, 0, 0), Shard(0, 0, 1), Shard(0, 1, 2), Shard(1, 2, 3, 2.0), Shard(1, 2, 4), Shard(1, 3, 5)]
    heavier = [*tree[:4], Shard(1, 2, 4, 3.0), tree[5]]
    rows = spark.range(3000).withColumn("key", F.col("id").cast("string"))
    both = shards.assign(shards.assign(rows, F.col("key"), tree), F.col("key"), heavier, "new_").toPandas()
    assert both[["shard", "new_shard"]].iloc[:300].values.tolist() == [[brute(k, tree), brute(k, heavier)] for k in range(300)]
    moved = both[both["shard"] != both["new_shard"]]
    # At the level where a row's path parts, it goes to the node that got heavier, and never within another subtree.
    parts = [next((level, new) for level in shards.LEVELS if (new := row[f"new_{level}"]) != row[level]) for _, row in moved.iterrows()]
    assert set(parts) == {("region", 1), ("rack", 2), ("shard", 4)} and len(moved) > 100
    share = both["shard"].value_counts(normalize=True)
    assert abs(share[3] - 2 / 7) < 0.03 and abs(share[0] - 1 / 7) < 0.03


def test_growth_takes_rows_only_into_the_new_shard_at_any_count(spark):
    rows = spark.range(1500).withColumn("key", F.col("id").cast("string"))
    for n in (1, 5, 9, 20):
        both = shards.assign(shards.assign(rows, F.col("key"), shards.layout(n)), F.col("key"), shards.grown(shards.layout(n)), "new_").toPandas()
        assert set(both.loc[both["shard"] != both["new_shard"], "new_shard"]) == {n}


def test_edges_and_files(spark, messy, empty, tmp_path):
    rows = shards.shard_documents(messy, 16).toPandas()
    assert len(rows) == messy.count() and (rows.groupby("shard")["slot"].nunique() == rows.groupby("shard").size()).all()
    assert rows.loc[rows["doc_id"] == 1, "shard"].nunique() == 1 and rows.loc[rows["doc_id"] == 4, "size"].tolist() == [1]
    assert shards.shard_documents(empty, 16).count() == 0
    shards.write(shards.shard_documents(messy, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == messy.count()
