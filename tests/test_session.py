"""The package reaches Python workers of a session that was started in another folder."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

REPO = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from tracelake.session import build_session, drop_scratch
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
from tracelake.registry import QUERIES
print("ROWS", QUERIES["distance_time"](spark, "/root/testdata/sf0.001").count())
drop_scratch(spark)
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]


def test_recorded_scratch_is_dropped_and_the_rest_stays(spark):
    from tracelake.session import drop_paths, materialise, recorded_scratch

    before = materialise(spark.range(3))
    with recorded_scratch() as paths:
        inner = materialise(spark.range(4))
        assert inner.count() == 4
    after = materialise(spark.range(5))
    assert len(paths) == 1
    drop_paths(spark, [*paths, *paths])
    assert not os.path.exists(paths[0].removeprefix("file:")) and (before.count(), after.count()) == (3, 5)


def test_unrolled_catalog_is_not_broadcast_by_its_packed_size(spark, tmp_path):
    from tracelake.registry import QUERIES

    part = spark.range(1_000_000).select(
        F.col("id").alias("p_partkey"), F.concat_ws(" ", F.lit("red"), F.lit("blue")).alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("SMALL").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.rand(1).alias("p_retailprice"),
    )
    part.drop("p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = [(k, [float(k), 1.0], 0) for k in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plan = QUERIES["principal_direction_checks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    broadcast = [k for k, line in enumerate(lines) if "BroadcastExchange" in line]
    assert "Generate explode(concepts" in plan
    assert not any("Generate explode(concepts" in line for k in broadcast for line in lines[k + 1 : k + 4])
