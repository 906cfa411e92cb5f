"""A whole run over the smallest tables."""

from pyspark.sql import functions as F

from tracelake.plans.runs import build_contexts, build_priors
from tracelake.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def test_run_writes_valid_contexts(spark, tmp_path):
    catalog, logs = D.catalog(spark, SF), D.logs(spark, SF)
    priors = build_priors(catalog, logs, str(tmp_path / "priors"), k1=5, k2=2, restarts=1)
    contexts = build_contexts(spark, catalog, logs, priors, str(tmp_path / "run"))
    expected = logs.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n")).first()[0]
    assert contexts.count() == expected
    rules = {r.rule: r for r in spark.read.parquet(str(tmp_path / "run/validation")).collect()}
    assert all(r.passed for name, r in rules.items() if not name.startswith("label_")), rules
    assert spark.read.json(str(tmp_path / "run/manifest")).first().contexts == expected
