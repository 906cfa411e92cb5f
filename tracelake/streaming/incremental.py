"""Incremental materialisation: finished keys are kept, only missing ones are computed and appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def missing_keys(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def materialise_missing(wanted: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema) -> DataFrame:
    """Append ``compute`` of the keys not at ``path`` yet, and return the whole table.

    Rerunning after a failure computes only what is still missing.
    """
    spark = wanted.sparkSession
    todo = missing_keys(wanted.dropDuplicates(list(keys)), existing(spark, path, schema), keys)
    compute(todo).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
