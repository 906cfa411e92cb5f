"""Registry of named queries over the driver tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
# How much larger than their Parquet files tables are taken to be before they run.  A catalog of 7.7 MB that fits the
# broadcast limit became 453 MB with its concepts unrolled; joins with such tables are left to sizes measured at run time.
UNPACKED = "60"
# Tasks of a shuffle take at most this much of it where it has enough partitions to deal out, so that what a task sorts does
# not grow with the table; small shuffles are merged to fewer.
DEALT = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark).conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)
            for key, value in DEALT.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


# Shared table expressions of the SQL twins.
LOGS = """logs AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id,
         concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS log_id,
         CAST(l_partkey AS VARCHAR) AS problem_id,
         CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_correct,
         l_shipdate AS submit_time,
         CAST(l_suppkey AS VARCHAR) AS exercise_id, CAST(l_orderkey AS VARCHAR) AS course_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
INTER = LOGS + """, inter AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY submit_time, log_id) - 1 AS BIGINT) AS pos FROM logs)"""
CATALOG = """catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS problem_id, p_name AS text, p_brand AS title, p_type AS chapter,
         (p_size - 1) % 6 + 1 AS level,
         list_distinct(list_append(string_split(p_name, ' '), p_brand)) AS concepts FROM part)"""
VECS = """vecs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS problem_id, CAST(embedding AS DOUBLE[]) AS raw_vec, label AS cluster
  FROM part JOIN embeddings ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id),
unit AS (
  SELECT problem_id, cluster,
         list_transform(raw_vec, lambda x: x / CASE WHEN list_inner_product(raw_vec, raw_vec) > 0
                        THEN sqrt(list_inner_product(raw_vec, raw_vec)) ELSE 1.0 END) AS vec FROM vecs)"""
PAIRS20 = """pairs AS (
  SELECT t.user_id, t.pos, t.problem_id, h.pos AS h_pos, h.problem_id AS h_problem_id, h.is_correct AS h_is_correct
  FROM inter t JOIN inter h ON t.user_id = h.user_id AND h.pos >= t.pos - 20 AND h.pos < t.pos)"""
