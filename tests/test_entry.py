"""The driver contract at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from tracelake.registry import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", ["dense_position", "chunk_plus_one", "history_retrieval_topk", "stage1_topk", "greedy_select", "legacy_stage1", "binary_metrics", "new_concept_split"])
def test_twins_agree(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).fetch_df()[list(got.columns)]
    key = lambda df: sorted(tuple(str(round(x, 6) + 0.0 if isinstance(x, float) else x) for x in r) for r in df.itertuples(index=False))
    assert key(got) == key(want)


def test_generated_contexts_pass_validation(spark):
    rules = QUERIES["context_rules"](spark, SF).collect()
    assert all(r.passed for r in rules), rules
