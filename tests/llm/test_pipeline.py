import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tracelake.llm import bpe
from tracelake.llm.common import DOCUMENT_COLUMNS


def test_stages_take_effect_one_after_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = corpus_pipeline.materialise(stage(spark, kept, sf))
        assert tuple(kept.columns) == DOCUMENT_COLUMNS, name
        ids = {r.doc_id for r in kept.collect()}
        assert ids and (name in ("line_dedup",)) == (kept.count() == before and name == "line_dedup")
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest(), len(encoding.encode_ordinary(r.text or ""))) for r in kept.collect())
    assert sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in last.collect()) == want


def test_messy_documents(spark, messy, tmp_path):
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_no_documents(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_named():
    from tracelake.llm.queries import QUERIES

    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
