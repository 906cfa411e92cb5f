import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tracelake.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of_ranks(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_ids_equal_the_tiktoken_library(codec, reference):
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 14), rng.randrange(0xA0, 0x800), rng.randrange(0x4E00, 0x9FFF), 0x1F600, 0x2581, 0, 0xFEFF, 0x85]))
    texts = ["".join(pick() for _ in range(rng.randrange(80))) for _ in range(1500)] + ["", "a" * 50_000, "<|endoftext|> it's 12345  \n\n x", " " * 999]
    got = list(codec.encode_all(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert all(codec.decode(i) == t.encode() for i, t in zip(got, texts))


def test_cache_starts_anew_without_losing_tokens(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    texts = [f"word{k} other{k % 7} {'x' * 60}{k}" for k in range(50)]
    assert list(codec.encode_all(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0, b"b": 2})


def test_frames(codec, reference, messy, empty):
    rows = bpe.decode(bpe.encode(messy, codec), codec).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.rank == 9
    for r in bpe.digests(messy, codec, ["doc_id"], with_ids=True).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.digests(empty, codec, ["doc_id"]).count() == 0


def test_forgetful_codec_encodes_alike(spark):
    import public_tokenizers

    from tracelake.llm import bpe

    codec = bpe.Codec.of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    before = codec.encode("one two 😀")
    codec.forget()
    assert "_seen" not in codec.__dict__ and codec.encode("one two 😀") == before
    docs = spark.createDataFrame([(1, "one two 😀"), (2, None)], "doc_id long, text string").repartition(2)
    rows = [sorted(bpe.digests(docs, codec, ["doc_id"], forget=f).collect()) for f in (False, True)]
    assert rows[0] == rows[1]
