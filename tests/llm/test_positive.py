import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm import positive
from tracelake.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, score double"


def brute(text):
    """The features of one text, counted one by one."""
    data, words, lines = text.encode(), text.encode().split(), text.split("\n")
    out = [0.0] * positive.FEATURES
    if data:
        for b in data:
            out[positive._CLASS[b]] += 1 / len(data)
        for k in range(len(data) - 2):
            h = ((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 % 2**32) >> 16
            out[positive.DENSE + h % positive.TRIGRAMS] += 1 / len(data)
    if words:
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        chars = sum(len(w.decode()) for w in words)
        out[positive.N_CLASSES : positive.DENSE] = [
            sum(a == b for a, b in zip(words, words[1:])) / len(words),
            len(set(words)) / len(words),
            1 - len(set(windows)) / max(len(windows), 1) if windows else 1.0,
            1 - len(set(lines)) / len(lines),
            min(chars / len(words), 50) / 10,
            np.log1p(len(words)) / 10,
            np.log1p(len(words) / len(lines)) / 5,
        ]
    return out[: positive.DENSE] + [x**0.5 for x in out[positive.DENSE :]]


def test_features_against_brute_force(monkeypatch):
    texts = ["", "a", "a a a b a a\nb\nb\n", "Été 12 £ #x! (y) \"z\"", "the cat " * 300, " \n ", "x" * 5000, "one\ntwo\n\n\n", "ab", "\0\x7f"]
    monkeypatch.setattr(positive, "GROUP_BYTES", 64)
    got = np.concatenate(list(positive.groups(pa.array(texts * 2, pa.large_string()))))
    want = np.array([brute(t) for t in texts * 2])
    assert np.allclose(got, want, atol=1e-5)


def test_the_prior_and_the_risk_without_negatives():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.7, 0.9):
        scores = np.concatenate([rng.normal(2, 1, int(6000 * share)), rng.normal(-2, 1, 6000 - int(6000 * share))])
        assert abs(positive.class_prior(rng.normal(2, 1, 3000), scores) - share) < 0.06
    good = rng.normal(0, 1, (3000, positive.FEATURES)) + 0.6
    poor = rng.normal(0, 1, (900, positive.FEATURES)) - 0.6
    rows, kind = np.concatenate([good, poor]), np.arange(3900)
    model = positive.fit(rows, kind < 1000, kind >= 1000)
    assert abs(model.prior - 2000 / 2900) < 0.1
    assert (model.scores(good) >= 0.5).mean() > 0.98 and (model.scores(poor) < 0.5).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_positive_unlabelled"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    judged = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, poor = ([r.score for r in judged if r.quality == q] for q in (1, 0))
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in judged)
    assert np.mean([g > p for g in good for p in poor]) > 0.99
    assert np.mean([g >= 0.3 for g in good]) > 0.99 and np.mean([p < 0.3 for p in poor]) > 0.8


def test_held_out_labels_and_negatives_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fewer = labels.filter(~positive.held_out() & (F.col("quality") == 1))
    a, b = (positive.quality_digest(docs.select("doc_id", "text"), x).orderBy("doc_id").collect() for x in (labels, fewer))
    assert a == b
    again = positive.quality_digest(docs.select("doc_id", "text").repartition(5), labels).orderBy("doc_id").collect()
    assert max(abs(x.score - y.score) for x, y in zip(a, again)) < 1e-9


def test_messy_documents(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 0, 0.5), (1, 0, 0, 0.5), (2, 1, None, 0.5), (None, 1, 0, 0.1), (8, None, 0, 0.2), (99, 1, 0, 0.3)], LABELS)
    rows = positive.quality_digest(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = positive.score(messy, positive.learn(messy, labels), ["doc_id", "text", "rank"]).collect()
    same = {}
    for r in by_text:
        assert same.setdefault(r.text, r.score) == r.score and r["rank"] == 9
    assert {r.score for r in positive.quality_digest(messy, labels.filter("false")).collect()} == {0.5}
    assert positive.quality_digest(empty, labels).count() == 0
