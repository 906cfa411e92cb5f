import numpy as np
from pyspark.sql import functions as F
import pytest

from tracelake.llm import language


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(given):
    rows = language.language_digest(given).toPandas().merge(given.select("doc_id", "lang").toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert len(held) > 250 and (held["lang_pred"] == held["lang"]).mean() > 0.98 and rows["score"].between(0, 1).all()


def test_slices_return_all_languages_of_an_ngram(spark):
    docs = spark.createDataFrame([("aaaa bbbb", "x"), ("bbbb cccc", "y")], "text string, lang string")
    filters = language.learn(docs)
    assert filters.languages == ["x", "y"]
    shares = filters.shares("bbbb")
    assert np.allclose(shares, 1.0, atol=0.01)
    assert filters.judge("aaaa")[0] == "x" and filters.judge("cccc")[0] == "y"
    assert filters.shares("aaaa")[1] < 0.5


def test_many_languages_use_more_words(spark):
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" * 4 for k in range(70)]
    filters = language.learn(spark.createDataFrame([(w, f"l{k:02}") for k, w in enumerate(words)], "text string, lang string"))
    assert filters.slices.shape[0] == 2
    assert all(filters.judge(w)[0] == f"l{k:02}" for k, w in enumerate(words))


def test_pieces_lose_no_ngram(monkeypatch):
    text = "Zażółć gęślą jaźń, 12 déjà-vu! " * 50
    whole = np.sort(np.concatenate(list(language.ngrams(text))))
    monkeypatch.setattr(language, "PIECE", 17)
    assert (np.sort(np.concatenate(list(language.ngrams(text)))) == whole).all()


def test_edges(spark, messy, empty):
    rows = language.language_digest(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.lang_pred is not None and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_pred == by[4].lang_pred == by[6].lang_pred == "und" and by[4].score == 0
    assert language.language_digest(empty).count() == 0 and language.known_language(empty).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.language_digest(nothing).first().lang_pred == "und"
    assert language.known_language(messy).columns == messy.columns
    named = messy.withColumns({"score": F.lit("own"), "lang_pred": F.lit(7)})
    kept = language.known_language(named)
    assert kept.columns == named.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {("own", 7)}


def test_a_sample_draws_copies_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    docs = spark.createDataFrame([(k, "the same text", "x") for k in range(400)] + [(k, f"other {k}", "y") for k in range(400, 420)], "doc_id long, text string, lang string")
    filters = language.learn(docs)
    assert filters.languages == ["x", "y"] and filters.judge("the same text")[0] == "x" and filters.judge("other")[0] == "y"
