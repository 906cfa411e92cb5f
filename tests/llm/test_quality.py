import math
import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_counts(spark, messy, monkeypatch):
    monkeypatch.setattr(quality, "GROUP_BYTES", 100)
    rng = random.Random(2)
    texts = [None, "", " a", "a\n\na\n a\n", "\u00a0x\u2003y z"] + [
        "".join(rng.choice(["a", "b ", "c\n", " ", "é|", "#", "\t", "a b c d e "]) for _ in range(rng.randrange(120))) for _ in range(200)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_counts(docs, ["doc_id"]).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute(texts[r.doc_id]), texts[r.doc_id]
    for r in quality.with_counts(messy, ["doc_id", "text"]).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute(r.text)


def test_measure_of_no_texts():
    assert all(len(v) == 0 for v in quality._measure(pa.array([], pa.large_string())).values())


def test_binomial_bound_is_exact():
    for n, rate, delta in ((0, 0.1, 0.05), (5, 0.5, 0.05), (80, 0.05, 0.05), (400, 0.02, 0.01), (900, 0.1, 0.001)):
        p, tail, k = Fraction(rate), Fraction(0), -1
        term = (1 - p) ** n
        while k < n and tail + term <= delta:
            tail, k = tail + term, k + 1
            term = math.comb(n, k + 1) * p ** (k + 1) * (1 - p) ** (n - k - 1) if k < n else 0
        assert quality.most_rejected(n, rate, delta) == k


def test_thresholds_hold_the_risk_and_reject_the_poor(spark):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows, labels = [], []
    for k in range(3000):
        poor = k % 5 == 0
        rows.append((k, " ".join(w + "***" for w in plain().split()) if poor else plain(), "en" if k % 3 else "xx"))
        if k < 2700:
            labels.append((k, int(not poor), 0))
    rows.append((9000, plain(), "rare"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.quality_digest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    new = got.loc[2700:2999]
    poor = new.index % 5 == 0
    assert not new[poor]["kept"].any() and new[~poor]["kept"].mean() > 1 - quality.RISK and got.loc[9000, "kept"]


def test_too_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j k *** *** ***", None) for k in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(20)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_digest(docs, labels).filter("kept").count() == 20


def test_edges(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_digest(messy, labels).collect()
    assert len(rows) == messy.count()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert quality.quality_digest(empty, labels).count() == 0
    assert quality.quality_digest(messy, labels.filter(F.lit(False))).count() == messy.count()
