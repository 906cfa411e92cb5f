"""Expression tests on literal rows with hand-computed values."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions import vectors as V
from tracelake.functions.keys import hash_bucket


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_detail_parse_and_text(spark):
    rows = ['{"title":"T","content":"a  b"}', "{'title':'T','content':'What  is a\\nlock?','location':'4.6','body':None}", "[1]", "junk", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string").select("i", X.parse_detail(F.col("d")).alias("p"))
    out = [r for r in df.select(X.problem_text(F.col("p")).alias("t"), X.main_chapter(F.col("p.location")).alias("c")).orderBy("i").collect()]
    assert [r.t for r in out] == ["a b", "What is a lock?", "", "", ""]
    assert out[1].c == "4"


def test_levels_times_chapters(spark):
    levels = spark.createDataFrame([("2.0",), ("3.9",), (None,), ("",), ("x",)], "l string").select(X.safe_level(F.col("l")), X.unreadable_level(F.col("l"))).collect()
    assert [(r[0], r[1]) for r in levels] == [(2, False), (3, False), (0, False), (0, False), (0, True)]
    times = spark.createDataFrame([("2020-01-02 03:04:05",), ("2020/01/02 03:04:05",), ("x",)], "t string").select(F.unix_timestamp(X.submit_time(F.col("t")))).collect()
    assert times[0][0] == times[1][0] == 1577934245 and times[2][0] == 0
    got = one(spark, a=X.main_chapter(F.lit("4.6")), b=X.main_chapter(F.lit(".5")), c=X.main_chapter(F.lit("9")))
    assert got == {"a": "4", "b": ".5", "c": "9"}


def test_token_noise_and_labels(spark):
    tokens = ["____", "mathjaxinline", "ab12", "misc", "lock", "(lock).", "&nbsp;", "math-inline", "其中", "进程"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(X.clean_token(F.col("t"))).collect()]
    assert got == ["", "", "", "", "lock", "lock", "", "", "", "进程"]
    got = one(spark, a=X.compose_label(F.lit("lock"), F.lit("lock-key")), b=X.compose_label(F.lit("misc"), F.lit("__")), t=X.top_label(F.lit("a-b-c")))
    assert got == {"a": "lock-key", "b": "misc", "t": "a"}
    assert one(spark, t=X.raw_tokens(F.lit("操作系统 Lock-2")))["t"] == ["lock", "2", "操作", "作系", "系统"]
    fields = [F.lit(""), F.array(F.lit("misc"), F.lit("key")), F.lit("t"), F.lit("x")]
    assert one(spark, m=X.macro_fallback(*fields))["m"] == "key"


def test_truncation_and_format(spark):
    got = one(spark, a=X.truncate(F.lit("x" * 81)), b=X.truncate(F.lit("x" * 80)), c=X.fixed_decimals(F.lit(0.123456)), d=X.outcome_text(F.lit(None).cast("int")))
    assert got == {"a": "x" * 80 + "…", "b": "x" * 80, "c": "0.1235", "d": "未知"}


def summary(**over):
    import json

    item = [{"concept": "锁", "evidence_ids": [1, "x", 2, 3, 4, 5, 6], "confidence": "高"}]
    base = dict(mastered_concepts=item, weak_concepts=[], transfer_state="稳", risk_level="低", evidence_quality="中", diagnosis="好")
    base.update(over)
    return json.dumps(base, ensure_ascii=False)


def test_summary_rules(spark):
    cases = [
        (summary(), None), ("", "empty"), ("[1]", "not-an-object"), (summary(extra=1), "fields"),
        (summary(risk_level="x"), "risk:level"), (summary(diagnosis=" "), "diagnosis:empty"), (summary(weak_concepts="a"), "weak:list"),
        (summary(mastered_concepts=[{"concept": "a", "evidence_ids": [], "confidence": "?"}]), "mastered:confidence"),
    ]
    rows = spark.createDataFrame([(t, e) for t, e in cases], "t string, e string").select("e", X.summary_error(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.e for r in rows]
    s = X.parse_summary(F.lit(summary()))
    got = one(spark, ids=s["mastered_concepts"][0]["evidence_ids"], f=X.summary_features(s), t=X.summary_context(s, F.lit("证据")), x=X.summary_texts(s)["aux_text"])
    assert got["ids"] == [1, 2, 3, 4, 5]
    assert got["f"] == [1 / 3, 0.0, 1.0, 0.0, 1 / 80, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    assert got["t"] == "好 稳定掌握点：锁 迁移状态：稳 风险等级：低 证据质量：中\n证据"
    assert got["x"] == "迁移状态 稳 风险等级 低 证据质量 中"


def test_model_output_cleanup(spark):
    got = one(spark, a=X.clean_model_output(F.lit('<think>{no}</think>```json\n{"a":1}\n```')), b=X.clean_model_output(F.lit("<think>never closed {x}")))
    assert got == {"a": '{"a":1}', "b": ""}


def test_hash_bucket_matches_python(spark):
    users = ["u1", "学生", "42", ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in users], "u string").select(hash_bucket(F.col("u"))).collect()]
    assert got == [int(hashlib.sha256(u.encode()).hexdigest()[:8], 16) % 10 for u in users]


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3), (0, 0)))
    got = one(spark, cos=V.cosine(a, b), zero=V.cosine(a, z), unit=V.normalise(a), same=V.normalise(z), soft=V.softmax(a), w=V.weighted_sum(a, F.array(a, b), z))
    assert got["cos"] == pytest.approx(0.96) and got["zero"] == 0.0
    assert got["unit"] == pytest.approx([0.6, 0.8]) and got["same"] == [0.0, 0.0]
    assert got["soft"] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert got["w"] == pytest.approx([25.0, 24.0])
    s = one(spark, lo=V.sigmoid(F.lit(-800.0)), hi=V.sigmoid(F.lit(800.0)), j=V.jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))))
    assert s == {"lo": 0.0, "hi": 1.0, "j": 0.0}


def test_item_response(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = one(spark, a=V.mirf(arr(1, 0.5, 0.3), arr(-3, 1, 3), F.lit(0.5)), b=V.mirf(arr(2, 1, 0), arr(-3, 1, 3), F.lit(0.5)), c=V.irf(F.lit(1.0), F.lit(1.0), F.lit(1.0), 0.2))
    assert f"{got['a']:.6f}".startswith("0.109") and f"{got['b']:.6f}".startswith("0.004") and got["c"] == pytest.approx(0.6)
