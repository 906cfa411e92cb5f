"""Operators against brute force on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import context as C
from tracelake.operators import cooccur as O
from tracelake.operators import directions as D
from tracelake.operators import fit as T
from tracelake.operators import graph as G
from tracelake.operators import metrics as M
from tracelake.operators import retrieve as R
from tracelake.operators import validate as K
from tracelake.operators.greedy import LEGACY_RULE, STRICT_RULE, greedy_select
from tracelake.operators.split import hashed_rank
from tracelake.streaming.incremental import materialise_missing


def brute_greedy(cands, n_concepts, n_nodes, rule):
    """One target, straight from the definition; candidates in tie order."""
    roles = lambda c: np.array([(c["act"] >> j) & 1 for j in range(rule.roles)])
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    def similar(a, b):
        x, y = roles(a), roles(b)
        dot = x @ y
        size = x.sum() + y.sum() - dot if rule.tanimoto_roles else x.sum() * y.sum()
        cos = float(np.dot(a["vec"], b["vec"]))
        return rule.red_concepts * jac(a["concepts"], b["concepts"]) + rule.red_roles * dot / (size + 1e-6) + rule.red_vectors * cos

    left, chosen = list(cands), []
    while left and len(chosen) < rule.picks:
        best, best_score = None, None
        for c in left:
            score = c["u"]
            if chosen:
                covered = np.max([roles(o) for o in chosen], axis=0)
                new = sum(int(roles(c)[j] and not covered[j]) for j in rule.gain_roles)
                k = len(set(c["overlap"]) - {x for o in chosen for x in o["overlap"]}) / (n_concepts + 1e-6)
                g = len(set(c["nodes"]) - {x for o in chosen for x in o["nodes"]}) / (n_nodes + 1e-6)
                red = max(similar(c, o) for o in chosen)
                red = max(red, 0.0) if rule.floor_redundancy else red
                score = c["u"] + rule.coverage * (new + k + g) - rule.redundancy * red
            if best is None or score > best_score:
                best, best_score = c, score
        chosen.append(best)
        left.remove(best)
    return [c["pos"] for c in chosen]


@pytest.mark.parametrize("rule", [STRICT_RULE, LEGACY_RULE])
def test_greedy_matches_definition(spark, rule):
    rng = np.random.default_rng(5)
    names = list("abcdefgh")
    rows, want = [], {}
    for t in range(60):
        pool = list(rng.choice(names, size=3, replace=False))
        near = list(rng.choice(names, size=4, replace=False))
        cands = []
        for pos in rng.permutation(30)[: t % 13]:
            concepts = list(rng.choice(names, size=rng.integers(0, 4), replace=False))
            vec = rng.normal(size=3)
            cands.append(
                dict(pos=int(pos), u=round(float(rng.integers(0, 6)) / 4, 2), act=int(rng.integers(0, 2**rule.roles)), concepts=concepts,
                     overlap=[c for c in concepts if c in pool], nodes=[c for c in names if c in near and rng.random() < 0.4], vec=(vec / np.linalg.norm(vec)).tolist())
            )
        cands.sort(key=lambda c: (-c["u"], -c["pos"]))
        rows.append((t, cands, 3.0, 4.0))
        want[t] = brute_greedy(cands, 3, 4, rule)
    item = "struct<pos:int,u:double,act:int,concepts:array<string>,overlap:array<string>,nodes:array<string>,vec:array<double>>"
    df = spark.createDataFrame(rows, f"t int, candidates array<{item}>, n_concepts double, n_nodes double")
    got = {r.t: r for r in greedy_select(df.repartition(3), ["t"], rule).collect()}
    for t, pos in want.items():
        assert [e["pos"] for e in got[t].evidence] == pos
        assert [e["rank"] for e in got[t].evidence] == list(range(1, len(pos) + 1))


def test_top_up_matches_sequential_definition(spark):
    rng = random.Random(3)
    names = [f"c{i:02d}" for i in range(30)]
    pairs = {}
    for _ in range(70):
        a, b = sorted(rng.sample(names, 2))
        pairs[a, b] = rng.randrange(1, 5)
    low, adj = {n: {} for n in names}, {n: {} for n in names}
    for (a, b), c in pairs.items():
        low[a][b] = low[b][a] = c
        if c >= 3:
            adj[a][b] = adj[b][a] = c
    want = []
    for c in sorted(names):
        if not low[c] or len(adj[c]) >= 3:
            continue
        for n, count in sorted(low[c].items(), key=lambda x: (-x[1], x[0])):
            if n in adj[c]:
                continue
            adj[c][n] = adj[n][c] = count
            want.append((c, n))
            if len(adj[c]) >= 3:
                break
    df = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a string, b string, freq bigint")
    assert sorted((r.src, r.dst) for r in G.top_up(df).collect()) == sorted(want)


def test_heuristic_deep_search_equals_full_scan(spark):
    rng = random.Random(9)
    catalog = spark.createDataFrame([(f"p{i}", [f"k{i % 5}", f"j{i % 7}"], 0 if i % 2 else i % 4) for i in range(40)], "problem_id string, concepts array<string>, level int")
    seq = [f"p{rng.randrange(40)}" for _ in range(90)]
    rows = spark.createDataFrame([("hot", i, p, i % 2) for i, p in enumerate(seq)] + [("b", i, p, 1) for i, p in enumerate(seq[:5])], "user_id string, pos int, problem_id string, is_correct int")
    near = spark.createDataFrame([("p1", 1, "p2", 0.5), ("p3", 1, "p30", 0.4)], "problem_id string, rank int, neighbor_id string, score double")
    profiled = R.with_profile(rows, catalog, near)
    key = lambda df: sorted((r.user_id, r.pos, r["rank"], r.h_pos, round(r.score, 12)) for r in df.collect())
    wide = key(R.heuristic(profiled, tile=200))
    assert wide == key(R.heuristic(profiled, tile=8))
    last = spark.createDataFrame([("hot", 89), ("b", 4)], "user_id string, pos int")
    assert key(R.heuristic_for_targets(profiled, last)) == [x for x in wide if (x[0], x[1]) in {("hot", 89), ("b", 4)}]


def test_reach_is_where_scores_vanish():
    assert R.BEST_SCORE * math.exp(-R.TIME_DECAY * (R.REACH + 1)) == 0.0


def test_item_neighbors_and_cap(spark):
    logs = [("a", t, f"p{t}") for t in range(6)] + [("b", t, f"p{t}") for t in (0, 1, 2)] + [("c", 0, "p0"), ("c", 1, "p0")]
    df = spark.createDataFrame(logs, "user_id string, t int, problem_id string")
    got = {(r.problem_id, r["rank"]): (r.neighbor_id, r.score) for r in O.item_neighbors(df, ["t"], k=2, cap=4).collect()}
    assert got["p0", 1] == ("p1", pytest.approx(2 / 3)) and got["p0", 2] == ("p2", pytest.approx(2 / 3))
    assert got["p3", 1][0] == "p1" and ("p5", 1) not in got


@pytest.mark.parametrize("light", [0, 2, 6, 50])
def test_item_neighbors_leave_out_no_user(spark, light):
    rng = random.Random(light)
    held = {u: {f"p{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 4, 9, 30]))} for u in range(40)}
    held["twin"], held["twin2"] = {"rare", "rarer"}, {"rare", "rarer", *(f"p{k}" for k in range(40))}
    df = spark.createDataFrame([(str(u), p) for u, ps in held.items() for p in ps for _ in range(rng.randrange(1, 3))], "user_id string, problem_id string")
    users = {}
    for u, ps in held.items():
        for p in ps:
            users.setdefault(p, set()).add(u)
    want = {}
    for p, mine in users.items():
        scored = sorted((-len(mine & users[q]) / len(mine | users[q]), q) for q in users if q != p and mine & users[q])
        want[p] = [(q, pytest.approx(-s)) for s, q in scored[:3]]
    got = {}
    for r in O.item_neighbors(df, [], k=3, light=light).orderBy("problem_id", "rank").collect():
        got.setdefault(r.problem_id, []).append((r.neighbor_id, r.score))
    assert got == want


def test_chunks_of_a_large_key_lose_no_pair(spark):
    rows = [("big", v) for v in range(23)] * 2 + [("small", v) for v in (1, 2)] + [("one", 1), ("none", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = sorted((r.a, r.b) for r in O.pairs_of_sorted(df, "k", "v", chunk=5).collect())
    assert got == sorted([(a, b) for a in range(23) for b in range(a + 1, 23)] + [(1, 2), (3, 4)])


def test_stat_edges_cap_levels_and_hops(spark):
    pairs = spark.createDataFrame([("a", "b", 49), ("a", "c", 50), ("b", "c", 200), ("c", "d", 500)], "a string, b string, freq bigint")
    levels = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 1)], "concept string, level int")
    got = {(r.src, r.dst, r.rel_type): r.weight for r in G.stat_edges(pairs, levels).collect()}
    assert got == {("a", "c", "pre"): 0.25, ("b", "c", "same"): 1.0, ("c", "b", "same"): 1.0, ("d", "c", "pre"): 1.0}
    chain = spark.createDataFrame([("a", "b", "pre", 0.5), ("b", "c", "same", 1.0), ("a", "b", "adj", 0.9)], "src string, dst string, rel_type string, weight double")
    phi = {(r.src, r.dst): r.phi for r in G.hops(chain).collect()}
    assert phi == {("a", "b"): 0.5, ("b", "c"): pytest.approx(0.8), ("a", "c"): pytest.approx(0.8 * math.exp(-1))}


def test_binary_metrics_ties_and_one_class(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.1, 0.4, 0.5, 0.5, 0.9]), rng.randrange(2)) for _ in range(300)]
    got = M.binary_metrics(spark.createDataFrame(rows, "score double, label int")).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got.auc == pytest.approx(auc) and got.sample_count == 300
    assert got.acc == pytest.approx(np.mean([(s >= 0.5) == y for s, y in rows]))
    one = M.binary_metrics(spark.createDataFrame([(0.9, 1), (0.2, 1)], "score double, label int")).first()
    assert one.auc is None and one.pr_auc is None and one.recall == 0.5
    none = M.binary_metrics(spark.createDataFrame([], "score double, label int")).first()
    assert none.sample_count == 0 and none.acc == 0.0 and none.bce == 0.0


def test_principal_directions_match_svd(spark):
    rng = np.random.default_rng(7)
    vec = {f"p{i}": rng.normal(size=5) * [3, 1, 1, 1, 1] for i in range(40)}
    catalog = [(p, i % 3, ["x"] + (["solo"] if i == 4 else [])) for i, p in enumerate(vec)]
    cat = spark.createDataFrame(catalog, "problem_id string, level int, concepts array<string>")
    vectors = spark.createDataFrame([(p, v.tolist()) for p, v in vec.items()], "problem_id string, vec array<double>")
    got = {r.concept: np.asarray(r.direction) for r in D.principal_directions(cat, vectors.repartition(5)).collect()}
    x = np.stack(list(vec.values()))
    axis = np.linalg.svd(x - x.mean(0))[2][0]
    proj = (x - x.mean(0)) @ axis
    axis = axis if proj[[i % 3 == 2 for i in range(40)]].mean() >= proj[[i % 3 == 0 for i in range(40)]].mean() else -axis
    assert got["x"] == pytest.approx(axis) and got["solo"] == pytest.approx(vec["p4"] / np.linalg.norm(vec["p4"]))


def test_nearest_items_blocks(spark):
    rng = np.random.default_rng(8)
    vec = {f"p{i:02d}": rng.normal(size=3) for i in range(25)}
    vectors = spark.createDataFrame([(p, v.tolist()) for p, v in vec.items()], "problem_id string, vec array<double>")
    got = Counter((r.problem_id, r.neighbor_id) for r in D.nearest_items(vectors, 3, block=7).collect())
    unit = {p: v / np.linalg.norm(v) for p, v in vec.items()}
    want = Counter((p, q) for p in vec for q in sorted((q for q in vec if q != p), key=lambda q: -(unit[p] @ unit[q]))[:3])
    assert got == want


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(11)
    skill, hard = {u: rng.gauss(0, 1) for u in range(30)}, {q: rng.gauss(0, 1) for q in range(8)}
    rows = [(f"u{u}", f"q{q}", int(rng.random() < 1 / (1 + math.exp(hard[q] - skill[u])))) for u in skill for q in hard for _ in range(2)]
    logs = spark.createDataFrame(rows + [("ghost", "q0", None)], "user_id string, problem_id string, is_correct int")
    return logs, spark.createDataFrame([(f"q{q}",) for q in range(9)], "problem_id string"), rows


def test_rasch_matches_numpy(spark, answers):
    logs, catalog, rows = answers
    users, items = sorted({r[0] for r in rows}), [f"q{q}" for q in range(9)]
    ui, qi = np.array([users.index(r[0]) for r in rows]), np.array([items.index(r[1]) for r in rows])
    y = np.array([r[2] for r in rows])
    p = [np.zeros(len(users)), np.zeros(9)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, 7):
        r = (1 / (1 + np.exp(-(p[0][ui] - p[1][qi]))) - y) / len(rows)
        grads = [np.bincount(ui, r, len(users)) + 0.2 * p[0] / 31, -np.bincount(qi, r, 9) + 2.0 * p[1] / 9]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        p[1] = p[1] - p[1].mean()
    got = {r.problem_id: r.mu for r in T.rasch(logs, catalog).collect()}
    assert [got[q] for q in items] == pytest.approx(np.tanh(p[1]).tolist())


def test_irt_and_mirt_reduce_loss(spark, answers):
    logs, catalog, _ = answers
    usable = logs.filter("is_correct is not null")
    loss = lambda df: M.binary_metrics(df.withColumnRenamed("is_correct", "label")).first().bce
    first = loss(T.predict_irt(usable, *T.irt(logs, catalog, epochs=1, lr=1e-6)))
    assert loss(T.predict_irt(usable, *T.irt(logs, catalog, epochs=4, lr=0.1))) < first
    first = loss(T.predict_mirt(usable, *T.mirt(logs, catalog, 2, epochs=1, lr=1e-6)))
    assert loss(T.predict_mirt(usable, *T.mirt(logs, catalog, 2, epochs=4, lr=0.1))) < first


def test_two_level_clusters_are_stable(spark):
    from tracelake.operators.clusters import two_level_clusters

    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"p{i:02d}", (rng.normal(size=2) * 0.05 + [10 * (i % 3), (i // 3) % 2]).tolist()) for i in range(36)], "problem_id string, vec array<double>")
    run = lambda df: sorted(tuple(r) for r in two_level_clusters(df, 3, 2, restarts=2).select("problem_id", "macro", "micro").collect())
    got = run(vectors)
    assert got == run(vectors.repartition(1))
    truth = {f"p{i:02d}": (i % 3, (i // 3) % 2) for i in range(36)}
    assert len({(truth[p], (a, b)) for p, a, b in got}) == 6 and got[0][1:] == (0, 0)


def test_hashed_rank_ignores_partitioning(spark):
    df = spark.createDataFrame([(f"u{i}",) for i in range(50)], "user_id string")
    ranks = lambda d: sorted(tuple(r) for r in hashed_rank(d, ["user_id"]).collect())
    assert ranks(df.repartition(1)) == ranks(df.repartition(7))
    assert sorted(r[1] for r in ranks(df)) == list(range(50))


# -- contexts ----------------------------------------------------------------

ITEM = "struct<rank:int,problem_id:string,semantic_id:string,role:string,knowledge_overlap:string,level_diff:int,answer_result:string,support_score:string,question_text:string,history_pos:int,text:string>"
CONTEXT = f"""user_id string, target_t int, target_pid string, target_semantic_id string, stage1_count int, selected_count int, main_context_text string,
template_context_text string, summary struct<target_concepts:array<string>,dominant_role:string,risk_level:string,recent_trend:string,summary_text:string>, evidence array<{ITEM}>"""


def context(user, t, role="前置支撑", support="0.1234", rank=1, count=None, template=None):
    item = (rank, "p", "a-b", role, "无", 0, "正确", support, "text", 0, "line")
    return (user, t, "q", "a-b", min(20, t) if count is None else count, 1, "line", template or "S\nline", (["k"], role, "低", "x", "S"), [item])


def test_context_rules_find_every_violation(spark):
    good = [context("a", 1), context("b", 1)]
    bad = [context("c", 1, role="?"), context("d", 1, support="0.1"), context("e", 1, rank=2), context("f", 30, count=30), context("g", 1, template="line")]
    rules = lambda rows: {r.rule: r.violations for r in K.context_rules(spark.createDataFrame(rows, CONTEXT)).collect()}
    assert set(rules(good).values()) == {0}
    found = rules(good + bad)
    assert {k for k, v in found.items() if v} == {"unknown_role", "support_decimals", "rank_not_dense", "stage1_count", "selected_count", "template_without_summary"}


def test_enrichment_uses_cache_then_signature(spark):
    df = spark.createDataFrame([context("a", 1), context("b", 1), context("c", 1, role="同质迁移"), context("d", 1, role="图谱补充")], CONTEXT)
    cached = C.with_keys(df).filter("user_id = 'c'").select("key", F.lit("not json").alias("summary_text"))
    calls = []

    def summariser(rows):
        calls.extend(r.user_id for r in rows.collect())
        from tracelake.registry.context_queries import rule_summariser

        return rule_summariser(rows)

    out, failures, fresh = C.enrich(df, cached, summariser)
    got = {r.user_id: r for r in out.collect()}
    assert sorted(calls) == ["a", "d"] and fresh.count() == 2
    assert got["a"].llm_summary_text == got["b"].llm_summary_text and got["a"].llm_context_text.endswith("\nline")
    assert [r.summary_problem for r in failures.collect()] == ["not-an-object"] and got["c"].llm_context_text == ""


def test_incremental_computes_only_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("id", (F.col("id") * 2).alias("v"))

    path = str(tmp_path / "cache")
    materialise_missing(spark.range(5), path, ["id"], compute, "id bigint, v bigint")
    out = materialise_missing(spark.range(8), path, ["id"], compute, "id bigint, v bigint")
    assert seen == [5, 3] and out.count() == 8


def test_strict_context_lookup_raises(spark):
    rows = spark.createDataFrame([("u", 0, "p"), ("u", 1, "p")], "user_id string, pos int, problem_id string")
    vectors = spark.createDataFrame([], "user_id string, target_t int, target_pid string, vec array<double>")
    zero = F.array(F.lit(0.0))
    assert {r.pos: r.context for r in C.context_for_logs(rows, vectors, zero).collect()} == {0: [0.0], 1: [0.0]}
    with pytest.raises(Exception, match="context vector missing"):
        C.context_for_logs(rows, vectors, zero, strict=True).collect()


def test_graph_payload_and_history_rules(spark):
    payloads = ['{"prerequisite_candidates":[],"related_candidates":["a"],"confidence":"高"}', '{"prerequisite_candidates":[]}', "x",
                '{"prerequisite_candidates":[],"related_candidates":"a","confidence":"?","more":1}']
    got = {r.rule: r.violations for r in K.graph_payload_rules(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()}
    assert got == {"payload_invalid": 1, "payload_key_missing": 1, "payload_key_unknown": 1, "candidates_not_a_list": 2, "confidence_invalid": 3}
    history = spark.createDataFrame([(1, 0.5), (2, 0.6)], "epoch int, val_loss double")
    assert all(r.violations == 0 for r in K.fit_history_rules(history).collect())


def test_trajectories_of_users_with_a_single_log(spark, tmp_path):
    import duckdb

    from tracelake.registry import QUERIES, SQL

    source = "/root/testdata/sf0.001"
    for name in ("orders", "part", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{source}/lineitem.parquet' WHERE l_linenumber = 1 AND l_orderkey % 4 = 0) TO '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "part", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(SQL["prompt_trajectories"]).fetchall()
    users = con.execute("SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchone()[0]
    got = [tuple(r) for r in QUERIES["prompt_trajectories"](spark, str(tmp_path)).collect()]
    assert 0 < len(want) < users and sorted(got) == sorted(want)


def test_neighbors_without_shuffled_pairs(spark, monkeypatch):
    """Ties of all kinds, problems in several parts and runs across batches; pairs are never formed for the shuffle."""
    import random
    from collections import defaultdict

    from tracelake.operators import cooccur

    def refuse(*args, **kwargs):
        raise AssertionError("pairs are shuffled")

    monkeypatch.setattr(cooccur, "pairs_of_sorted", refuse)
    monkeypatch.setattr(cooccur, "RUN_USERS", 3)
    rng = random.Random(11)
    rows = sorted({(f"u{u}", f"p{rng.randrange(30)}") for u in range(40) for _ in range(rng.randrange(1, 9))} | {("alone", "single")})
    users = defaultdict(set)
    for u, p in rows:
        users[p].add(u)
    want = []
    for p in users:
        scored = [(-len(users[p] & users[q]) / len(users[p] | users[q]), q) for q in users if q != p and users[p] & users[q]]
        want += [(p, r, q, -s) for r, (s, q) in enumerate(sorted(scored)[:5], 1)]
    logs = spark.createDataFrame([(u, p, n) for n, (u, p) in enumerate(rows)], "user_id string, problem_id string, log_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in cooccur.item_neighbors(logs, ["log_id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)
    assert cooccur.item_neighbors(logs.limit(0), ["log_id"]).count() == 0


def test_nearest_items_of_shared_vectors_compare_distinct_ones(spark, monkeypatch):
    from tracelake.operators import directions as D

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 4))
    rows = [(f"p{i:03d}", base[i % 30].tolist()) for i in range(600)]
    seen = []
    materialise = D.materialise
    monkeypatch.setattr(D, "materialise", lambda df: seen.append(materialise(df)) or seen[-1])
    found = D.nearest_items(spark.createDataFrame(rows, "problem_id string, vec array<double>"), k=25, block=7).collect()
    assert min(df.count() for df in seen) == 30
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    got = {}
    for r in found:
        got.setdefault(r.problem_id, {})[r["rank"]] = r.neighbor_id
    for i in (0, 5, 299, 599):
        order = sorted((-scores[i % 30, j % 30], f"p{j:03d}") for j in range(600) if j != i)
        assert [got[f"p{i:03d}"][n] for n in range(1, 26)] == [name for _, name in order[:25]]


def test_sets_looked_up_behind_the_shuffle_choose_the_same(spark):
    from tracelake.operators import evidence as E
    from tracelake.operators.recent import shared_sets

    rng = np.random.default_rng(5)
    pick = lambda n: [f"c{j}" for j in rng.choice(8, n, replace=False)]
    kinds = [(pick(3), pick(2), None if i == 0 else pick(1), pick(4)) for i in range(4)]
    profile = [(f"p{i}", int(i % 3), i % 5, [f"p{(i + 1) % 20}", f"p{(i + 7) % 20}"], *kinds[i % 4]) for i in range(20)]
    names = "problem_id string, level int, vec_id int, neighbors array<string>, concepts array<string>, pre_sources array<string>, near_sources array<string>, nodes array<string>"
    profile = spark.createDataFrame(profile, names)
    logs = [(f"u{u}", k, f"p{rng.integers(20)}", int(rng.integers(2))) for u in range(3) for k in range(25)]
    logs = spark.createDataFrame(logs, "user_id string, pos int, problem_id string, is_correct int")
    vectors = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(5, 4)))], "vec_id int, vec array<double>")
    items, sets = shared_sets(profile)
    assert sets.count() == 4 and "concepts" not in items.columns
    for run in (E.select, E.stage1):
        plain = run(logs.join(profile, "problem_id"), vectors=vectors, n=6).orderBy("user_id", "pos").collect()
        assert plain == run(logs.join(items, "problem_id"), vectors=vectors, sets=sets, n=6).orderBy("user_id", "pos").collect()


def test_a_tile_meets_itself_in_one_copy_of_its_rows(spark):
    from tracelake.operators.full_history import meetings, tiled

    rows = tiled(spark.createDataFrame([("u", k, [k]) for k in range(8)], "user_id string, pos int, x array<int>"), 4)
    targets = rows.withColumnRenamed("tile", "t_tile").selectExpr("*", "explode(sequence(greatest(t_tile - 1, 0), t_tile)) as h_tile")
    met = meetings(targets, rows, own=True, target_only=("x",)).collect()
    assert len(met) == 4 + 4 + 4 + 4  # tile 0 alone, tile 1 alone, tile 1 behind tile 0
    assert all((r.x is None) == (not r.target) for r in met)


def test_steps_of_numbers_go_back(spark):
    from tracelake.operators.cooccur import _numbers, _steps

    lists = [[0, 1, 40_000, 40_001, 32_768 + 40_001, 1 << 29], [], [(1 << 30) - 1], [32_767], [32_768, 65_536]]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<int>").coalesce(1)
    row, value = _numbers(df.select(_steps(F.col("ids")).alias("s")).toArrow().column("s").combine_chunks())
    assert [value[row == k].tolist() for k in range(len(lists))] == lists


def test_shared_context_vectors_are_looked_up_last(spark):
    rows = spark.createDataFrame([("u", 0, "p"), ("u", 1, "p"), ("u", 2, "q")], "user_id string, pos int, problem_id string")
    ids = spark.createDataFrame([("u", 0, "p", 1), ("u", 1, "p", 1), ("u", 2, "q", 7)], "user_id string, target_t int, target_pid string, vec_id int")
    shared = spark.createDataFrame([(1, [2.0])], "vec_id int, vec array<double>")
    got = C.context_for_logs(rows, ids, F.array(F.lit(0.0)), shared=shared).collect()
    assert {r.pos: r.context for r in got} == {0: [0.0], 1: [2.0], 2: [0.0]}


def test_states_and_co_vectors_made_in_the_scoring_pass(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tracelake.operators import evidence as E
    from tracelake.operators import sequences as S

    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(k, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(6, 3)))], "vec_id long, vec array<double>")
    table = table.withColumn("co_vec", F.transform("vec", lambda x: F.abs(x)))
    logs = [(u, i, f"p{k}", int(rng.integers(2)), int(k % 3), k, [f"c{k % 2}"], [], [], [], []) for u, n in (("a", 25), ("b", 3)) for i in range(n) for k in [int(rng.integers(6))]]
    sets = ", ".join(f"{c} array<string>" for c in ("concepts", "pre_sources", "near_sources", "neighbors", "nodes"))
    rows = spark.createDataFrame(logs, f"user_id string, pos long, problem_id string, is_correct int, level int, vec_id long, {sets}")
    wide = rows.join(table, "vec_id")
    states = S.diagnostic_state(wide.select("user_id", "pos", "is_correct", "vec")).select("user_id", "pos", "e_diag")
    model = ((0.5, -1.0, 2.0), 0.1)
    shape = lambda df: sorted((r.user_id, r.pos, [(c.pos, round(c.r, 9), round(c.pre, 9), round(c.collab, 9)) for c in r.candidates]) for r in df.collect())
    made = shape(E.stage1(rows, diagnosis=model, vectors=table))
    assert made == shape(E.stage1(wide.join(states, ["user_id", "pos"]), diagnosis=model)) and len(made) == 28


def test_the_diagnosis_fit_makes_its_states_once(spark):
    from tracelake.operators import diagnostic as G

    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("u", i, i % 2, [1.0, float(i % 3)], [float(i % 2), 0.5]) for i in range(40)], "user_id string, pos long, is_correct int, vec array<double>, e_diag array<double>")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    weights, _ = G.fit_diagnostic(rows.mapInArrow(counted, rows.schema), logs=rows)
    assert len(weights) == 2 and seen.value == 40


def test_kinds_of_files_are_told_by_spark(spark, tmp_path):
    from tracelake.sources import readers as R

    folder = tmp_path / "a b%20c"
    (folder / "k=1").mkdir(parents=True)
    texts = {
        "lines.json": '\n  {"user_id": "u"}\n{"user_id": "v"}\n', "array.json": '\n[{"user_id": "w"},\n{"user_id": "x"}]', "pretty.json": '{ \n"data": []}',
        "one.json": '{"data": []}', "bom.json": "﻿[]", "long.json": '{"user_id": "' + "y" * (1 << 16) + '"}', "empty.json": " \n\n", "_hidden.json": "[]", "k=1/inside.json": "[]",
    }
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    kinds = R._files_by_kind(spark, str(folder))
    told = {kind: sorted(p.rsplit("/", 1)[1] for p in names) for kind, names in kinds.items()}
    assert told == {True: ["array.json", "bom.json", "pretty.json"], False: ["lines.json", "long.json", "one.json"]}
    assert R._files_by_kind(spark, str(folder / "array.json"))[True] == [str(folder / "array.json")]
    users = {r.user_id for r in R.read_json_any(spark, str(folder), R.SEQUENCE_SCHEMA).filter("user_id is not null").collect()}
    assert users == {"u", "v", "w", "x", "y" * (1 << 16)}


def test_hashes_that_order_keys_are_not_written(spark, monkeypatch):
    import hashlib

    from pyspark.sql import functions as F

    from tracelake.functions.keys import hash_order
    from tracelake.operators import split as P
    from tracelake.plans import ranks

    written, write = [], ranks.materialise
    monkeypatch.setattr(ranks, "materialise", lambda df: written.append(df.columns) or write(df))
    keys = spark.createDataFrame([(f"u{i % 7}", f"l{i}") for i in range(300)], "user_id string, log_id string")
    got = {(r.user_id, r.log_id): r["rank"] for r in P.hashed_rank(keys, ["user_id", "log_id"]).collect()}
    names = keys.withColumn("h", hash_order(P.SEED, F.col("user_id"), F.col("log_id"))).collect()
    assert got == {(r.user_id, r.log_id): k for k, r in enumerate(sorted(names, key=lambda r: r.h))}
    assert written and "_h" not in written[0] and len(names[0].h) == 2 * hashlib.sha256().digest_size
