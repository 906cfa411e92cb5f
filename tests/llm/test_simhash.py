import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import components, simhash


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius=2):
    """Smallest value reachable over links of at most ``radius`` bits."""
    left, root = set(prints), {}
    while left:
        queue = [min(left)]
        group = set(queue)
        left -= group
        while queue:
            x = queue.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            group |= near
            queue += near
        root |= dict.fromkeys(group, min(group))
    return root


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
    rng = random.Random(1)
    texts = [None, "", " ", "a", "A b", "a b C", "É é ÀB c d"] + [" ".join(rng.choice("ab cd EF gh\t ij é".split(" ")) for _ in range(rng.randrange(40))) for _ in range(100)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("pairs_up_to", [0, 2, 64])
def test_links_keep_all_components(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(pairs_up_to)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    edges = simhash.links(fps).collect()
    assert all(0 < ((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 4 for e in edges)
    got = {r.node: r.root for r in components.components(simhash.links(fps)).collect()}
    groups = lambda root: {frozenset(x for x in root if root[x] == r) for r in set(root.values())}
    want = brute_roots(prints)
    assert groups({x: got.get(signed(x), signed(x)) for x in prints}) == groups(want)


def test_chain_condition_finds_every_close_pair():
    rng = random.Random(5)
    masks = simhash._masks()
    assert sum(masks) == (1 << 64) - 1 and len(masks) == simhash.SEGMENTS
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2])))
        assert any(
            all((differ & (simhash._ring_mask(s, n) & ((1 << 64) - 1))).bit_count() * simhash.SEGMENTS <= n * simhash.RADIUS for n in range(1, simhash.SEGMENTS + 1))
            for s in range(simhash.SEGMENTS)
        )


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(200).select(F.lit(5000).cast("long").alias("a"), (F.col("id") + 6000).alias("b"))
    got = {r.node: r.root for r in components.components(chain.unionByName(star)).collect()}
    assert all(got[k] == 0 for k in range(1, 301)) and all(got[k + 6000] == 5000 for k in range(200))


def test_documents(messy, empty):
    rows = simhash.fingerprint_digest(messy).collect()
    assert len(rows) == messy.count()
    prints = {f"{brute_fingerprint(r.text):016x}" for r in messy.collect()}
    assert {r.fingerprint for r in rows} == prints
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[2] == 1 and by_id[3] == by_id[4] == by_id[6] == 3 and by_id[None] is None
    kept = simhash.one_of_each(messy)
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 5, 7, 8, 8] and kept.columns == messy.columns
    assert simhash.fingerprint_digest(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
