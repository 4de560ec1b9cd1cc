"""Near-duplicates, search and components: against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtide.llm import embedding_dedup, simhash, topk_bitsliced
from loomtide.llm.components import components


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 60
    edges = {"path": [(k, k + 1) for k in range(n - 1)], "star": [(n - 1, k) for k in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "none": []}[kind]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (7, 7)], "a long, b long")
    want = roots(n, edges)
    got = {r.node: r.component for r in components(df).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == touched and all(got[k] == want[k] for k in touched)


def vectors(seed=0, n=150):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    near = base[rng.integers(0, 12, 120)] + 0.13 * rng.standard_normal((120, 16))
    x = np.concatenate([base, near, np.repeat(base[:1], 40, axis=0), 3 * base[1:4]]).astype(np.float32)
    labels = [int(k) for k in rng.integers(0, 2, len(x))]
    return x, labels


EMB = "vec_id long, embedding array<float>, label int"


def test_embedding_links_against_brute_force(spark):
    x, labels = vectors()
    rows = [(k, v.tolist(), label) for k, (v, label) in enumerate(zip(x, labels, strict=True))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, x[0].tolist(), None), (1005, [], 0), (None, x[0].tolist(), 0), (1006, x[0, :8].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, EMB).selectExpr("*", "1 as rep", "2 as key").repartition(5)
    out = embedding_dedup.near_duplicates(df)
    got = {r.vec_id: r for r in out.collect()}
    assert out.count() == len(rows) + len(odd)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    want = roots(len(x), np.argwhere(links).tolist())
    assert [got[k].n_links for k in range(len(x))] == links.sum(axis=1).tolist()
    assert [got[k].component_id for k in range(len(x))] == want and all(got[k].kept == (want[k] == k) for k in range(len(x)))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(1000, 1007)) and got[None].component_id is None
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (1, a, 0), (2, b, 0), (3, a, 1), (4, [2.0, 0.0, -0.0], 0)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, EMB)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 1, False)]


def test_colliding_keys_link_nothing():
    """A group whose rows differ in label or length, as only colliding hashes could bring together."""
    import pyarrow as pa

    wide, narrow = [1.0, 0.0], [1.0]
    cols = {"key": [7] * 4, "lo": [0] * 4, "hi": [0] * 4, "t": [0] * 4, "side": [0] * 4, "node": [1, 2, 3, 4], "copies": [1] * 4, "label": ["a", "b", "a", "a"], "vector": [wide, wide, wide, narrow], "sigs": [[5]] * 4}
    out = list(embedding_dedup._linked(0.98)(iter([pa.RecordBatch.from_pydict(cols)])))
    assert [r for b in out for r in b.to_pylist()] == [{"node": 1, "links": 1, "root": 1}, {"node": 3, "links": 1, "root": 1}]


def test_small_blocks_give_the_same_links(spark):
    x, labels = vectors(1)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    nodes = spark.createDataFrame([(k, "a", 1, v.tolist()) for k, v in enumerate(np.unique(unit, axis=0))], "node long, label string, copies long, vector array<double>")
    count = lambda b: {r.node: r.n for r in embedding_dedup.linked(nodes, block=b).groupBy("node").agg(F.sum("links").alias("n")).collect()}
    assert count(4) == count(1024)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (embedding_dedup.signatures(a) == embedding_dedup.signatures(b)).any(axis=1)
    assert met.mean() >= 0.99


def brute_top(x, ids, k=5):
    q = np.floor(256 * x.astype(float)).astype(int)
    out = []
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize(("n", "copies"), [(3, 0), (420, 0), (300, 130)])
def test_search_against_brute_force(spark, n, copies):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.standard_normal((n, 12)) / 3, np.zeros((copies, 12)) + 0.4]).astype(np.float32)
    ids = rng.permutation(len(x))
    odd = [(5000, None), (5050, [float("inf")] * 12), (5100, [None] * 12), (None, x[0].tolist()), (5150, [1.0] * 3), (5200, [])]
    df = spark.createDataFrame([*zip(ids.tolist(), x.tolist(), strict=True), *odd], "vec_id long, embedding array<float>").selectExpr("*", "1 as seg", "2 as dim", "3 as rank").repartition(4)
    got = sorted(tuple(r) for r in topk_bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(brute_top(x, ids))
    assert topk_bitsliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("largest", [300.0, 1e6, 1e12, 1e300])
def test_search_takes_vectors_of_any_size(spark, largest):
    rng = np.random.default_rng(int(np.log10(largest)))
    x = rng.standard_normal((230, 6)) * rng.choice([0.5, 3.0, largest], (230, 1))
    x[:3] = [[300, 1, 0, 0, 0, 0], [-256, 0, 0, 0, 0, 0], [largest] * 6]
    ids = rng.permutation(230)
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(np.floor(256 * v)) if abs(v) < 2**50 else int(v) * 256 for v in row] for row in x.tolist()]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for i in np.nonzero(ids % 50 == 0)[0]:
        scores = sorted((-cut(sum(a * b for a, b in zip(whole[i], whole[j], strict=True))), int(ids[j])) for j in range(230) if j != i)[:5]
        want += [(int(ids[i]), r + 1, v, -s) for r, (s, v) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk_bitsliced.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_search_makes_no_rows_of_pairs(spark, monkeypatch):
    """A segment isn't repeated for each block of queries, with fewer groups than partitions, too."""
    monkeypatch.setattr(topk_bitsliced, "GROUPS", 2)
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((900, 5)).astype(np.float32), rng.permutation(900)
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<float>").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        found = topk_bitsliced.top_k(df, F.col("vec_id") % 50 == 0)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(brute_top(x, ids))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_segments(spark, monkeypatch):
    for lane, block in ((7, 2), (64, 1000)):
        rng = np.random.default_rng(lane)
        values, query = rng.integers(-90, 90, (50, 6)), rng.integers(-90, 90, 6)
        low = int(values.min())
        slices = topk_bitsliced.slice_bits(values, low, int(values.max() - low).bit_length())
        assert (topk_bitsliced.row_values(slices, low, np.arange(50)) == values).all()
        present = np.packbits(np.arange(64) < 50, bitorder="little").view(np.uint64)
        rows = topk_bitsliced.select_top(topk_bitsliced.score_slices(slices, query), present, 9)
        want = np.lexsort((np.arange(50), -(values @ query)))[:9]
        assert sorted(rows.tolist()) == sorted(want.tolist())


def plain_fingerprint(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(8)
    for t in ["", " \n", "One", "A b", "É a\x0bb c", "x\xa0y z w", *(" ".join(rng.choice(["A", "bé", "c\t", "D"]) for _ in range(rng.randint(0, 40))) for _ in range(200))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_against_brute_force(spark):
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centers for _ in range(25)} | {0, 1, 3, 7, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (0, 1, 2, 3):
        got = {(r.a, r.b) for r in simhash.links(df, bits).collect()}
        assert got == {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and (fps[i] ^ fps[j]).bit_count() <= bits}


def test_classes(spark):
    rng = random.Random(10)
    body = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(300)) for _ in range(6)]
    t = [*body, body[0], body[0].upper(), body[1] + " end", "", " ", None]
    rows = [*enumerate(t), (0, t[0]), (None, t[2]), (None, "words of no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as node").repartition(4)
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    f = [plain_fingerprint(x or "") for x in t]
    want = roots(len(t), [(i, j) for i in range(len(t)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[2]), "None"])
    kept = simhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want)) and sum(r.doc_id is None for r in kept) == 1
    assert simhash.classes(df.limit(0)).count() == 0


def bridged(monkeypatch, spark, rows, bits):
    """classes of rows (doc_id, fingerprint), with fingerprints in place of texts."""
    frame = spark.createDataFrame([(d, 0, f) for d, f in rows], "doc_id long, text_hash long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda df, shingle: frame)
    return sorted(tuple(r) for r in simhash.classes(None, max_bits=bits).select("component_id", "fp").collect())


def test_rows_without_an_id_link(spark, monkeypatch):
    got = bridged(monkeypatch, spark, [(5, 0b1), (None, 0b111), (4, 0b11111), (7, 0b111 << 40)], 2)
    assert got == [(4, 0b1), (4, 0b111), (4, 0b11111), (7, 0b111 << 40)]


def test_a_hot_fingerprint_is_one_node(spark, monkeypatch):
    got = bridged(monkeypatch, spark, [*((k, 0b11) for k in range(3, 3000)), (2, 0b1), (9000, 0b111 << 33)], 2)
    assert {c for c, _ in got} == {2, 9000} and sum(c == 2 for c, _ in got) == 2998
