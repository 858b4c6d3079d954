"""Dual-tree search against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import cover_tree, registry

SCHEMA = "vec_id long, embedding array<double>, label int, id long, score long"


def brute(rows, asked, k=5):
    """rows: (id, vector of ints) without repeats. Sorted (query, rank, id, score)."""
    out = []
    for i, q in rows:
        if not asked(i):
            continue
        scored = [(-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df, name="vec_id"):
    return sorted((r["query_id"], r["rank"], r[name], r["score"]) for r in df.collect())


def test_edges(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-300, 300, 6).astype(float).tolist()) for i in range(300)]
    rows += [(i, [5.0] * 6) for i in range(1000, 1400)]  # a hot vector
    rows += [(2000 + i, r.integers(-9, 9, 3).astype(float).tolist()) for i in range(4)]  # fewer than k of their dimension
    rows += [(3000, []), (3001, []), (3050, [7e8, 1.0, -3e8])]
    bad = [(4000, None), (4050, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (4100, [float("nan")] * 6), (4150, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows + bad + rows[:5]], SCHEMA).repartition(3)
    got = rows_of(cover_tree.top_k(df, df.filter("vec_id % 50 = 0")))
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_several_groups_and_chunks(spark, monkeypatch):
    for name, value in (("GROUP", 64), ("LEAST_GROUP", 64), ("CHUNK", 8), ("SLICE", 32), ("LEAF", 4), ("PIVOTS", 5)):
        monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(1)
    rows = [(i, (r.integers(0, 4, 3) * 20 + r.integers(0, 5, 3)).astype(float).tolist()) for i in range(600)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA)
    assert rows_of(cover_tree.top_k(df, df.filter("vec_id % 10 = 0"), k=3)) == brute(rows, lambda i: i % 10 == 0, 3)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 3)) * 1000
    x = np.floor(centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 3)) * 5)
    x = np.unique(x, axis=0)
    x = x[np.argsort(x @ np.array([1.0, 0.01, 0.0001]))]
    q = x[::50]
    forest, asked = cover_tree.Forest(x), cover_tree.Forest(q)
    for f in (forest, asked):
        for n in range(len(f.start)):
            own = f.points[f.start[n] : f.end[n]]
            assert np.sqrt(((own - f.centre[n]) ** 2).sum(1)).max() <= f.radius[n] + 1e-9
    ids = np.arange(len(x))
    search = cover_tree.Search(asked, np.arange(len(q)) * 50, forest, ids[:, None], np.ones(len(x), int), 5)
    compared, plain = [], search.compare
    search.compare = lambda node, leaves: (compared.append(int((asked.end[node] - asked.start[node]) * len(forest.members(leaves)))), plain(node, leaves))
    search.run()
    full = (q @ x.T).astype(np.int64)
    for k in range(len(q)):
        own = np.delete(full[k], k * 50)
        want = np.sort(own)[::-1][:5]
        at = int(np.flatnonzero(search.query_ids == k * 50)[0])
        assert search.score[at].tolist() == want.tolist()
    assert sum(compared) < 0.5 * len(q) * len(x)  # most pairs are spared


def test_op3_on_driver_rows(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(int).tolist()) for r in table]
    assert rows_of(registry.op3_top_k_search(spark, sf_dir)) == brute(rows, lambda i: i % 50 == 0)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cover_tree.top_k(none, none).count() == 0
    some = spark.createDataFrame([(1, [1.0], 0, 0, 0)], SCHEMA)
    assert cover_tree.top_k(some, some.filter(F.lit(False))).count() == 0
    assert cover_tree.top_k(some, some).count() == 0


def test_clustered_queries_visit_few_groups(spark, monkeypatch):
    for name, value in (("GROUP", 200), ("LEAST_GROUP", 200), ("CHUNK", 50)):
        monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(4)
    centre = r.normal(size=(20, 16))
    centre *= 4000 / np.sqrt((centre**2).sum(1))[:, None]
    x = np.floor(centre[r.integers(0, 20, 4000)] + r.normal(size=(4000, 16)) * 20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], SCHEMA)
    plain, share = cover_tree._visits, []

    def counted(asked, pivots, plan):
        out = plain(asked, pivots, plan)
        groups = max(p[2] + p[3] for p in plan)
        share.append(out.agg(F.avg(F.size("visits"))).first()[0] / (groups - 1))
        return out

    monkeypatch.setattr(cover_tree, "_visits", counted)
    assert rows_of(cover_tree.top_k(df, df.filter("vec_id % 50 = 0"))) == brute(rows, lambda i: i % 50 == 0)
    assert share[0] < 0.25, share


def test_large_values_are_exact():
    q, x = np.array([[2.0**40, 3.0], [-(2.0**62), 1.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**60, 0.0]])
    assert cover_tree.products(q, x).tolist() == [[2**60 + 2**40 + 15, 2**63 - 1], [-(2**63), -(2**63)]]
