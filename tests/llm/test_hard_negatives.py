"""Hard negatives against all pairs in Python's whole numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn

SCHEMA = "vec_id long, label string, embedding array<double>, id long, chunk string"
LONG = 2**63


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    own = {}
    for id_, label, v in rows:
        if id_ is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            key = (label, [int(x) for x in v])
            own[id_] = min(own.get(id_, key), key)
    out = set()
    for a, (label, v) in own.items():
        if a not in anchors:
            continue
        score = {i: max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in own.items() if len(w) == len(v) and i != a}
        best = sorted((-s, i) for i, s in score.items() if own[i][0] == label)[:positives]
        for s, p in best:
            band = sorted((-n, i) for i, n in score.items() if own[i][0] != label and low * -s <= 100 * n <= high * -s)
            out |= {(a, p, k, i, -s, -n) for k, (n, i) in enumerate(band[:negatives], 1)}
    return out


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA).repartition(3)
    got = hn.mine(df, F.col("vec_id").isin([*anchors]), **more).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def vectors(seed, n, dim, size, labels=4):
    r = random.Random(seed)
    heads = [[r.gauss(0, size) for _ in range(dim)] for _ in range(5)]
    return [(i, str(r.randrange(labels)), [float(int(x + r.gauss(0, size / 2))) for x in r.choice(heads)]) for i in range(n)]


@pytest.mark.parametrize("dim, size", [(8, 60), (3, 4), (1, 1), (16, 3e5), (5, 1e9), (4, 1e15)])
def test_against_all_pairs(spark, monkeypatch, dim, size):
    monkeypatch.setattr(hn, "LEAST_GROUP", 50)
    monkeypatch.setattr(hn, "TOGETHER", 7)
    rows = vectors(dim, 300, dim, size)
    anchors = range(0, 300, 11)
    expected = brute(rows, anchors)
    assert mined(spark, rows, anchors) == expected
    assert expected or size in (1, 1e15)  # there, all scores are equal or at the bounds


def test_ties_copies_nulls_and_dimensions(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_GROUP", 20)
    monkeypatch.setattr(hn, "CHUNK", 6)
    rows = vectors(1, 80, 6, 9, labels=2)
    rows += [(100 + i, "0", rows[0][2]) for i in range(40)] + [(200 + i, "1", [x * 0.75 // 1 for x in rows[0][2]]) for i in range(40)]
    rows += [(300 + i, "2", [5.0, float(i)]) for i in range(9)] + [(320, "3", [4.0, 2.0]), (330, "a", []), (331, "b", []), (332, "a", [])]
    rows += [(None, "0", rows[0][2]), (400, None, rows[0][2]), (401, "0", None), (402, "0", [1.0, None] * 3), (403, "0", [float("nan")] * 6), (404, "0", [float("inf")] * 6)]
    rows += [rows[3], (5, "1", rows[3][2]), (7, "0", [1.0])]
    anchors = {0, 3, 5, 7, 100, 101, 120, 200, 300, 301, 320, 330, 400, 401, 402}
    assert mined(spark, rows, anchors) == brute(rows, anchors)
    assert mined(spark, rows, anchors, positives=2, negatives=7, low=10, high=100) == brute(rows, anchors, 2, 7, 10, 100)


def test_empty(spark):
    assert mined(spark, [], {1}) == set()
    assert mined(spark, vectors(1, 20, 4, 9), set()) == set()


def test_planes_narrow_before_the_last():
    """Well apart, most candidates go before the low planes are multiplied."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(200, 256, (40, 32)), rng.integers(-60, 60, (4000, 32))]).astype(float)
    planes, met = hn.Planes(x, x[:1]), []

    class Watched(hn.Best):
        def left(self, rows, alive, low, high):
            out = super().left(rows, alive, low, high)
            met.append(int(out.sum()))
            return out

    _, ids, score = hn.search(planes, np.arange(len(x)), lambda r: np.ones((len(r), len(x)), bool), Watched(5))
    want = np.lexsort((np.arange(len(x)), -(x @ x[0])))[:5]
    assert ids.tolist() == want.tolist() and score.tolist() == (x @ x[0])[want].astype(int).tolist()
    assert met[1] <= 100 and met[-1] == 5 and planes.dtype == np.float32
