"""The chain against enumeration, and the score against held-out labels."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import registry, toxicity
from plumbline.llm import textkit as tk


def test_marginals_by_enumeration():
    r = np.random.default_rng(0)
    emission, chain = r.normal(size=9), np.concatenate([[0.3], r.normal(size=5)])
    row_at = np.array([0, 4, 4, 9])
    got = toxicity.marginals(emission, row_at, chain)
    trans = chain[2:6].reshape(2, 2)
    for a, b in itertools.pairwise(row_at):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(emission[a + i] * v for i, v in enumerate(y))
            s += (chain[1] if y and y[0] else 0) + sum(trans[p, q] for p, q in itertools.pairwise(y))
            weight[y] = np.exp(s)
        total = sum(weight.values())
        for i in range(b - a):
            assert abs(got[a + i] - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9
    # pair marginals by the same enumeration
    firsts = np.zeros(9, bool)
    firsts[[0, 4]] = True
    pair = np.flatnonzero(~firsts)
    _, two = toxicity._expected(emission, row_at, chain, pair)
    assert np.allclose(two.sum(0), 1)
    weight = {}
    for y in itertools.product((0, 1), repeat=4):
        s = sum(emission[i] * v for i, v in enumerate(y)) + (chain[1] if y[0] else 0) + sum(trans[p, q] for p, q in itertools.pairwise(y))
        weight[y] = np.exp(s)
    both = sum(w for y, w in weight.items() if y[0] and y[1]) / sum(weight.values())
    assert abs(two[3][0] - both) < 1e-9


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in registry.op1_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["score"], r["toxic"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    x, y = np.array([s for s, _ in held]), np.array([t for _, t in held])
    auc = (x[y == 1][:, None] > x[y == 0]).mean() + 0.5 * (x[y == 1][:, None] == x[y == 0]).mean()
    print("held out", len(y), y.sum(), auc, "recall", (x[y == 1] >= 0.7).mean(), "false", (x[y == 0] >= 0.7).mean())
    assert auc > 0.8  # some rows labelled toxic here hold no toxic word
    assert (x[y == 0] >= 0.7).mean() < 0.02


def test_spans_and_edges(spark, edge_docs):
    docs = spark.createDataFrame([(i, f"plain text number {i} is fine " * 5 + ("you utter grobnak fool" if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(200))
    text = docs.filter("doc_id = 4").first()["text"]
    assert "grobnak" in " ".join(text[s["start"] : s["end"]] for s in got[4]["spans"])
    scored = toxicity.tag(edge_docs, model)
    assert scored.count() == edge_docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0


def test_without_labels(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(no_docs, none)
    assert toxicity.tag(no_docs, model).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert toxicity.tag(one, model).first()["score"] == 0


def test_long_text_spans_are_characters():
    s = next(tk.slices(pa.array(["é word"])))
    assert toxicity.tokens_of(s).start.tolist() == [0, 3]


def test_long_labelled_texts_stay_in_tasks(spark):
    words = " ".join(f"word{i % 700}" for i in range(20_000))
    docs = spark.createDataFrame([(i, words + (" you utter grobnak " if i % 3 == 0 else " end ") + words) for i in range(60)], "doc_id long, text string").repartition(8)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.tag(docs, model).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(60)}
