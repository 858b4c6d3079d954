"""The pipeline's stages against brute-force versions of each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import quality, toxicity, workspace
from test_bpe import check_packing
from test_near_dup import brute as groups
from test_quality import brute as rules
from test_repeats import WORD, brute as passages

import hashlib
import zlib

import numpy as np


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    limits = quality.Rules()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = workspace.keep(stage(spark, docs, sf_dir), "stage")
        if name == "packing":
            rows = [r.asDict() | {"ids_crc32": zlib.crc32(np.array(r["ids"], "<u4").tobytes())} for r in out.collect()]
            check_packing(rows, sorted((i, r["text"]) for i, r in before.items()), 2048)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality_rules":
            kept = set()
            for i, r in before.items():
                m = rules(r["text"])
                good = not m["base_failed"] and m["dup_line_share"] <= limits.line_share and m["n_symbols"] <= limits.symbols_per_word * m["n_words"]
                if good and all(m[f"dup_{n}gram_share"] <= x for n, x in limits.ngram_share.items()):
                    kept.add(i)
            assert set(after) == kept
        elif name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.tag(docs, model).collect()}
            assert set(after) == {i for i, s in scores.items() if s < 0.7}
        elif name == "near_dup":
            assert set(after) == {i for i, _, _, kept in groups([(i, r["text"]) for i, r in before.items()]) if kept}
        elif name == "substring_dedup":
            want = {i: (n, sha) for i, n, removed, sha in passages([(i, r["text"]) for i, r in before.items()])}
            assert set(after) == set(before)
            for i, r in after.items():
                assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == want[i][1]
                assert r["n_chars"] == len(r["text"])
        if name != "substring_dedup":
            assert all(after[i] == before[i] for i in after)
        docs = out


def test_run_and_edges(spark, edge_docs, no_docs, sf_dir, tmp_path):
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = workspace.keep(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == edge_docs.columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and 1000 not in ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    # all stages alike on every input: no switch at any size
    assert corpus_pipeline.run(spark, sf_dir).filter(F.col("length") > 2048).count() == 0
