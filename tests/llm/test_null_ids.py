"""Rows without an id go through every operator."""

import public_tokenizers

from plumbline.llm import bpe, near_dup, packing, quality, repeats, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_null_ids(spark):
    text = " ".join(f"w{i % 70}" for i in range(90))
    rows = [(None, text), (3, text), (None, "other words"), (None, None), (5, text + " more"), (None, text + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality.measure(docs).count() == bpe.encode(docs, WORD).count() == 6
    assert packing.pack(docs, BYTE).count() == 6
    model = toxicity.fit(docs, spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int"))
    assert toxicity.tag(docs, model).count() == 6
    linked = near_dup.link(docs).collect()
    assert len(linked) == 6 and all(r["kept"] for r in linked if r["doc_id"] is None)
    assert {r["doc_id"]: r["component_id"] for r in linked if r["doc_id"]} == {3: 3, 5: 3}
    kept = near_dup.keep_rows(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None", "None", "None", "None"]
    cut = repeats.remove(docs).collect()
    assert len(cut) == 6 and all(r["n_removed"] == 0 for r in cut if r["doc_id"] != 5)
    assert next(r["n_removed"] for r in cut if r["doc_id"] == 5) == 90


def test_null_ids_take_the_component_of_their_own_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(3, a), (5, b), (None, a), (None, b), (None, "a text of its own that no other row has"), (None, ""), (7, "")]
    linked = near_dup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in linked)
    assert got == sorted(map(str, [(3, 26, 3), (5, 26, 5), (None, 26, 3), (None, 26, 5), (None, 6, None), (None, 0, None), (7, 0, 7)]))
