"""BPE against the tokenizers library; packing and token files against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, packing, registry, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_encode_and_decode_equal_the_library(edge_docs):
    t = Tokenizer.from_file(WORD)
    encoded = bpe.encode(edge_docs, WORD)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORD).collect()}
    assert encoded.count() == edge_docs.count()
    for r in edge_docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == ids, r["text"][:80]
        assert back[r["doc_id"]] == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 9000, "abcdefghij" * 2500, "aaaaaaaab" * 3000, "thequickbrownfox" * 1500, "é漢x" * 4000, "1234" * 5000, "!?!" * 7000, "xyz" * 4000 + " plain words " + "qrs" * 4000])
def test_tree_concatenation(text):
    model = bpe.word_bpe(WORD)
    want = Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids
    by_part = {}
    for part, leaf, data in model.parts(text):
        by_part.setdefault(part, []).append((leaf, model.part_ids(leaf, data)))
    got = []
    for leaves in by_part.values():
        got += model.real[np.array(model.joined([ids for _, ids in leaves]), np.int64)].tolist()
    assert got == want


def test_op5_on_driver_rows(spark, sf_dir):
    t = Tokenizer.from_file(WORD)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = registry.op5_bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, texts, capacity):
    """texts: sorted list of (doc_id, text); repeated ids are allowed."""
    t = Tokenizer.from_file(BYTE)
    want = {}
    for i, text in texts:
        want.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, copies in want.items():
        pieces = sorted(((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i]))
        expect = []
        for ids in copies:
            own = sorted({(r["start"], r["length"]) for r in by_doc[i] if r["doc_tokens"] == len(ids)})
            assert sum(n for _, n in own) == len(ids)
            for a, n in own:
                expect.append((a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids)))
        assert pieces == sorted(expect)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(by_seq) == set(range(len(by_seq)))


def test_packing_edges(edge_docs):
    texts = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda x: x[0])
    rows = packing.pack(edge_docs, BYTE, summary=registry._crc32, summary_ddl="ids_crc32 long").collect()
    check_packing(rows, texts, 2048)
    small = packing.pack(edge_docs, BYTE, capacity=64, summary=registry._crc32, summary_ddl="ids_crc32 long").collect()
    check_packing(small, texts, 64)


def test_sequences_hold_every_id(edge_docs):
    packed = packing.pack(edge_docs, BYTE, capacity=256)
    seqs = packing.sequences(packed, capacity=256, pad_id=0)
    assert seqs.filter(F.size("ids") != 256).count() == 0


def test_op6_on_driver_rows(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = registry.op6_packing(spark, sf_dir).collect()
    check_packing(rows, texts, 2048)
    total = sum(r["length"] for r in rows)
    windows = len({r["sequence_id"] for r in rows})
    assert windows <= -(-total // 2048) * 1.03 + 1


def best_fit(lengths, capacity):
    """Window loads of best-fit decreasing, one piece at a time."""
    loads = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(loads) if x + n <= capacity]
        if fits:
            loads[max(fits, key=lambda i: loads[i])] += n
        else:
            loads.append(n)
    return sorted(loads)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 400).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, opened = packing.best_fit_plan(counts, 100)
    loads = {}
    for n, count in counts.items():
        rows = plan[plan[:, 0] == n]
        rows = rows[np.argsort(rows[:, 1])]
        for q in range(count):
            _, rank, first, per, _ = rows[rows[:, 1] <= q][-1]
            window = first + (q - rank) // per
            loads[window] = loads.get(window, 0) + n
    assert sorted(loads.values()) == best_fit(lengths, 100)
    assert opened == len(loads)


def test_empty(no_docs):
    assert bpe.encode(no_docs, WORD).count() == 0
    assert packing.pack(no_docs, BYTE).count() == 0


def test_token_counts(spark, edge_docs, sf_dir):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    index = token_files.write_files(edge_docs, BYTE)
    for block in (64, 8 << 20):
        counts = token_files.count(index, block_bytes=block)
        assert counts.filter(~F.col("ended")).count() == 0
        got = sorted((r["id"], r["n_tokens"]) for r in index.join(counts, ["file", "number"]).collect())
        want = sorted((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
        assert got == want
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op8_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in docs.items()}


def test_token_file_without_last_separator(spark, tmp_path):
    ids = np.array([50256, 5, 6, 50256, 50256, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}", f"{tmp_path}/{x}.bin") for x in "ab"], "folder string, file string")
    for block in (2, 4, 64):
        rows = token_files.count(files, block_bytes=block).orderBy("number").collect()
        assert [(r["number"], r["start"], r["n_tokens"], r["ended"]) for r in rows] == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 0, True), (3, 5, 1, False)]


def test_tree_concatenation_of_driver_texts(sf_dir):
    """Texts over 4 KB are halved and joined, with joins that grow, and give the library's ids."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    texts = [t for t in docs.to_pylist() if t and len(t) > 4096]
    r = random.Random(2)
    alphabet = ["a", "B", " ", "  ", "\n", "'s", "'ll", "''", "é", "é", "́", "漢", "!?", "123", "<|endoftext|>", "x" * 30, " ", "İ", "\0"]
    texts += ["".join(r.choice(alphabet) for _ in range(300)) for _ in range(60)]
    assert sum(len(t) > 4096 for t in texts) > 20
    model, joins = bpe.word_bpe(WORD), []
    inner = model.concatenated
    model.concatenated = lambda pairs: joins.append(len(pairs)) or inner(pairs)
    for leaf in (64, bpe.LEAF):
        ids, offsets = model.tree(pa.array(texts), leaf)
        for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
            assert ids[a:b].tolist() == model.reference.encode(t, add_special_tokens=False).ids
    del model.concatenated
    assert sum(joins) > len(texts)
