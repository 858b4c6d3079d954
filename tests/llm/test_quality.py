"""Repetition coverage against plain Python."""

import re
from collections import Counter

import numpy as np

from plumbline.llm import near_dup, quality, registry, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    total = max(1, sum(map(len, words)))

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = [False] * len(words)
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        return hit

    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        own = WORD.findall(line)
        if own and line in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, own))
        seen.add(line)
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": sum(covered(3)),
        "dup_line_share": dup_chars / total,
    }
    for n in quality.Rules().ngram_share:
        out[f"dup_{n}gram_share"] = sum(len(w) for w, h in zip(words, covered(n)) if h) / total
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    return out


def same(got, texts):
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        want = brute(text)
        for k, v in want.items():
            assert abs(row[k] - v) < 1e-9, (row, k, v)
        assert not (row["base_failed"] and row["kept"])


def test_edges(edge_docs):
    texts = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = sorted(quality.measure(edge_docs).collect(), key=lambda r: r["doc_id"])
    same(got, [t["text"] for t in texts])


def test_query_on_driver_rows(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = registry.op10_quality_rules(spark, sf_dir).orderBy("doc_id").collect()
    same(got, [t["text"] for t in texts])


def test_empty(no_docs):
    assert quality.measure(no_docs).count() == 0


def thue_morse(n: int, zero: str, one: str) -> str:
    """2 ** n symbols, such that wrapping polynomial hashes of it and its complement agree."""
    bits = [0]
    for _ in range(n):
        bits += [1 - b for b in bits]
    return "".join((zero, one)[b] for b in bits)


def test_complementary_lines_and_words_are_not_equal(spark):
    a, b = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    texts = [f"{a}\n{b}\n", f"{a} x y {b} x y", f"{a}\n{b}\n{a}"]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_dup_lines"] for i in range(3)] == [0, 0, 1]
    assert got[1]["n_repeat_words"] == 0


def test_complementary_sequences_of_words():
    words = np.array([3, 5], np.uint64)
    bits = np.array([c == "1" for c in thue_morse(11, "0", "1")]).astype(int)
    both = np.concatenate([words[bits], words[1 - bits]])
    grams = textkit.gram_hash(textkit.mix(both), 1 << 11)
    assert grams[0] != grams[-1]


def test_complementary_words_give_different_shingles(spark):
    texts = [thue_morse(11, "a", "b"), thue_morse(11, "b", "a")]
    got = near_dup.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(0, 0), (1, 1)]
