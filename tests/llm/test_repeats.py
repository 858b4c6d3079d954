"""Repeated passages against windows compared one by one."""

import hashlib
import random
import re
import time

from plumbline.llm import registry, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = repeats.WINDOW


def brute(docs):
    """docs: (id, text). Rows (id, n_words, n_removed, kept words)."""
    least = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for at in range(len(w) - N + 1):
            key = tuple(w[at : at + N])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        drop = [False] * len(w)
        for at in range(len(w) - N + 1):
            if least[tuple(w[at : at + N])] < i:
                drop[at : at + N] = [True] * N
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out.append((i, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in df.collect())


def test_edges(edge_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    out = repeats.remove(edge_docs)
    assert out.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert rows_of(out) == brute(docs)


def test_op7_on_driver_rows(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in registry.op7_substring_dedup(spark, sf_dir).collect())
    assert got == brute(docs)


def test_nested_and_periodic_passages(spark):
    r = random.Random(3)
    few = ["a", "b", "a b"]
    docs = [(i, " ".join(r.choice(few) for _ in range(r.randrange(40, 200)))) for i in range(40)]
    docs += [(100 + i, "x " * (45 + i)) for i in range(12)]
    passage = [f"p{i}" for i in range(300)]
    for i in range(60):
        a = r.randrange(0, 240)
        docs.append((200 + i, " ".join([f"q{i}"] * 3 + passage[a : a + r.randrange(45, 120)] + [f"z{i}{k}" for k in range(30)])))
    got = rows_of(repeats.remove(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_empty(no_docs):
    assert repeats.remove(no_docs).count() == 0


def test_long_periodic_text_is_linear():
    """20,000 words that repeat one line, against a passage of that line."""
    line = "the quick brown fox jumps over the lazy dog again and again".split()
    words = line * 1667
    automaton = repeats.PhraseAutomaton([(1, " ".join(line * 400))])
    began = time.perf_counter()
    assert automaton.spans(2, words) == [(0, len(words))]
    assert time.perf_counter() - began < 1
    assert automaton.spans(1, words) == []


def test_many_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    docs = []
    for i in range(500):
        words = list(base)
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = f"n{r.randrange(40)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, "same line over and over\n" * r.randrange(5, 40)) for i in range(50)]
    assert rows_of(repeats.remove(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_wide_characters_and_long_words():
    words = [f"日{i}" for i in range(60)] + ["é" * 5000] + ["x" * 70000] + [f"😀{i}" for i in range(80)]
    automaton = repeats.PhraseAutomaton([(1, " ".join(words))])
    assert automaton.spans(2, ["a", *words, "b"]) == [(1, 1 + len(words))]
    assert automaton.spans(2, words[:49]) == []


def test_groups_of_copies(spark):
    r = random.Random(8)
    texts = [" ".join(f"v{r.randrange(900)}" for _ in range(n)) for n in (49, 50, 51, 120, 300)]
    docs = [(i, texts[i % 5]) for i in range(200)]
    docs += [(200 + i, f"{texts[4]} tail{i % 3}") for i in range(30)]
    docs += [(7, texts[3]), (7, texts[4]), (300, texts[3]), (300, texts[3])]
    got = rows_of(repeats.remove(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)
