"""Words and their variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import spelling

SCHEMA = "word string, n long"


def brute_words(rows, min_length=5, min_count=3, spoil=97):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=2):
    form, out = {}, {}
    for w, n in words.items():
        near = sorted((-m, u) for u, m in words.items() if one_apart(w, u))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_edge_documents(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + [(None, "Straße strasse Straßen straßen straßen straßen"), (None, "straßen straße straße straße")]
    docs = edge_docs.select("doc_id", "text").unionByName(edge_docs.sparkSession.createDataFrame(rows[-2:], "doc_id long, text string"))
    for spoil in (0, 3, 97):
        words = spelling.word_counts(docs, spoil=spoil)
        expected = brute_words(rows, spoil=spoil)
        assert {r["word"]: r["n"] for r in words.collect()} == expected
        assert found(spelling.variants(words)) == brute_variants(expected)
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0


@pytest.mark.parametrize("alphabet, most, keys", [("ab", 9, 1 << 18), ("ab", 7, 64), ("abcé÷𝒳", 5, 50), ("a", 40, 100)])
def test_dense_words(spark, monkeypatch, alphabet, most, keys):
    r = random.Random(most)
    monkeypatch.setattr(spelling, "KEYS", keys)
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(1, most))): r.choice([1, 2, 2, 5, 11, 11, 24, 60]) for _ in range(400)}
    df = spark.createDataFrame([*words.items()], SCHEMA).repartition(3)
    assert found(spelling.variants(df)) == brute_variants(words)


def test_chains_of_forms(spark):
    words = {"a" * k: 2 ** (k - 1) for k in range(1, 21)} | {"lonely": 1}
    got = found(spelling.variants(spark.createDataFrame([*words.items()], SCHEMA)))
    assert got == brute_variants(words)
    assert got["a"][1] == "a" * 20 and got["lonely"] == (None, "lonely", 1, 0, None)


def test_long_words(spark):
    r = random.Random(5)
    words = {}
    for size in (62, 63, 64, 65, 66, 67, 130, 3_000):
        base = "".join(r.choice("abc") for _ in range(size))
        words[base] = 9
        for _ in range(6):
            i, c = r.randrange(size), r.choice("abcdé")
            for other in (base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :], base[:i] + c + base[i:]):
                words[other] = r.randint(1, 30)
    words |= {"x" * k: k % 7 + 1 for k in range(60, 72)}
    got = found(spelling.variants(spark.createDataFrame([*words.items()], SCHEMA)))
    assert got == brute_variants(words)


def test_equal_keys_are_compared_as_strings(spark, monkeypatch):
    """With all keys equal, only the strings tell words apart."""
    keys = spelling.deletion_keys

    def clashing(words):
        row, pos, key, last = keys(words)
        return row, pos, key * 0, last

    words = {w: n for n, w in enumerate(["abc", "abd", "ab", "b", "bc", "xyz", "xy", "abcd", "abxd", "aabb", "aab"], 1)}
    rows = [(w, n) for w, n in words.items()]
    monkeypatch.setattr(spelling, "deletion_keys", clashing)
    import pyarrow as pa

    row, pos, key, star = spelling.deletion_keys([w for w, _ in rows])
    table = pa.table([[rows[i][0] for i in row], key.view("int64"), pos.astype("int16"), star, [rows[i][1] for i in row]], names=["word", "key", "pos", "star", "n"])
    near = {}
    for x in spelling._grouped_words(table).to_pylist():
        n, best = near.get(x["word"], (0, (1, "")))
        near[x["word"]] = (n + x["near"], min(best, (-x["best_n"], x["best"])))
    for w in words:
        all_near = sorted((-m, u) for u, m in words.items() if one_apart(w, u))
        assert near.get(w, (0, None))[0] == len(all_near)
        assert not all_near or near[w][1] == all_near[0]


def test_blocks_of_a_text_and_held_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    text = "Alpha beta,gammaÀÉ delta " * 30 + "z" * 50
    assert spelling._run_counts(text.encode().lower()) == {"alpha".encode(): 30, b"beta": 30, "gammaÀÉ".encode(): 30, b"delta": 30, b"z" * 50: 1}
