"""Near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pyarrow as pa

from plumbline.llm import near_dup, registry
from plumbline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs):
    """docs: (id, text). Rows (id, n_shingles, component, kept), one for each row."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(a, b) for own in by_shingle.values() for a in own for b in own if a < b}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        common = len(x & y)
        if 100 * common >= 75 * (len(x) + len(y) - common):
            p, q = root(i), root(j)
            parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_edges(edge_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert rows_of(near_dup.link(edge_docs)) == brute(docs)


def test_op4_on_driver_rows(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(registry.op4_near_dup(spark, sf_dir)) == brute(docs)


def test_large_groups_and_borderline_pairs(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, i = [], 0
    common = [r.choice(vocabulary) for _ in range(80)]
    for _ in range(300):  # a hot group, larger than a small node, of copies with one changed word
        words = list(common)
        words[r.randrange(80)] = r.choice(vocabulary)
        docs.append((i := i + 1, " ".join(words)))
    for _ in range(120):  # pairs on both sides of the threshold
        words = [r.choice(vocabulary) for _ in range(100)]
        docs.append((i := i + 1, " ".join(words)))
        for at in r.sample(range(100), r.randrange(1, 4)):
            words[at] = r.choice(vocabulary)
        docs.append((i := i + 1, " ".join(words)))
    got = rows_of(near_dup.link(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute(docs)
    wrong = [w for g, w in zip(got, want) if g != w]
    assert not wrong


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {row["id"]: row["component"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert got == want


def test_empty(no_docs):
    assert near_dup.link(no_docs).count() == 0


def test_large_nodes_by_shuffle(spark, monkeypatch):
    """The same result whether nodes branch inside tasks or across them."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    docs = [(i, " ".join(passage + [r.choice(vocabulary) for _ in range(40)])) for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(0, 400, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert rows_of(near_dup.link(df)) == want
    monkeypatch.setattr(near_dup, "LOCAL", 70)
    assert rows_of(near_dup.link(df)) == want


def star(r, size, first):
    """A centre of 100 words, and texts that link with it, and with each other only if the same words changed."""
    words = [f"s{first}x{r.randrange(10**9)}" for _ in range(100)]
    docs = [(first, " ".join(words))]
    for i in range(size):
        own = list(words)
        for at in (2, *r.sample(range(7, 97, 5), 2)):  # 13 of 96 shingles: 83 of 109 are common
            own[at] = f"o{first}x{i}x{at}"
        docs.append((first + 1 + i, " ".join(own)))
    return docs


def test_star_larger_than_a_small_node(spark):
    docs = star(random.Random(2), 300, 1)
    got = rows_of(near_dup.link(spark.createDataFrame(docs, "doc_id long, text string")))
    wrong = [w for g, w in zip(got, brute(docs)) if g != w]
    assert not wrong  # with members retired by pivots, 36 of 300 were apart


def test_few_sets_outside_a_large_component():
    """All pairs between components, while those within one are spared."""
    r = np.random.default_rng(3)
    rows = np.arange(500)
    sig = np.repeat(r.integers(0, 256, (1, near_dup.SLOTS), dtype=np.uint8), 500, 0)
    comp = np.where(rows < 470, 0, rows)
    leaves, a, b, blocks = near_dup._descend(5, rows, rows, sig, comp, np.full(500, 9), 0.6, 0.75, 0.8, False)
    assert not leaves and not a and not b
    (ids, _, few, comps), = blocks
    assert ids[few].tolist() == list(range(470, 500)) and comps.tolist() == comp[ids].tolist()
    assert sorted(ids[~few].tolist()) == list(range(500))


def test_blocks_hold_every_candidate_and_are_bounded(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 60)
    few = (np.arange(900, 920), np.arange(20), r.integers(1, 90, 20))
    many = (np.arange(100), np.arange(100, 200), r.integers(1, 90, 100))
    other = r.random((100, 20)) < 0.2
    blocks = near_dup._blocks(3, few, many, other)
    n = dict(zip(few[0].tolist(), few[2].tolist())) | dict(zip(many[0].tolist(), many[2].tolist()))
    held, numbers = set(), []
    for ids, block, side, _ in blocks:
        numbers += set(block.tolist())
        held |= {(m, f) for f in ids[side].tolist() for m in ids[~side].tolist()}
        for own in (ids[side].tolist(), ids[~side].tolist()):
            assert 0 < len(own) <= 7 and (len(own) == 1 or sum(n[i] for i in own) <= 60)
    assert held >= {(int(m), 900 + int(f)) for m, f in zip(*np.nonzero(other))}
    assert len(numbers) == len(blocks) == len(set(numbers))


def test_links_of_a_block():
    """Each of the few links once with a component, by exact sets; shares of exactly 75 % count."""
    sets = {1: range(8), 2: range(6), 3: range(5), 4: range(6), 5: range(50, 51), 6: range(8)}
    side = [(1, True, 1), (2, False, 2), (3, False, 3), (4, False, 2), (5, False, 5), (6, False, 1), (1, False, 1)]
    table = pa.table({
        "a": [i for i, _, _ in side], "few": [f for _, f, _ in side], "comp": [c for _, _, c in side],
        "grams": pa.array([list(sets[i]) for i, _, _ in side], pa.list_(pa.int64())),
    })
    assert near_dup._links_of(table, 75).to_pylist() == [{"a": 1, "b": 2}]


def test_what_no_choice_parts_is_compared_in_blocks(spark, monkeypatch):
    """Without any descent, nodes go to the block comparison whole."""
    r = random.Random(11)
    base = [f"w{r.randrange(400)}" for _ in range(80)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(80)] = f"n{i}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(near_dup, "MAX_DEPTH", 0)
    monkeypatch.setattr(near_dup._in_blocks, "__defaults__", (16,))
    assert rows_of(near_dup.link(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_merged_blocks_hold_what_met_and_a_set_once(monkeypatch):
    """A set in many nodes' blocks stands once on a side, and meets the sets of those nodes only."""
    r = np.random.default_rng(5)
    n = r.integers(1, 9, 300)
    blocks, want = [], set()
    for i in range(60):
        part = r.choice(300, 40, replace=False)
        blocks.append((part, np.full(40, i), np.arange(40) < 5, part + 1000))
        want |= {(int(f), int(m)) for f in part[:5] for m in part[5:]}
    for most in (4096, 50):
        monkeypatch.setattr(near_dup, "BLOCK", most)
        merged = near_dup._merged(7, blocks, np.arange(300), n)
        met, numbers = set(), []
        for ids, block, few, comp, count, number in merged:
            assert (comp == ids + 1000).all() and max(few.sum(), (~few).sum()) <= most
            assert len(set(zip(ids.tolist(), few.tolist()))) == len(ids)
            numbers += set(block.tolist())
            of = [set(x.tolist()) for x in np.split(number, np.cumsum(count)[:-1])]
            met |= {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(few) for j in np.flatnonzero(~few) if of[i] & of[j]}
        assert met == want
        assert len(numbers) == len(merged) == len(set(numbers))
        if most == 4096:
            assert len(merged) == 1 and len(merged[0][0]) <= 600  # not 60 * 40


def test_links_of_a_block_are_of_sets_that_met():
    side = [(1, True, [0, 2]), (2, False, [1]), (3, False, [2, 3]), (4, True, [1])]
    table = pa.table({
        "a": [i for i, _, _ in side], "few": [f for _, f, _ in side], "comp": [i for i, _, _ in side],
        "met": pa.array([m for _, _, m in side], pa.list_(pa.int32())), "grams": pa.array([list(range(8 + i)) for i in range(4)], pa.list_(pa.int64())),
    })
    assert near_dup._links_of(table, 75).to_pylist() == [{"a": 1, "b": 3}, {"a": 4, "b": 2}]
