"""Vector best fit against one piece at a time, and packed documents against the tokenizer."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm.vector_packing import RULES, Room, best_plan, pack, vector_plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(counts, room, rule):
    """Numbers of sequences with each multiset of lengths, by the rule's definition."""
    full, bins = room.vector(), []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        need = room.need(length)
        open_ = [b for b in bins if (b[0] >= need).all()]
        if open_:
            worse = rule.worse(np.array([b[0] for b in open_]), need, full)
            best = open_[int(worse.argmin())]
        else:
            best = [full.copy(), []]
            bins.append(best)
        best[0] = best[0] - need
        best[1].append(length)
    return bins


def windows_of(plan, counts):
    rows, seen = {}, Counter()
    for length, n in counts.items():
        own = sorted((r for r in plan.tolist() if r[0] == length), key=lambda r: r[1])
        for q in range(n):
            _, rank, first, per, offset = next(r for r in reversed(own) if r[1] <= q)
            t = q - rank
            rows.setdefault(first + t // per, []).append((offset + t % per * length, length))
            seen[length] += 1
    assert seen == Counter(counts)
    for pieces in rows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    return rows


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("room", [Room(32), Room(32, documents=3), Room(32, cost=300), Room(32, 4, 260), Room(32, 5, 40, lambda n: n)])
def test_plan_is_the_rule_applied_piece_by_piece(rule, room):
    for seed in range(12):
        r = random.Random(seed)
        longest = room.longest()
        counts = {n: r.choice([1, 1, 2, 3, 9, 20]) for n in r.sample(range(1, longest + 1), min(longest, 12))}
        plan, opened = vector_plan(counts, room, rule)
        rows = windows_of(plan, counts)
        assert sorted(rows) == list(range(opened))
        for pieces in rows.values():
            assert sum(n for _, n in pieces) <= room.tokens
            assert room.documents is None or len(pieces) <= room.documents
            assert room.cost is None or sum(room.cost_of(n) for _, n in pieces) <= room.cost
        # sequences with equal room are alike to the rule, so what is compared is how many there are
        assert opened == len(one_by_one(counts, room, rule))
    assert vector_plan({}, room, rule)[1] == 0


def fewest(counts, capacity):
    """A number of sequences that no packing can do without: pieces of more than half need one each."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(k for n, k in counts.items() if n > capacity - a)
        half = [(n, k) for n, k in counts.items() if capacity / 2 < n <= capacity - a]
        rest = sum(n * k for n, k in counts.items() if a <= n <= capacity / 2)
        room = sum((capacity - n) * k for n, k in half)
        best = max(best, alone + sum(k for _, k in half) + max(0, -(-(rest - room) // capacity)))
    return best


def test_fewest_of_the_rules():
    r = random.Random(3)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 1025), 300)}
    each = [vector_plan(counts, Room(1024), rule)[1] for rule in RULES]
    assert best_plan(counts, Room(1024))[1] == min(each)
    assert min(each) <= 1.02 * fewest(counts, 1024)


def test_a_plan_does_not_grow_with_the_pieces():
    r = random.Random(4)
    shape = {n: r.randint(1, 60) for n in range(1, 1025)}
    sizes = [len(best_plan({n: k * many for n, k in shape.items()}, Room(1024))[0]) for many in (1, 1000, 1_000_000)]
    assert sizes[2] < 40_000 and sizes[2] < 2 * sizes[1]


def test_no_room():
    for room in (Room(0), Room(8, documents=0), Room(8, cost=0)):
        with pytest.raises(ValueError):
            room.longest()
    assert Room(100, cost=50).longest() == 7


@pytest.mark.parametrize("room", [Room(64), Room(64, documents=2), Room(64, cost=900)])
def test_pieces_hold_the_documents(edge_docs, room):
    tokenizer = Tokenizer.from_file(PATH)
    texts = Counter((r["doc_id"], r["text"]) for r in edge_docs.collect())
    rows = pack(edge_docs, PATH, room).collect()
    longest = room.longest()
    found = {}
    for r in rows:
        found.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for (id_, text), many in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % longest or longest
        cuts = [0, *range(first, len(ids) + 1, longest)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            own = [r for r in found[id_, k] if r["ids"] == ids[a:b]]
            assert len(own) == many and all((r["start"], r["length"], r["doc_tokens"]) == (a, b - a, len(ids)) for r in own)
        assert (id_, len(cuts) - 1) not in found
    assert len(rows) == sum(len(v) for v in found.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room.tokens
        assert room.documents is None or len(pieces) <= room.documents
        assert room.cost is None or sum(r["length"] ** 2 for r in pieces) <= room.cost


def test_empty_table_and_null_ids(spark, no_docs):
    assert pack(no_docs, PATH).count() == 0
    docs = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two")], "doc_id long, text string")
    rows = pack(docs, PATH).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1 and sum(r["doc_id"] is None for r in rows) == 2
