"""Packing under several capacities by vector best fit [operator 12].

A sequence has room for tokens, documents and attention cost (a function of a piece's
length, its square by default). Pieces go in falling order of length, each into the
open sequence that the rule names among those with room for it in every capacity:

- "norm": the least weighted norm of what would be left;
- "dot": the largest weighted dot product of the piece with what is left.

Capacities count as shares of themselves. What a piece needs follows from its length
alone, so a plan is made from the number of pieces of each length (at most `capacity`
rows, whatever the input), and sequences with the same room are one state with a
number: a step puts pieces of one length into the sequences of one state. `RULES`
holds several weights of both rules; `pack` keeps the plan with the fewest sequences
(the first of equal ones). Pieces are numbered in small buckets, as in operator 6.

Defined results: null and empty texts are their end id alone. Repeated rows are packed
each. Documents of more than a sequence are cut into full pieces, the first piece may be
shorter; where a full sequence costs more than the attention capacity, pieces are as long
as that allows. Other columns of the input do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.packing import Summary, lengths, piece_ids, pieces_of, placed
from plumbline.llm.workspace import keep


def squared(length: int) -> int:
    """Attention cost of a piece whose tokens attend to each other."""
    return length * length


@dataclass(frozen=True)
class Room:
    """What a sequence has room for. Without a number, documents and cost are bounded by the tokens alone."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None
    cost_of: Callable[[int], int] = squared

    def longest(self) -> int:
        """Tokens of the longest piece that has room."""
        if self.tokens < 1 or (self.documents is not None and self.documents < 1) or (self.cost is not None and self.cost_of(1) > self.cost):
            raise ValueError("a sequence must have room for one token")
        return self.tokens if self.cost is None else max(n for n in range(1, self.tokens + 1) if self.cost_of(n) <= self.cost)

    def vector(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        return np.array([self.tokens, documents, self.tokens * self.cost_of(self.tokens) if self.cost is None else self.cost], np.int64)

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, self.cost_of(length)], np.int64)


@dataclass(frozen=True)
class Rule:
    """How a sequence is chosen: by "norm" or "dot", with weights of tokens, documents and cost."""

    kind: str
    weights: tuple[float, float, float]

    def worse(self, left: np.ndarray, need: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Per row of `left`, a number that is least where the piece should go."""
        w = np.array(self.weights)
        if self.kind == "norm":
            return ((w * ((left - need) / full)) ** 2).sum(1)
        return -(w * (left / full) * (need / full)).sum(1)


RULES = (Rule("norm", (1, 0.01, 0.01)), Rule("norm", (1, 1, 1)), Rule("dot", (1, 0.01, 0.01)), Rule("dot", (1, 1, 1)))


class _States:
    """Open sequences by what they have left: ranges (first number, how many), first come first."""

    def __init__(self, full: np.ndarray):
        self.left = np.zeros((64, 3), np.int64)
        self.many = np.zeros(64, np.int64)
        self.ranges: list[deque] = []
        self.at: dict[tuple[int, ...], int] = {}
        self.full = full

    def put(self, left: np.ndarray, first: int, many: int) -> None:
        key = tuple(left.tolist())
        i = self.at.setdefault(key, len(self.at))
        if i == len(self.ranges):
            if i == len(self.left):
                self.left, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.left, self.many))
            self.left[i] = left
            self.ranges.append(deque())
        self.ranges[i].append([first, many])
        self.many[i] += many

    def take(self, i: int, most: int) -> tuple[int, int]:
        """A range of at most `most` sequences of state i, no longer open."""
        first, many = self.ranges[i][0]
        took = min(many, most)
        if took == many:
            self.ranges[i].popleft()
        else:
            self.ranges[i][0] = [first + took, many - took]
        self.many[i] -= took
        return first, took

    def forget_closed(self, least: np.ndarray) -> None:
        """Drops states without sequences, or without room for what `least` needs."""
        n = len(self.ranges)
        open_ = np.flatnonzero((self.many[:n] > 0) & (self.left[:n] >= least).all(1))
        if 2 * len(open_) < n and n > 64:
            self.at = {tuple(self.left[i].tolist()): k for k, i in enumerate(open_)}
            self.ranges = [self.ranges[i] for i in open_]
            size = max(64, 2 * len(open_))
            for name in ("left", "many"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), np.int64)
                new[: len(open_)] = old[open_]
                setattr(self, name, new)

    def best(self, need: np.ndarray, rule: Rule) -> int | None:
        n = len(self.ranges)
        fits = np.flatnonzero((self.many[:n] > 0) & (self.left[:n] >= need).all(1))
        return int(fits[rule.worse(self.left[fits], need, self.full).argmin()]) if len(fits) else None


def vector_plan(counts: dict[int, int], room: Room, rule: Rule) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), as of
    `packing.best_fit_plan`, and the number of sequences."""
    full = room.vector()
    states, rows, opened = _States(full), [], 0
    least = np.min([room.need(n) for n in counts], axis=0) if counts else full
    for length in sorted(counts, reverse=True):
        need, n, rank = room.need(length), counts[length], 0
        whole = int((full // need).min())  # pieces of this length in an empty sequence
        while n:
            i = states.best(need, rule)
            if i is None:  # an open sequence with room is taken before another is opened, so new ones are filled
                per, many, left = min(whole, n), max(1, n // whole), full
                first, opened = opened, opened + many
            else:
                left = states.left[i].copy()
                # by the norm, a sequence that got a piece is a better place for the next one than before
                per = min(int((left // need).min()), n) if rule.kind == "norm" else 1
                first, many = states.take(i, n // per)
            rows.append((length, rank, first, per, int(room.tokens - left[0])))
            states.put(left - per * need, first, many)
            n -= per * many
            rank += per * many
        states.forget_closed(least)
    return np.array(rows, np.int64).reshape(-1, 5), opened


def best_plan(counts: dict[int, int], room: Room, rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences."""
    return min((vector_plan(counts, room, rule) for rule in rules), key=lambda p: p[1])


def pack(
    docs: DataFrame,
    path: str,
    room: Room | None = None,
    end_id: int = 2,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    summary: Summary = piece_ids,
    summary_ddl: str = "ids array<int>",
) -> DataFrame:
    """Per piece: id, piece (from 0), start, length, what `summary` makes of its ids (the ids by
    default), doc_tokens, sequence_id, offset."""
    room = room or Room()
    longest = room.longest()
    pieces = keep(pieces_of(docs, path, longest, end_id, id_col, text_col, summary, summary_ddl, short_first=True), "pieces")
    counts = lengths(pieces)
    plan, _ = best_plan(counts, room, rules)
    out = placed(pieces, plan, sum(counts.values()), summary_ddl)
    # all pieces but the first are full
    piece = F.ceil(F.col("start") / F.lit(longest)).cast("int").alias("piece")
    names = [f.split()[0] for f in summary_ddl.split(", ")]
    return out.select(F.col("id").alias(id_col), piece, "start", "length", *names, "doc_tokens", "sequence_id", "offset")
