"""Best-fit decreasing packing of tokenised documents [operator 6].

Documents are encoded once and cut into full windows and a rest. Best-fit
decreasing depends only on how many pieces there are of each length, so the
plan is made from that histogram (at most `capacity` rows, whatever the
input): lengths in falling order, each into the tightest open window, which a
segment tree indexed by remaining capacity finds. The plan says, for the k-th
piece of a length, its window and offset; pieces are numbered in small buckets
whose counts are summed up before, so no task holds all pieces of a length.

Defined results: null and empty texts are their end id alone. Repeated rows are
packed each. Other columns of the input do not matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textkit as tk
from plumbline.llm.bpe import SLICE, byte_bpe
from plumbline.llm.workspace import keep

#: Turns each piece's ids (a list array) into result columns.
Summary = Callable[[list[np.ndarray]], dict[str, pa.Array]]


def piece_ids(pieces: list[np.ndarray]) -> dict[str, pa.Array]:
    offsets = tk.prefix(np.array([len(p) for p in pieces], np.int64)).astype(np.int32)
    flat = np.concatenate([*pieces, np.zeros(0, np.int32)])
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))}


class CapacityTree:
    """Segment tree over 0..capacity: the least capacity, at least `need`, that an open window has left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, left: int, is_open: bool) -> None:
        i = left + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first window, pieces per window, first offset) and the number of windows.

    Piece number q of a length, in the row with the largest first rank <= q, goes
    t = q - first rank places on: window first + t // per, offset first offset + t % per * length.
    """
    tree = CapacityTree(capacity)
    windows: list[deque] = [deque() for _ in range(capacity + 1)]  # by capacity left: [first window, how many]
    rows, opened = [], 0

    def put(left: int, first: int, many: int) -> None:
        if not windows[left]:
            tree.set(left, True)
        windows[left].append([first, many])

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                per = capacity // length
                put(left, opened, -(-n // per))
                opened += -(-n // per)
            per = left // length
            first, many = windows[left][0]
            take = min(many, n // per)
            if not take:  # one window gets the rest, fewer than it could
                take, per = 1, n
            rows.append((length, rank, first, per, capacity - left))
            if take == many:
                windows[left].popleft()
                if not windows[left]:
                    tree.set(left, False)
            else:
                windows[left][0] = [first + take, many - take]
            put(left - per * length, first, take)
            n -= take * per
            rank += take * per
    return np.array(rows, np.int64).reshape(-1, 5), opened


def pieces_of(
    docs: DataFrame,
    path: str,
    capacity: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    summary: Summary = piece_ids,
    summary_ddl: str = "ids array<int>",
    short_first: bool = False,
) -> DataFrame:
    """Documents as ids with an end id, cut into pieces of `capacity` and a shorter one, which is the
    last or (`short_first`) the first: id, start, length, what `summary` gives, doc_tokens, turn."""
    names = [f.split()[0] for f in summary_ddl.split(", ")]

    def cut(batches):
        bpe, turn = byte_bpe(path), 0
        for batch in batches:
            for s in tk.slices(batch.column(1), SLICE):
                ids, offsets = bpe.encode(batch.column(1).slice(s.first, s.rows))
                size = np.diff(offsets) + 1
                many = -(-size // capacity)
                row = np.repeat(np.arange(s.rows), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                end = np.minimum(start + capacity, size[row])
                if short_first:
                    spare = (many * capacity - size)[row]
                    start, end = np.maximum(start - spare, 0), start + capacity - spare
                length = end - start
                full = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                at = (offsets[:-1] + np.arange(s.rows))[row] + start
                got = summary([full[a : a + n] for a, n in zip(at, length, strict=True)])
                id_ = batch.column(0).slice(s.first, s.rows).take(pa.array(row))
                columns = [id_, pa.array(start), pa.array(length), *(got[c] for c in names), pa.array(size[row]), pa.array(np.arange(turn, turn + len(row)))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", *names, "doc_tokens", "turn"])
                turn += len(row)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(cut, f"id long, start long, length long, {summary_ddl}, doc_tokens long, turn long")


def lengths(pieces: DataFrame) -> dict[int, int]:
    """How many pieces there are of each length: at most `capacity` rows, whatever the input."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def placed(pieces: DataFrame, plan: np.ndarray, n: int, summary_ddl: str = "ids array<int>") -> DataFrame:
    """Numbers the n pieces of `pieces_of` within their lengths and gives each the window
    (sequence_id) and offset of a plan with the rows of `best_fit_plan`."""
    names = [f.split()[0] for f in summary_ddl.split(", ")]
    buckets = max(64, n // 4096)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "turn"), F.lit(buckets)))
    before = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "start", "doc_tokens", "turn")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(before, ["length", "bucket"])
    ranked = ranked.select("id", "start", "length", *names, "doc_tokens", (F.col("base") + F.col("own") - 1).alias("rank"))

    # the plan's rows grow with the lengths, not with the pieces
    key = plan[:, 0] * (1 << 44) + plan[:, 1]
    order = np.argsort(key)
    key, plan = key[order], plan[order]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            p = plan[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            t = rank - p[:, 1]
            columns = [*batch.columns[:-1], pa.array(p[:, 2] + t // p[:, 3]), pa.array(p[:, 4] + t % p[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", *names, "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id long, start long, length long, {summary_ddl}, doc_tokens long, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    summary: Summary = piece_ids,
    summary_ddl: str = "ids array<int>",
) -> DataFrame:
    """Per piece: id, start, length, what `summary` makes of its ids (the ids by default),
    doc_tokens, sequence_id, offset."""
    pieces = keep(pieces_of(docs, path, capacity, end_id, id_col, text_col, summary, summary_ddl), "pieces")
    counts = lengths(pieces)
    plan, _ = best_fit_plan(counts, capacity)
    return placed(pieces, plan, sum(counts.values()), summary_ddl).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The training rows: sequence_id and its `capacity` ids, padded at the end."""
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    rows = packed.groupBy("sequence_id").agg(joined.alias("ids"))
    padding = F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))
    return rows.select("sequence_id", F.concat("ids", padding).alias("ids"))
