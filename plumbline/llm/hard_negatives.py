"""Hard negatives of anchors by bit-sliced integer products [operator 13].

Vectors hold whole numbers. A block of candidates is cut into bit planes; for a block of
anchors, products with the planes are summed from the most significant plane down. After
each plane a score lies in an interval whose width is what the planes below could still
add, and a candidate goes as soon as its interval shows that it cannot qualify:

- first pass: it cannot be among the anchor's best rows of the same label;
- second pass: for none of the anchor's positives it can lie in the band of scores and
  among the best of it.

While many candidates of some anchors are left, planes are multiplied as matrices; then
each anchor multiplies those of its own that are left. Scores are exact: the number type
is chosen so that no sum is rounded.

All anchors meet all rows, in blocks: rows are dealt into groups by a hash of their ids
and anchors into chunks, so labels and copies of any number are shared out. A task returns
the best rows of its block, and these are merged.

Defined results: rows whose id, label or vector is null, or whose vector holds null or
non-finite components, take no part. Of rows that share an id, the one with the least label
and vector counts. Vectors meet only those of their own dimension; without components all
scores are 0. Scores beyond 64 bits are held at the bounds. Equal scores go by the smaller
id. An anchor without positives, or a positive without rows in its band, gives no rows.
Other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.cover_tree import usable
from plumbline.llm.workspace import keep, keep_result

#: Bounds: candidates and components of a group, anchors of a chunk, anchors multiplied at once.
GROUP, COMPONENTS, CHUNK, TOGETHER = 16384, 1 << 20, 65536, 64
#: Groups of small inputs are as small as this, so that several tasks share the work.
LEAST_GROUP = 2048
#: Share of candidates from which planes are no longer multiplied as matrices.
SPARSE = 1 / 8

_LONG = np.iinfo(np.int64)


def _held(x: np.ndarray) -> np.ndarray:
    """Numbers beyond 64 bits at the bounds; only Python's own numbers can be."""
    return np.clip(x, int(_LONG.min), int(_LONG.max)) if x.dtype == object else x


def _least(dtype: np.dtype):
    return -np.inf if dtype.kind == "f" else int(_LONG.min)


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; the least value if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), _least(values.dtype), values.dtype)
    at = values.shape[1] - k
    return (np.sort(values, 1) if values.dtype == object else np.partition(values, at, 1))[:, at]


class Planes:
    """Candidates as bit planes, to be multiplied by a block of anchors."""

    def __init__(self, x: np.ndarray, anchors: np.ndarray):
        as_int = lambda v: v.astype(np.int64) if np.abs(v).max(initial=0) < 2**62 else _integers(v)
        x, a = as_int(x), as_int(anchors)
        self.top = int(np.abs(x).max(initial=0)).bit_length()
        most = int(np.abs(a).astype(object).sum(1).max(initial=0)) if a.dtype == object else int(np.abs(a).max(initial=0)) * max(1, a.shape[1])
        whole = most << self.top + 1
        of = lambda n, kinds: next((t for bits, t in kinds if n < 1 << bits), object)
        unit = np.dtype(of(most, ((24, np.float32), (53, np.float64))))
        self.dtype = np.dtype(of(whole, ((24, np.float32), (53, np.float64), (62, np.int64))))
        self.anchors = a.astype(unit)
        self.above, self.below = (np.maximum(s * a, 0).sum(1).astype(self.dtype) for s in (1, -1))
        self.planes = [((x >> k) & 1).astype(unit) for k in range(self.top)]
        self.sign = (x < 0).astype(unit)
        self.n = len(x)

    def product(self, a: np.ndarray, plane: np.ndarray) -> np.ndarray:
        """Of anchors and a plane's rows; the unit's sums are whole numbers."""
        sums = a @ plane.T
        return (sums.astype(np.int64) if sums.dtype.kind == "f" and self.dtype == object else sums).astype(self.dtype)

    def steps(self) -> list[tuple[int, np.ndarray, int]]:
        """Weight, plane, and the largest value of what lies below, most significant plane first."""
        planes = [(1 << k, self.planes[k], (1 << k) - 1) for k in reversed(range(self.top))]
        return [(-(1 << self.top), self.sign, (1 << self.top) - 1), *planes]


def _integers(v: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


class Best:
    """The k best scores of each anchor."""

    def __init__(self, k: int):
        self.k = k

    def left(self, rows: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = kth(np.where(alive, low, _least(low.dtype)), self.k)
        return alive & (high >= least[:, None])

    def found(self, row: int, score: np.ndarray, ids: np.ndarray):
        yield row, np.lexsort((ids, -score))[: self.k]


class Bands:
    """For each anchor's bands [low, high] the k best scores within."""

    def __init__(self, k: int, bands: list[list[tuple[int, int]]]):
        self.k = k
        self.many = max(map(len, bands), default=0)
        empty = [(int(_LONG.max), int(_LONG.min))]
        table = np.array([b + empty * (self.many - len(b)) for b in bands], np.int64).reshape(len(bands), self.many, 2)
        self.first, self.last = table[:, :, 0], table[:, :, 1]

    def left(self, rows: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(alive.shape, bool)
        for j in range(self.many):
            first, last = self.first[rows, j][:, None], self.last[rows, j][:, None]
            able = alive & (high >= first) & (low <= last)
            sure = able & (low >= first) & (high <= last)
            if sure.sum(1).max(initial=0) >= self.k:
                able &= high >= kth(np.where(sure, low, _least(low.dtype)), self.k)[:, None]
            out |= able
        return out

    def found(self, row: int, score: np.ndarray, ids: np.ndarray):
        for j in range(self.many):
            at = np.flatnonzero((score >= self.first[row, j]) & (score <= self.last[row, j]))
            yield row * self.many + j, at[np.lexsort((ids[at], -score[at]))[: self.k]]


def search(planes: Planes, ids: np.ndarray, may: Callable[[np.ndarray], np.ndarray], aim: Best | Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of anchors (or of their bands), ids and scores of what they find.

    may: for rows of anchors, which candidates each may meet.
    """
    keys, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(planes.anchors), TOGETHER):
        rows = np.arange(at, min(len(planes.anchors), at + TOGETHER))
        for row, own, score in _narrowed(planes, rows, may(rows), aim):
            for key, best in aim.found(row, score, ids[own]):
                keys.append(np.full(len(best), key))
                found.append(ids[own[best]])
                scores.append(score[best].astype(np.int64))
    return np.concatenate(keys), np.concatenate(found), np.concatenate(scores)


def _narrowed(planes: Planes, rows: np.ndarray, alive: np.ndarray, aim: Best | Bands):
    """Per anchor: its row, the candidates left after the last plane, their scores."""
    steps = planes.steps()
    a, above, below = planes.anchors[rows], planes.above[rows], planes.below[rows]
    cols = np.flatnonzero(alive.any(0))
    alive = alive[:, cols]
    part = np.zeros(alive.shape, planes.dtype)
    done = 0
    while done < len(steps) and len(cols) and (done == 0 or alive.mean() > SPARSE):
        weight, plane, rest = steps[done]
        done += 1
        part += planes.product(a, plane if len(cols) == planes.n else plane[cols]) * weight
        low, high = _held(part - (rest * below)[:, None]), _held(part + (rest * above)[:, None])
        if _may_narrow(aim, rows, part, low, high):
            alive = aim.left(rows, alive, low, high)
            some = alive.any(0)
            if some.mean() < 0.75:
                cols, alive, part = cols[some], alive[:, some], part[:, some]
    for i, row in enumerate(rows):
        at = np.flatnonzero(alive[i])
        own, score = cols[at], part[i, at]
        for weight, plane, rest in steps[done:]:
            score = score + planes.product(a[i], plane[own]) * weight
            low, high = _held(score - rest * below[i]), _held(score + rest * above[i])
            left = aim.left(rows[i : i + 1], np.ones((1, len(own)), bool), low[None], high[None])[0]
            own, score = own[left], score[left]
        yield row, own, _held(score)


def _may_narrow(aim: Best | Bands, rows: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """False if intervals are so wide that no candidate can go, which spares the search for the k-th best."""
    if part.dtype == object or not part.size:
        return True
    width = high[:, 0] - low[:, 0]
    if isinstance(aim, Best):
        return bool((part.max(1) - part.min(1) > width).any())
    first, last = aim.first[rows], aim.last[rows]
    empty = first > last
    inside = (last - first >= width[:, None]) & ~empty
    out = (high.min(1) < np.where(empty, _LONG.max, first).min(1)) | (low.max(1) > np.where(empty, _LONG.min, last).max(1))
    return bool(inside.any() or out.any())


# -- on Spark ----------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _labels(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows' and of the anchors' labels."""
    codes = pa.chunked_array([*q.column("label").chunks, *x.column("label").chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[len(q) :], codes[: len(q)]


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole number n with low * score <= 100 * n <= high * score."""
    hold = lambda n: max(int(_LONG.min), min(int(_LONG.max), n))
    return hold(-(-low * score // 100)), hold(high * score // 100)


class Blocks:
    """All anchors against all rows, a task for each chunk of anchors and group of rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        n, dim, asked = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0)), F.count(F.when(F.col("asked"), 1))).first()
        most = max(1, min(GROUP, COMPONENTS // max(1, dim)))
        self.groups = max(1, -(-n // min(most, max(LEAST_GROUP, n // 16))))
        self.chunks = max(1, -(-asked // max(1, min(CHUNK, 4 * COMPONENTS // max(1, dim)))))

    def run(self, anchors: DataFrame, task, ddl: str) -> DataFrame:
        dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = [F.col(c).alias(c) for c in ("dim", "id", "label", "v")]  # apart from the anchors' columns of the same table
        x = self.rows.select(*own, dealt(self.groups, 1).alias("grp"), every(self.chunks).alias("chunk"))
        q = anchors.withColumn("chunk", dealt(self.chunks, 2)).withColumn("grp", every(self.groups))
        key = ("dim", "grp", "chunk")
        return x.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(task, ddl)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per anchor, each of its `positives` best rows of its label, and the `negatives` best rows of other
    labels whose score lies from `low` to `high` percent of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    rows: an id, a label and a vector of whole numbers (`cover_tree.quantised`); is_anchor: over their columns.
    """

    def positive_rows(x: pa.Table, q: pa.Table) -> pa.Table:
        out = pa.schema([("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not len(x) or not len(q):
            return out.empty_table()
        q = q.sort_by("label")  # anchors of one label meet the same rows
        ids, asked = x.column("id").to_numpy(), q.column("id").to_numpy()
        label, own = _labels(x, q)
        may = lambda r: (own[r][:, None] == label) & (asked[r][:, None] != ids)
        row, found, score = search(Planes(_matrix(x.column("v")), _matrix(q.column("v"))), ids, may, Best(positives))
        return pa.table([asked[row], found, score], schema=out)

    def negative_rows(x: pa.Table, q: pa.Table) -> pa.Table:
        out = pa.schema([("anchor_id", pa.int64()), ("number", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
        if not len(x) or not len(q):
            return out.empty_table()
        ids, asked = x.column("id").to_numpy(), q.column("id").to_numpy()
        bands = Bands(negatives, [[band(s, low, high) for s in own] for own in q.column("scores").to_pylist()])
        label, own = _labels(x, q)
        may = lambda r: own[r][:, None] != label
        key, found, score = search(Planes(_matrix(x.column("v")), _matrix(q.column("v"))), ids, may, bands)
        return pa.table([asked[key // bands.many], (key % bands.many).astype(np.int32), found, score], schema=out)

    def run() -> DataFrame:
        own = rows.withColumn("_asked", F.coalesce(is_anchor, F.lit(False)))
        own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.col("_asked").alias("asked"))
        own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        own = own.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one"), F.max("asked").alias("asked"))
        own = keep(own.select("id", "one.label", "one.v", F.size("one.v").alias("dim"), "asked"), "rows")
        blocks = Blocks(own)
        anchors = own.filter("asked").select("dim", "id", "label", "v")
        best = blocks.run(anchors, positive_rows, "anchor_id long, id long, score long")
        best = keep(_first(best, ["anchor_id"], positives).select("anchor_id", F.col("rank").alias("number"), "id", "score"), "positives")
        scores = F.transform(F.sort_array(F.collect_list(F.struct("number", "score"))), lambda p: p["score"])
        asked = anchors.join(best.groupBy(F.col("anchor_id").alias("id")).agg(scores.alias("scores")), "id")
        found = blocks.run(asked.select("dim", "id", "label", "v", "scores"), negative_rows, "anchor_id long, number int, id long, score long")
        found = _first(found, ["anchor_id", "number"], negatives).withColumn("number", F.col("number") + 1)
        chosen = best.select("anchor_id", "number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.join(chosen, ["anchor_id", "number"])
        return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    return keep_result(rows.sparkSession, run, "hard_negatives")
