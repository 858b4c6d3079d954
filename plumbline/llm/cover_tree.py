"""Exact top-k inner-product search by dual cover trees [operator 3].

Equal vectors become one point that keeps its k + 1 smallest ids: no query can
need another of them. Points are sorted into cells around a bounded sample of
pivots and cut into groups; each group is indexed by cover trees over slices of
neighbours. Queries are indexed by cover trees of their own. A task traverses one
group's trees against one chunk's query trees together: a pair of nodes is
dropped if no inner product of its members, by centres and covering radii, can
reach the worst kth score of the query node.

Two passes: each query first meets the group of its own cell, which gives it a kth
score to beat. With that, a query is copied only to groups of cells that its bound
(by the cell's pivot and covering radius) lets reach this score, and points only to
chunks that some query visits. Scores from the first pass prune in the second from
the beginning. The groups' results are merged; equal scores go to the smaller id.

The search is exact whatever the pivots: they only bring neighbours together.
Work and traffic: where no bound holds (vectors without structure in many
dimensions), every query meets every group, in blocks of up to CHUNK queries and
GROUP points.

Defined results: rows whose id or vector is null, or whose vector holds null or
non-finite components, take no part. Vectors meet only those of their own
dimension; without components all scores are 0. Rows that repeat both id and
vector count once; an id with several vectors queries with, and is found by,
each of them. Scores beyond 64 bits are held at the bounds. Other columns of the
input do not matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.workspace import keep

#: Bounds: sampled pivots, points per group, queries per chunk, points per tree, points per leaf.
PIVOTS, GROUP, CHUNK, SLICE, LEAF = 64, 32768, 65536, 1024, 16
#: Children of a tree node at most.
FAN = 16
#: Groups of small inputs are as small as this, so that several tasks share the work.
LEAST_GROUP = 2048


LEAST = np.iinfo(np.int64).min


class CoverTree:
    """Nodes of one slice, breadth first: centre, radius that covers all below, children, and leaves' points.

    A node's children are chosen farthest first, from the node's own centre on, until
    they cover its points within half its radius or are FAN: their centres lie farther
    from each other than any of the node's points from the nearest of them.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        p = points.astype(np.float64)
        order = np.arange(len(p))
        self.order = order
        start, end, centre, radius, child_at, child_n = [0], [len(p)], [0], [0.0], [-1], [0]
        node = 0
        while node < len(start):
            own = order[start[node] : end[node]]
            gap = np.sqrt(((p[own] - p[centre[node]]) ** 2).sum(1))
            radius[node] = float(gap.max(initial=0.0)) * (1 + 1e-9)
            if len(own) > LEAF and radius[node] > 0:
                centres, near, which = [centre[node]], gap.copy(), np.zeros(len(own), int)
                while len(centres) < FAN and near.max() > radius[node] / 2:
                    c = own[near.argmax()]
                    to = np.sqrt(((p[own] - p[c]) ** 2).sum(1))
                    closer = to < near
                    near[closer], which[closer] = to[closer], len(centres)
                    centres.append(c)
                parts = [(c, own[which == i]) for i, c in enumerate(centres)]
                order[start[node] : end[node]] = np.concatenate([x for _, x in parts])
                child_at[node], child_n[node] = len(start), len(parts)
                at = start[node]
                for c, x in parts:
                    start.append(at)
                    at += len(x)
                    end.append(at)
                    centre.append(c)
                    radius.append(0.0)
                    child_at.append(-1)
                    child_n.append(0)
            node += 1
        self.start, self.end = np.array(start), np.array(end)
        self.child_at, self.child_n = np.array(child_at), np.array(child_n)
        self.centre = p[np.array(centre)] if len(p) else np.zeros((1, p.shape[1]))
        self.radius = np.array(radius)
        self.length = np.sqrt((self.centre**2).sum(1))


class Forest:
    """Trees over slices of points, laid end to end; positions run through all points."""

    def __init__(self, points: np.ndarray):
        trees = [CoverTree(points[a : a + SLICE]) for a in range(0, len(points), SLICE)]
        nodes = np.cumsum([0, *(len(t.start) for t in trees)])
        first = np.arange(len(trees)) * SLICE
        cat = lambda name, shift: np.concatenate([getattr(t, name) + s for t, s in zip(trees, shift, strict=True)])
        zero = np.zeros(len(trees), int)
        self.order = cat("order", first)
        self.points = points[self.order]
        self.start, self.end = cat("start", first), cat("end", first)
        self.child_at, self.child_n = cat("child_at", nodes[:-1]), cat("child_n", zero)
        self.radius, self.length = cat("radius", zero), cat("length", zero)
        self.centre = np.concatenate([t.centre for t in trees])
        self.roots = nodes[:-1]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return spread(self.child_at[nodes], self.child_n[nodes])

    def members(self, nodes: np.ndarray) -> np.ndarray:
        return spread(self.start[nodes], self.end[nodes] - self.start[nodes])


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as float64."""
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    q, x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    exact = q @ x.T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Search:
    """Dual traversal of query trees and point trees.

    ids: per point its smallest ids, ascending, padded with -1 at `held` ids.
    floor: per query a score that its kth best elsewhere has; `compared` counts the pairs of vectors.
    """

    def __init__(self, queries: Forest, query_ids: np.ndarray, points: Forest, ids: np.ndarray, held: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.x, self.k = queries, points, k
        self.query_ids = query_ids[queries.order]
        self.ids, self.held = ids[points.order], held[points.order]
        n = len(self.query_ids)
        self.floor = np.full(n, LEAST) if floor is None else floor[queries.order]
        self.compared = 0
        self.score = np.full((n, k), LEAST)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)

    def worst(self, node: int) -> float:
        """The least kth score among a query node's members; minus infinity while one has none."""
        a, b = self.q.start[node], self.q.end[node]
        least = int(np.maximum(self.score[a:b, -1], self.floor[a:b]).min())
        return -np.inf if least == LEAST else float(least)

    def bounds(self, node: int, nodes: np.ndarray) -> np.ndarray:
        """No member of the query node has a larger inner product with a member of these nodes."""
        q, x = self.q, self.x
        cross = x.centre[nodes] @ q.centre[node]
        slack = q.length[node] * x.radius[nodes] + q.radius[node] * x.length[nodes] + q.radius[node] * x.radius[nodes]
        return (cross + slack) + 1e-9 * (np.abs(cross) + slack) + 1e-6

    def run(self) -> None:
        roots = self.x.roots
        for root in self.q.roots:
            stack = [(int(root), roots)]
            while stack:
                node, frontier = stack.pop()
                frontier = frontier[self.bounds(node, frontier) >= self.worst(node)]
                if not len(frontier):
                    continue
                if self.q.child_n[node]:
                    inner = self.x.child_n[frontier] > 0
                    down = np.concatenate([frontier[~inner], self.x.children(frontier[inner])])
                    first = self.q.child_at[node]
                    stack += [(int(c), down) for c in range(first, first + self.q.child_n[node])]
                else:
                    self.leaf(node, frontier)

    def leaf(self, node: int, frontier: np.ndarray) -> None:
        """Best bound first: the best leaf fills the scores, then ever fewer nodes are left."""
        bound = self.bounds(node, frontier)
        many = 2
        while len(frontier):
            worst = self.worst(node)
            keep_ = bound >= worst
            frontier, bound = frontier[keep_], bound[keep_]
            if not len(frontier):
                return
            inner = self.x.child_n[frontier] > 0
            if worst == -np.inf and inner.any():  # dive along the best node
                best = int(np.argmax(np.where(inner, bound, -np.inf)))
                down = self.x.children(frontier[best : best + 1])
                rest = np.arange(len(frontier)) != best
                frontier = np.concatenate([frontier[rest], down])
                bound = np.concatenate([bound[rest], self.bounds(node, down)])
                leaves = np.flatnonzero(self.x.child_n[frontier] == 0)
                if len(leaves):
                    top = leaves[np.argsort(-bound[leaves], kind="stable")[:many]]
                    self.compare(node, frontier[top])
                    rest = np.ones(len(frontier), bool)
                    rest[top] = False
                    frontier, bound = frontier[rest], bound[rest]
                continue
            leaves = np.flatnonzero(~inner)
            if len(leaves):
                many = min(2 * many, 64)
                top = leaves[np.argsort(-bound[leaves], kind="stable")[:many]]
                self.compare(node, frontier[top])
                rest = np.ones(len(frontier), bool)
                rest[top] = False
                frontier, bound = frontier[rest], bound[rest]
                continue
            frontier = self.x.children(frontier)
            bound = self.bounds(node, frontier)

    def compare(self, node: int, leaves: np.ndarray) -> None:
        """All members of a query leaf against all members of point leaves."""
        a, b = int(self.q.start[node]), int(self.q.end[node])
        at = self.x.members(leaves)
        self.compared += (b - a) * len(at)
        got = products(self.q.points[a:b], self.x.points[at])
        for r in range(a, b):
            own = got[r - a]
            hit = np.flatnonzero(own >= max(self.score[r, -1], self.floor[r]))
            if not len(hit):
                continue
            if len(hit) > 4 * self.k:  # only the k best points can give results, ties kept
                least = np.partition(own[hit], len(hit) - self.k - 1)[len(hit) - self.k - 1]
                hit = hit[own[hit] >= least]
            ids = self.ids[at[hit]]
            ok = (np.arange(ids.shape[1]) < self.held[at[hit]][:, None]) & (ids != self.query_ids[r])
            score = np.concatenate([np.repeat(own[hit], ok.sum(1)), self.score[r][self.filled[r]]])
            found = np.concatenate([ids[ok], self.found[r][self.filled[r]]])
            best = np.lexsort((found, -score))[: self.k]
            n = len(best)
            self.score[r, :n], self.found[r, :n], self.filled[r, :n] = score[best], found[best], True


# -- on Spark ----------------------------------------------------------------------


def quantised(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(steps) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _cells(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the number of the nearest pivot of the point's dimension, and the distance to it."""

    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            vectors = batch.column("v")
            cell, gap = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                c = pivots.get(int(d))
                if c is not None and d:
                    for part in np.array_split(at, -(-len(at) // 4096)):
                        v = _matrix(vectors.take(pa.array(part)))
                        cell[part] = np.argmax(v @ c.T - 0.5 * (c**2).sum(1), 1)
                        gap[part] = np.sqrt(((v - c[cell[part]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{schema}, cell int, gap double")


def _grouped(points: DataFrame, most: int, name: str, spread: tuple[str, ...]) -> tuple[DataFrame, list[tuple]]:
    """Cuts each dimension's points, in the order of their cells, into groups of about `most`
    and at most twice as many, numbered from 0; and per cell (dim, cell, number of its
    first group, its groups, covering radius). `spread`: columns that share out a large cell."""
    cells = points.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    cells = cells.orderBy("dim", "cell").collect()  # PIVOTS rows at most for each dimension
    rows = []
    for dim, own in itertools.groupby(cells, lambda r: r["dim"]):
        number, room = -1, 0
        for r in own:
            parts = -(-r["n"] // most)
            if parts > 1 or r["n"] > room:
                number, room = number + 1, most
            rows.append((dim, r["cell"], number, parts, r["radius"]))
            room = room - r["n"] if parts == 1 else 0
            number += parts - 1
    return _in_groups(points, rows, name, spread), rows


def _in_groups(points: DataFrame, plan: list[tuple], name: str, spread: tuple[str, ...]) -> DataFrame:
    """Adds the number of each row's group by a plan of `_grouped`; rows of cells without one go."""
    rows = F.broadcast(points.sparkSession.createDataFrame(plan, "dim int, cell int, number int, parts int, radius double"))
    # within a large cell, a hash spreads the rows over its parts
    group = F.col("number") + F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")
    return points.join(rows, ["dim", "cell"]).withColumn(name, group).drop("number", "parts", "radius")


def _visits(asked: DataFrame, pivots: dict[int, np.ndarray], plan: list[tuple]) -> DataFrame:
    """Adds the groups, other than its own, in which a query can find its floor or more."""
    by_dim = {d: list(rows) for d, rows in itertools.groupby(plan, lambda r: r[0])}

    def run(batches):
        for batch in batches:
            dim, home = batch.column("dim").to_numpy(), batch.column("home").to_numpy()
            floor = batch.column("floor").to_numpy()
            visits: list[list[int]] = [[] for _ in dim]
            for d in np.unique(dim):
                at, rows = np.flatnonzero(dim == d), by_dim[int(d)]
                first, parts, radius = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
                centre = pivots[int(d)][[r[1] for r in rows]] if d else np.zeros((len(rows), 0))
                v = _matrix(batch.column("v").take(pa.array(at)))
                length = np.sqrt((v**2).sum(1))[:, None]
                cross = v @ centre.T
                reach = cross + length * radius + 1e-9 * (np.abs(cross) + length * radius) + 1e-6
                for i, hit in zip(at, (reach >= floor[at][:, None]) | (floor[at] == LEAST)[:, None], strict=True):
                    visits[i] = sorted({g for f, n in zip(first[hit], parts[hit], strict=True) for g in range(f, f + n)} - {int(home[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "visits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(run, f"{schema}, visits array<int>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k best vectors of other ids: query_id, rank, the id, score.

    vectors, queries: an id and a vector of whole numbers (`quantised`).
    """
    spark = vectors.sparkSession
    id_ = F.col(id_col).cast("long").alias("id")
    vector = F.col(vector_col).cast("array<double>")

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select(id_, vector.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    rows = rows_of(vectors)
    # the first k + 1 ids of each distinct vector; Spark limits the groups before it shuffles them
    first = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("own", F.dense_rank().over(first)).filter(F.col("own") <= k + 1)
    points = points.groupBy("dim", "v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    points = keep(points, "points")

    sample = Window.partitionBy("dim").orderBy(F.xxhash64("v"))
    pivots: dict[int, list] = {}
    for r in points.select("dim", "v").withColumn("i", F.row_number().over(sample)).filter(F.col("i") <= PIVOTS).select("dim", "v").collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    centres = {d: np.array(v) for d, v in pivots.items()}

    n = points.count()
    size = min(GROUP, max(LEAST_GROUP, n // 16))
    points, plan = _grouped(keep(_cells(points, centres), "cells"), size, "grp", ("v",))
    asked = keep(_cells(rows_of(queries).distinct(), centres).withColumn("query", F.xxhash64("v")), "asked")
    asked, _ = _grouped(asked, CHUNK, "chunk", ("v", "id"))
    asked = asked.filter(F.col("dim").isin(sorted({r[0] for r in plan})))  # the others have no points

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not len(x) or not len(q):
            return out.empty_table()
        x, q = x.sort_by("cell"), q.sort_by("cell")
        lists = x.column("ids").combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        ids = np.full((len(x), k + 1), -1, np.int64)
        ids[np.repeat(np.arange(len(x)), held), spread(np.zeros(len(x), int), held)] = lists.flatten().to_numpy()
        query_ids, query = q.column("id").to_numpy(), q.column("query").to_numpy()
        run = Search(Forest(_matrix(q.column("v"))), query_ids, Forest(_matrix(x.column("v"))), ids, held, k, q.column("floor").to_numpy())
        run.run()
        row, at = np.nonzero(run.filled)
        return pa.table([run.query_ids[row], query[run.q.order[row]], run.found[row, at], run.score[row, at]], schema=out)

    def found_by(visits: DataFrame) -> DataFrame:
        """Results of queries in the groups that they visit."""
        visits = visits.select("dim", "grp", "chunk", "cell", "v", "id", "query", "floor")
        met = visits.select(*(F.col(c).alias(c) for c in ("dim", "grp", "chunk"))).distinct()
        copies = points.join(met, ["dim", "grp"]).select("dim", "grp", "chunk", "cell", "v", "ids")
        met = copies.groupBy("dim", "grp", "chunk").cogroup(visits.groupBy("dim", "grp", "chunk"))
        return met.applyInArrow(search, "query_id long, query long, id long, score long")

    home = _in_groups(asked, plan, "grp", ("v",)).withColumn("floor", F.lit(int(LEAST)))
    first = keep(found_by(home), "first")
    kth = first.groupBy(F.col("query_id").alias("id"), "query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    own = home.select("id", "query", F.col("grp").alias("home"))
    more = asked.join(own, ["id", "query"], "left").join(kth, ["id", "query"], "left")
    more = more.select("dim", "cell", "chunk", "v", "id", "query", F.coalesce("home", F.lit(-1)).alias("home"), F.coalesce("kth", F.lit(int(LEAST))).alias("floor"))
    more = keep(_visits(more, centres, plan), "visits").withColumn("grp", F.explode("visits"))
    found = first.unionByName(found_by(more))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
