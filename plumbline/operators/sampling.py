"""Pools, resamples, splits and permutations, as keys of one relation instead of loops.

Every draw is a hash of (seed, purpose, keys), so results do not depend on the
partitioning, and a lost task draws the same again. Row numbers come from
`number_rows`; ranks by hash run in buckets (`ranking.hash_rank`), by
default as many as the number of rows calls for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.rng import draw, draws_of_range
from plumbline.operators.ranking import HASH_ROWS, buckets_for, dealt, hash_rank

#: Rows of a bucket where most buckets of a pool lie beyond its size.
POOL_ROWS = 1 << 14
#: Slots of a pool that one task of `resampled_rows` draws.
PART_SLOTS = 1 << 23
#: Bits of a hash by which such a task finds its slots, and draws that it makes at a time.
_FINE, _CHUNK = 14, 1 << 17


def pool_ladder(n: int, min_pool: int = 50, linear_threshold: int = 1000, n_points: int = 25) -> list[int]:
    """Pool sizes up to n: evenly spaced up to the threshold, then evenly in the logarithm."""
    if n <= linear_threshold:
        steps = np.linspace(min_pool, n, n_points)
    else:
        near = n_points // 2
        far = np.logspace(np.log10(linear_threshold), np.log10(n), n_points - near + 1)[1:]
        steps = np.concatenate([np.linspace(min_pool, linear_threshold, near), far])
    sizes = np.unique(np.round(steps).astype(int)).tolist()
    return sizes if sizes[-1] == n else [*sizes, n]


def enough_events(pools: list[int], event_rate: float, least: int = 20) -> tuple[list[int], list[int]]:
    """Pools expected to hold at least so many events, and the others."""
    good = [p for p in pools if p * event_rate >= least]
    return good, [p for p in pools if p * event_rate < least]


def number_rows(df: DataFrame, keys: list[str], by: list[str] = (), buckets: int | None = None, name: str = "row_id", backend: str = "xxhash64") -> DataFrame:
    """Numbers the rows of each group from 0, in the order of a hash of `keys`; a row is the same in any plan."""
    hashed = df.withColumn("_h", draw("row", *(F.col(k) for k in keys), backend=backend))
    return hash_rank(hashed, list(by), "_h", list(keys), name, buckets).drop("_h")


def exact_subsample(df: DataFrame, n: int, seed: int, keys: list[str], backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Exactly n rows (all, if there are fewer), without replacement."""
    hashed = df.withColumn("_h", draw(seed, "sample", *(F.col(k) for k in keys), backend=backend))
    return hash_rank(hashed, [], "_h", list(keys), "_rank", buckets).filter(F.col("_rank") < n).drop("_h", "_rank")


def draw_pools(rows: DataFrame, pools: DataFrame, by: list[str], seed: int, row_id: str = "row_id", backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Without replacement, `pool_size` rows of each group for each row of `pools`.

    pools: by columns, pool (a number), draw_no, pool_size. Adds them and `slot`,
    the row's number from 0 within its pool.
    """
    buckets = buckets or buckets_for(rows.count(), POOL_ROWS)
    rows = dealt(rows, row_id)  # each becomes a row for each pool
    met = rows.join(F.broadcast(pools), by) if by else rows.crossJoin(F.broadcast(pools))
    hashed = met.withColumn("_h", draw(seed, "pool", F.col("pool"), F.col("draw_no"), F.col(row_id), backend=backend))
    return hash_rank(hashed, [*by, "pool", "draw_no", "pool_size"], "_h", [row_id], "slot", buckets, "pool_size").drop("_h")


def _draws(pools: DataFrame, by: list[str], n_resamples: int, frac: float, seed: int, backend: str = "xxhash64") -> DataFrame:
    """Rows (by, pool, draw_no, pool_size, r, slot), one for each draw."""
    size = F.greatest(F.lit(1), F.floor(F.col("pool_size") * F.lit(frac))).cast("long")
    each = pools.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    # blocks of draws first: one pool's draws are many tasks' work
    block = 1 << 16
    blocks = each.withColumn("_size", size).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / block))))
    blocks = dealt(blocks, *by, "pool", "draw_no", "r", "_block")
    last = F.least(F.col("_size"), (F.col("_block") + 1) * block) - 1
    draws = blocks.withColumn("i", F.explode(F.sequence(F.col("_block") * block, last)))
    slot = F.pmod(draw(seed, "boot", F.col("pool"), F.col("draw_no"), F.col("r"), F.col("i"), backend=backend), F.col("pool_size"))
    return draws.select(*by, "pool", "draw_no", "pool_size", "r", slot.cast("long").alias("slot"))


def draw_resamples(pools: DataFrame, by: list[str], n_resamples: int, frac: float, seed: int, backend: str = "xxhash64") -> DataFrame:
    """With replacement: rows (by, pool, draw_no, r, slot, cnt) of the slots that a resample drew.

    A resample of a pool has max(1, floor(size * frac)) draws.
    """
    return _draws(pools, by, n_resamples, frac, seed, backend).groupBy(*by, "pool", "draw_no", "pool_size", "r", "slot").agg(F.count("*").alias("cnt"))


def bootstrap(pooled: DataFrame, pools: DataFrame, by: list[str], n_resamples: int, frac: float, seed: int, value: list[str], backend: str = "xxhash64") -> DataFrame:
    """Rows (by, pool, draw_no, pool_size, r, value..., cnt): resamples compacted to distinct values.

    Draws meet their slots once, in a shuffle: they come from a table of a row for each pool,
    which the planner would take for small and broadcast.
    """
    keys = [*by, "pool", "draw_no", "pool_size"]
    drawn = _draws(pools, by, n_resamples, frac, seed, backend)
    met = drawn.join(pooled.select(*keys, "slot", *value).hint("shuffle_hash"), [*keys, "slot"])
    return met.groupBy(*keys, "r", *value).agg(F.count("*").alias("cnt"))


def _members(prefix: int, n: int, size: int, part: int, parts: int) -> tuple[int, np.ndarray]:
    """The rows of a part of a pool in the order of their slots, and the first slot: the ranks of `draw_pools`."""
    chunks = [(a, min(a + _CHUNK, n)) for a in range(0, n, _CHUNK)]
    counts = np.zeros(1 << _FINE, np.int64)
    for a, b in chunks:
        counts += np.bincount(draws_of_range(prefix, a, b) >> (52 - _FINE), minlength=1 << _FINE)
    before = np.concatenate([[0], counts.cumsum()])
    edge = lambda k: int(np.searchsorted(before, -(-size * k // parts)))
    low, high = edge(part), edge(part + 1)
    ids, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in chunks:
        h = draws_of_range(prefix, a, b)
        at = np.flatnonzero((h >= low << (52 - _FINE)) & (h < high << (52 - _FINE)))
        ids.append(at + a)
        own.append(h[at])
    ids = np.concatenate(ids)
    return int(before[low]), ids[np.argsort(np.concatenate(own), kind="stable")][: size - int(before[low])]


def _counted(prefix: int, draws: int, size: int, start: int, width: int) -> np.ndarray:
    """How often a resample draws each of `width` slots from `start`."""
    out = np.zeros(width, np.int64)
    kept, n = [], 0
    for a in range(0, draws, _CHUNK):
        slot = draws_of_range(prefix, a, min(a + _CHUNK, draws)) % size - start
        if width < size:
            slot = slot[(slot >= 0) & (slot < width)]
        kept.append(slot)
        n += len(slot)
        if n > width or a + _CHUNK >= draws:
            out += np.bincount(np.concatenate(kept), minlength=width)
            kept, n = [], 0
    return out.astype(np.min_scalar_type(int(out.max(initial=0))))


def resampled_rows(spark: SparkSession, pools: Sequence[tuple[int, int, int, int]], n_resamples: int, frac: float, seed: int) -> DataFrame:
    """Rows (n, pool, draw_no, pool_size, row_id, c0, c1, ...): how often each resample draws each row of each pool.

    pools: (n, pool, draw_no, pool_size), for tables whose rows are numbered from 0 to n - 1. The rows
    and draws are those of `draw_pools` and `draw_resamples` with xxhash64. They depend on numbers
    alone, so each task makes those of its own slots, and nothing is shuffled, sorted or joined on the
    way; a pool of more than PART_SLOTS is several tasks' work, each of which makes all the pool's
    hashes and keeps its own.
    """
    pieces = [(*map(int, p), part, parts) for p in pools for parts in [-(-int(p[3]) // PART_SLOTS)] for part in range(parts)]
    pieces.sort(key=lambda p: -p[3])  # the longest first
    df = spark.createDataFrame(pieces or [(0, 0, 0, 0, 0, 0)], "n long, pool int, draw_no int, pool_size long, part int, parts int").filter("parts > 0")
    draws = F.greatest(F.lit(1), F.floor(F.col("pool_size") * F.lit(frac))).cast("long")
    before = lambda *keys: F.xxhash64(F.lit(seed), *keys)
    boots = F.array(*(before(F.lit("boot"), F.col("pool"), F.col("draw_no"), F.lit(r)) for r in range(n_resamples)))
    df = df.withColumns({"draws": draws, "_pool": before(F.lit("pool"), F.col("pool"), F.col("draw_no")), "_boots": boots})
    keys = ["n", "pool", "draw_no", "pool_size"]
    if not n_resamples:
        df = df.withColumn("_boots", F.array().cast("array<long>"))
    schema = "n long, pool int, draw_no int, pool_size long, row_id long" + "".join(f", c{r} int" for r in range(n_resamples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                start, ids = _members(p["_pool"], p["n"], p["pool_size"], p["part"], p["parts"])
                counts = [_counted(b, p["draws"], p["pool_size"], start, len(ids)) for b in p["_boots"]]
                for a in range(0, len(ids), 1 << 16):
                    own = ids[a : a + (1 << 16)]
                    same = [pa.array(np.full(len(own), p[k], batch.schema.field(k).type.to_pandas_dtype())) for k in keys]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(own), *(pa.array(c[a : a + (1 << 16)].astype(np.int32)) for c in counts)], names=[*keys, "row_id", *(f"c{r}" for r in range(n_resamples))])

    return df.repartition(max(1, len(pieces))).mapInArrow(run, schema)


def resampled_rows_by(spark: SparkSession, pools: Sequence[tuple[int, int, int, int]], n_resamples: int, frac: float, seed: int, backend: str) -> DataFrame:
    """As `resampled_rows`, with the draws of any backend: pools and draws meet in shuffles."""
    if backend == "xxhash64":
        return resampled_rows(spark, pools, n_resamples, frac, seed)
    plan = spark.createDataFrame([tuple(map(int, p)) for p in pools], "n long, pool int, draw_no int, pool_size long")
    ids = plan.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row_id"))
    keys = ["n", "pool", "draw_no", "pool_size"]
    pooled = draw_pools(ids, plan, ["n"], seed, backend=backend)
    if not n_resamples:
        return pooled.drop("slot")
    drawn = draw_resamples(plan, ["n"], n_resamples, frac, seed, backend).groupBy(*keys, "slot").agg(*(F.sum(F.when(F.col("r") == r, F.col("cnt"))).cast("int").alias(f"c{r}") for r in range(n_resamples)))
    met = pooled.hint("shuffle_hash").join(drawn, [*keys, "slot"], "left").fillna(0, [f"c{r}" for r in range(n_resamples)])
    return met.drop("slot")


def permuted_rows(spark: SparkSession, n: int, n_permutations: int, seed: int) -> DataFrame:
    """Rows (permutation, row_id, source): the row whose value each row gets, of rows numbered from 0 to n - 1.

    As `permuted` deals them, by tasks that need no rows: a permutation's ranks depend on numbers alone.
    """
    pieces = [(i, part, parts) for i in range(1, n_permutations + 1) for parts in [-(-n // PART_SLOTS)] for part in range(parts)]
    df = spark.createDataFrame(pieces or [(0, 0, 0)], "permutation int, part int, parts int").filter("parts > 0")
    df = df.withColumn("_prefix", F.xxhash64(F.lit(seed), F.lit("perm"), F.col("permutation")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                start, ids = _members(p["_prefix"], n, n, p["part"], p["parts"])
                for a in range(0, len(ids), 1 << 16):
                    own = ids[a : a + (1 << 16)]
                    to = np.arange(start + a, start + a + len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p["permutation"], np.int32)), pa.array(to), pa.array(own)], names=["permutation", "row_id", "source"])

    return df.repartition(max(1, len(pieces))).mapInArrow(run, "permutation int, row_id long, source long")


def poisson_weight(rate: float, *keys: Column | int | str, most: int = 16) -> Column:
    """A Poisson count per row and resample: a bootstrap without a shuffle, for tables whose
    exact resamples would be too many rows. Counts above `most` have no weight worth naming."""
    u = draw(*keys) / F.lit(float(1 << 52))
    out, p, below = F.lit(0), float(np.exp(-rate)), 0.0
    for k in range(most):
        below += p
        out = out + F.when(u >= below, 1).otherwise(0)
        p *= rate / (k + 1)
    return out


def poisson_bootstrap(pooled: DataFrame, n_resamples: int, frac: float, seed: int, keys: list[str], value: list[str], row_id: str = "row_id") -> DataFrame:
    """As `bootstrap`, with independent Poisson counts of mean `frac` instead of exact totals."""
    each = pooled.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    cnt = poisson_weight(frac, seed, "poisson", *(F.col(k) for k in keys), F.col("r"), F.col(row_id))
    return each.withColumn("cnt", cnt).filter("cnt > 0").groupBy(*keys, "r", *value).agg(F.sum("cnt").alias("cnt"))


# -- splits --------------------------------------------------------------------------------


def kfold(df: DataFrame, k: int, seed: int, keys: list[str], backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Adds `fold`: shuffled, sizes equal but for one."""
    hashed = df.withColumn("_h", draw(seed, "fold", *(F.col(c) for c in keys), backend=backend))
    return hash_rank(hashed, [], "_h", keys, "_rank", buckets).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank")


def repeated_split(df: DataFrame, n_splits: int, train_frac: float, seed: int, keys: list[str], backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Rows with `split`: floor(n * train_frac) rows of each split, without replacement."""
    n = df.count()
    buckets = buckets or buckets_for(n, HASH_ROWS)
    each = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    hashed = each.withColumn("_h", draw(seed, "split", F.col("split"), *(F.col(c) for c in keys), backend=backend))
    return hash_rank(hashed, ["split"], "_h", keys, "_rank", buckets).filter(F.col("_rank") < int(n * train_frac)).drop("_h", "_rank")


def bootstrap_split(numbered: DataFrame, n_splits: int, seed: int, row_id: str = "row_id", backend: str = "xxhash64") -> DataFrame:
    """Rows with `split` and `cnt`: each split draws as many rows as there are, with replacement."""
    n = numbered.count()
    if n == 0:
        return numbered.withColumns({"split": F.lit(0), "cnt": F.lit(0).cast("long")})
    pools = numbered.sparkSession.range(n_splits).select(F.col("id").alias("pool"), F.lit(0).alias("draw_no"), F.lit(n).cast("long").alias("pool_size"))
    drawn = draw_resamples(pools, [], 1, 1.0, seed, backend)
    return numbered.hint("merge").join(drawn.select(F.col("pool").cast("int").alias("split"), F.col("slot").alias(row_id), "cnt"), row_id)


def stratified_split(df: DataFrame, target: str, test_frac: float, seed: int, keys: list[str], backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Adds `is_test`: floor(n * test_frac) rows of each class."""
    hashed = df.withColumn("_h", draw(seed, "strata", *(F.col(c) for c in keys), backend=backend))
    ranked = hash_rank(hashed, [target], "_h", keys, "_rank", buckets)
    sizes = F.broadcast(df.groupBy(target).agg(F.count("*").alias("_n")))
    marked = ranked.join(sizes, ranked[target].eqNullSafe(sizes[target])).drop(sizes[target])
    return marked.withColumn("is_test", F.col("_rank") < F.floor(F.col("_n") * F.lit(test_frac))).drop("_h", "_rank", "_n")


def positional_split(df: DataFrame, train_frac: float, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds `is_train`: the first floor(n * train_frac) rows in the order of numeric or time columns, unique together.

    Cuts of the first column split the rows into ordered buckets, and windows number within them.
    """
    n = df.count()
    buckets = buckets or buckets_for(n)
    first = F.col(order[0]).cast("timestamp").cast("double") if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0]).cast("double")
    cuts = df.agg(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")).first()["c"] if buckets > 1 else []
    marked = df.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < first)) if cuts else F.lit(0))
    sizes = {r["_b"]: r["n"] for r in marked.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # `buckets` rows at most
    starts, at = [], 0
    for b in sorted(sizes):
        starts.append((b, at))
        at += sizes[b]
    start = F.broadcast(df.sparkSession.createDataFrame(starts, "_b int, _start long"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    ranked = marked.withColumn("_own", own).join(start, "_b")
    return ranked.withColumn("is_train", F.col("_start") + F.col("_own") <= int(n * train_frac)).drop("_b", "_own", "_start")


def permuted(df: DataFrame, feature: str, n_permutations: int, seed: int, row_id: str = "row_id", backend: str = "xxhash64", buckets: int | None = None) -> DataFrame:
    """Rows with `permutation`: the feature's values dealt anew among the rows, for each permutation.

    row_id must number the rows from 0: the row of rank k by hash gives its value to row k.
    """
    buckets = buckets or buckets_for(df.count(), HASH_ROWS)
    each = dealt(df.select(row_id, feature), row_id).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
    hashed = each.withColumn("_h", draw(seed, "perm", F.col("permutation"), F.col(row_id), backend=backend))
    to = hash_rank(hashed, ["permutation"], "_h", [row_id], "_to", buckets).select("permutation", F.col("_to").alias(row_id), feature)
    return df.drop(feature).hint("shuffle_hash").join(to, row_id)
