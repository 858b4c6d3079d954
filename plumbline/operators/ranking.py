"""Exact ranks and running totals without a task that sees a whole group.

A window over a whole group sorts it in one task. Here an order-preserving bucket
splits each group first: the buckets' totals, a small table, give each bucket's
start, and windows run within buckets only. `buckets` tunes parallelism and never
the result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rng import SPAN

#: Rows that one bucket's window should hold.
BUCKET_ROWS = 1 << 20
#: The same for buckets of a hash, which cost nothing to find.
HASH_ROWS = 1 << 16


def buckets_for(rows: int, each: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // each))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, however few bytes they are: for rows that become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hash_rank(df: DataFrame, by: list[str], hashed: str, ties: list[str], name: str = "rank", buckets: int | None = None, below: str | None = None) -> DataFrame:
    """Adds the 0-based rank of each row in its group by `hashed` (in [0, SPAN)), then by `ties`.

    buckets: by default those that the number of rows calls for, which is counted.
    below: a column of `by`: only ranks under it are kept, and buckets that lie beyond are
    left out before any row is shuffled or sorted.
    """
    buckets = buckets or buckets_for(df.count(), HASH_ROWS)
    if buckets > 1:
        df = df.withColumn("_bucket", F.floor(F.col(hashed) / F.lit(SPAN / buckets)).cast("int"))
        keys = [*by, "_bucket"]
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        if below:
            starts = starts.filter(F.col("_start") < F.col(below))
        same = reduce(and_, (df[k].eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)))
        starts = F.broadcast(starts.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), "_start"))  # a row for each group and bucket
        met = df.join(starts, same).drop(*(f"_s{i}" for i in range(len(keys))))
        own = Window.partitionBy(*keys).orderBy(hashed, *ties)
        ranked = met.withColumn(name, F.col("_start") + F.row_number().over(own) - 1).drop("_start", "_bucket")
    else:
        own = Window.partitionBy(*by).orderBy(hashed, *ties)
        ranked = df.withColumn(name, (F.row_number().over(own) - 1).cast("long"))
    return ranked.filter(F.col(name) < F.col(below)) if below else ranked


def value_cuts(df: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """Per group, values that cut it into about equal buckets (a fixed number of values for each group)."""
    shares = [i / buckets for i in range(1, buckets)]
    return df.groupBy(*by).agg(F.percentile_approx(value, shares, 10 * buckets).alias("_cuts"))


def bucketed(df: DataFrame, cuts: DataFrame, cut_by: list[str], value: str) -> DataFrame:
    """Adds `_bucket`: how many of the group's cuts, which are in order, lie below the value.

    cuts: from `value_cuts`, a row for each group. Every step-th cut is compared first, and then those
    of one step, so a row meets about two roots of the cuts: their number follows the rows.
    """
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("_cuts")))).cast("int")
    coarse = F.filter("_cuts", lambda c, i: (i + 1) % F.col("_step") == 0)
    met = df.join(F.broadcast(cuts.withColumn("_step", step).withColumn("_coarse", coarse)), cut_by)
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col(value)))
    met = met.withColumn("_passed", below("_coarse") * F.col("_step"))
    return met.withColumn("_bucket", F.col("_passed") + below(F.slice("_cuts", F.col("_passed") + 1, F.col("_step")))).drop("_cuts", "_coarse", "_step", "_passed")


def running(df: DataFrame, by: list[str], value: str, weight: Column | str, cuts: DataFrame | None = None, cut_by: list[str] | None = None, totals: dict[str, Column | str] | None = None) -> DataFrame:
    """Adds `below`: the weight in the group of rows with a smaller value. (group, value) must be unique.

    cuts: from `value_cuts` of `cut_by` columns, for groups too large for one task.
    totals: columns to add, each the group's sum of what it names. They come with the buckets'
    starts: a join by group would deal all rows of a group to one task.
    """
    weight, totals = F.col(weight) if isinstance(weight, str) else weight, totals or {}
    whole = Window.partitionBy(*by)
    if cuts is None:
        own = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({"below": F.coalesce(F.sum(weight).over(own), F.lit(0))} | {n: F.sum(t).over(whole) for n, t in totals.items()})
    df = bucketed(df.withColumn("_w", weight), cuts, cut_by, value)
    keys = [*by, "_bucket"]
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum("_w").alias("_n"), *(F.sum(t).alias(f"_sum_{n}") for n, t in totals.items()))
    starts = sums.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), *(F.sum(f"_sum_{n}").over(whole).alias(n) for n in totals))
    own = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0))).join(starts, keys)
    return df.withColumn("below", F.col("_start") + F.col("_own")).drop("_start", "_own", "_bucket", "_w")


def running_totals(df: DataFrame, by: list[str], value: str, weights: list[str], buckets: int | None = None, next_as: str | None = None) -> DataFrame:
    """Adds `below_{w}` for each weight: its total in the group over rows with a smaller value; and,
    if named, the group's next larger value. (by, value) must be unique.

    Groups are cut into buckets of values, the same for all weights, so samples that stand
    side by side as weights meet in one pass; totals and next values are carried across the
    buckets' borders. buckets: by default those that the largest group calls for.
    """
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    if buckets is None:
        buckets = buckets_for(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
    if buckets > 1:
        df = bucketed(df, value_cuts(df, keys, value, buckets), keys, value)
    else:
        df = df.withColumn("_bucket", F.lit(0))
    own = Window.partitionBy(*keys, "_bucket").orderBy(value)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    out = {f"below_{w}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights}
    if next_as:
        out[next_as] = F.lead(value).over(own)
    got = df.withColumns(out)
    if buckets > 1:
        sums = df.groupBy(*keys, "_bucket").agg(*(F.sum(w).alias(f"_sum_{w}") for w in weights), F.min(value).alias("_first"))
        across = Window.partitionBy(*keys).orderBy("_bucket")  # `buckets` rows
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_sum_{w}").over(earlier), F.lit(0)).alias(f"_start_{w}") for w in weights), F.lead("_first").over(across).alias("_next_bucket"))
        got = got.join(starts, [*keys, "_bucket"]).withColumns({f"below_{w}": F.col(f"_start_{w}") + F.col(f"below_{w}") for w in weights} | ({next_as: F.coalesce(next_as, "_next_bucket")} if next_as else {}))
    return got.select(*df.drop("_bucket", "_all").columns, *out)


def average_rank(df: DataFrame, by: list[str], value: str, name: str, descending: bool = False) -> DataFrame:
    """Adds the average rank (from 1) of each row by value: for groups of summary size, one window."""
    order = F.desc(value) if descending else F.asc(value)
    rank = F.rank().over(Window.partitionBy(*by).orderBy(order)) if by else F.rank().over(Window.orderBy(order))
    tie = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, rank + (tie - 1) / 2.0)


def average_rank_of_rows(df: DataFrame, by: list[str], value: str, name: str, buckets: int | None = None) -> DataFrame:
    """As average_rank, for groups of any size: distinct values are counted first, their running
    totals run in buckets, and rows get their value's rank. value must not be null."""
    own = df.select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c")).withColumn("_all", F.lit(0))
    buckets = buckets or buckets_for(own.count())
    keys = [*by, "_all"]
    cuts = value_cuts(own, keys, "_v", buckets) if buckets > 1 else None
    ranks = running(own, keys, "_v", "_c", cuts, keys)
    ranks = ranks.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_v", (F.col("below") + (F.col("_c") + 1) / 2.0).alias(name))
    same = F.col(value) == F.col("_v")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same).drop("_v", *(f"_k{i}" for i in range(len(by))))


def spearman(df: DataFrame, by: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Per group: the rank correlation of two columns, rows with a null left out; null if either is constant."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank_of_rows(average_rank_of_rows(both, by, a, "_ra"), by, b, "_rb")
    rho = F.when((F.var_pop("_ra") > 0) & (F.var_pop("_rb") > 0), F.corr("_ra", "_rb"))
    out = ranked.groupBy(*by) if by else ranked
    return out.agg(rho.alias(name), F.count("*").alias("n"))
