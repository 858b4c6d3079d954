"""How far each resample's distribution, and its relation to the target, is from the full sample's.

All functions take samples compacted to distinct values: (keys..., x, y, cnt).
Rank statistics come from running totals of values (in buckets for large groups),
densities from partial sums per Arrow batch, so no task ever holds a whole sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ranking import average_rank, buckets_for, running, running_totals, value_cuts

GRID = 200
LEAST = 1e-10
#: Tasks that share a group's kernels.
PARTS = 8


def order_quantiles(run: DataFrame, by: list[str], shares: Sequence[float], total: str = "m", name: str = "q", extra: dict[str, Column] | None = None) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, from rows with `below`, `c` and the group's total."""
    at = [F.lit(float(s)) * (F.col(total) - 1) for s in shares]
    holds = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col("x")))
    parts = {}
    for i, h in enumerate(at):
        parts |= {f"_lo{i}": holds(F.floor(h)), f"_hi{i}": holds(F.ceil(h)), f"_t{i}": F.max(h - F.floor(h))}
    got = run.groupBy(*by).agg(*(c.alias(n) for n, c in (parts | (extra or {})).items()))
    values = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}") for i in range(len(at))]
    return got.select(*by, F.array(*values).alias(name), *(extra or {}))


def cuts_of(samples: DataFrame, by: list[str], each: int = 1 << 18) -> DataFrame | None:
    """`value_cuts` for the cuts of `value_table`, so that no bucket holds many more rows than `each`; None if no group does.

    A row per group, with one number for `each` rows.
    """
    buckets = buckets_for(samples.groupBy(*by).count().agg(F.max("count")).first()[0] or 0, each)
    return value_cuts(samples, by, "x", buckets) if buckets > 1 else None


def value_table(samples: DataFrame, by: list[str], cuts: DataFrame | None = None, cut_by: list[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (by, x, c, e, below, m, events): each value's draws and events, the draws below it, and the group's totals."""
    values = samples.groupBy(*by, "x", *carry).agg(F.sum("cnt").alias("c"), F.sum(F.col("cnt") * F.col("y")).alias("e"))
    return running(values, by, "x", "c", cuts, cut_by, {"m": "c", "events": "e", "n_values": F.lit(1)})


def reference(values: DataFrame, by: list[str]) -> DataFrame:
    """Per feature, from `value_table` of the full sample: size, range, quartiles, bandwidth, scale."""
    mean_of = lambda c: F.sum(F.col("c") * c) / F.max("m")
    stats = {
        "n": F.max("m"), "low": F.min("x"), "high": F.max("x"), "_mean": mean_of(F.col("x")),
        "n_events": F.max("events"), "n_distinct": F.count("*"),
    }
    q = order_quantiles(values, by, (0.25, 0.5, 0.75), extra=stats)
    spread = values.join(F.broadcast(q.select(*by, "_mean")), by).groupBy(*by).agg((F.sum(F.col("c") * F.pow(F.col("x") - F.col("_mean"), 2)) / F.greatest(F.max("m") - 1, F.lit(1))).alias("_var"))
    q = q.join(spread, by)
    sd, iqr = F.sqrt("_var"), F.col("q")[2] - F.col("q")[0]
    s = F.least(sd, iqr / 1.34)
    s = F.when(s > 0, s).when(sd > 0, sd).otherwise(F.lit(1.0))
    width = F.col("high") - F.col("low")
    scale = F.when(iqr > 0, iqr).when(width > 0, width).otherwise(F.lit(1.0))
    return q.select(
        *by, "n", "n_events", "n_distinct", "low", "high", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"),
        sd.alias("sd"), (1.06 * s * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"), scale.alias("scale"),
    )


def densities(samples: DataFrame, by: list[str], ref: DataFrame, ref_by: list[str], grid: int = GRID, resamples: int | None = None) -> DataFrame:
    """Rows (by, g, p): Gaussian density on the feature's fixed grid, summing to 1 over the grid.

    resamples: samples stand side by side as counts c0, c1, ..., a row for each value; the result has
    rows (by, r, g, p), and a value's kernel is made once for all of them.

    A batch adds up its rows' kernels per group. Rows come to it in the order of their
    groups, and a group lies in at most PARTS tasks, so what is shuffled grows with the
    groups and the batches, not with rows times the grid.
    """
    dealt = samples.withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(PARTS))).repartition(*by, "_part")
    counts = ["cnt"] if resamples is None else [f"c{r}" for r in range(resamples)]
    rows = dealt.groupBy(*by, "_part", "x").agg(F.sum("cnt").alias("cnt")) if resamples is None else dealt
    rows = rows.join(F.broadcast(ref.select(*ref_by, "low", "high", "bandwidth")), ref_by).sortWithinPartitions(*by)
    rows = rows.select(*by, F.xxhash64(*by).alias("_gid"), "x", "low", "high", "bandwidth", *counts)
    groups = list(by)
    schema = T.StructType([rows.schema[b] for b in by] + [T.StructField("_number", T.IntegerType()), T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def run(batches):
        steps = np.linspace(0.0, 1.0, grid)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            gid, x, low, high, h, *own_counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_gid", "x", "low", "high", "bandwidth", *counts))
            cnt = np.stack(own_counts).astype(float)
            order = np.argsort(gid, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(gid[order]) != 0]))
            out = np.zeros((len(first), len(counts), grid))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            for a in range(0, n, 2048):
                at = order[a : a + 2048]
                z = (low[at, None] + (high - low)[at, None] * steps - x[at, None]) / h[at, None]
                k = np.exp(-0.5 * z * z)
                own = owner[a : a + 2048]
                starts = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
                for i, j in zip(starts, [*starts[1:], len(own)], strict=True):
                    out[own[i]] += cnt[:, at[i:j]] @ k[i:j]
            first = np.repeat(first, len(counts))
            number = pa.array(np.tile(np.arange(len(counts), dtype=np.int32), len(out)))
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, grid, dtype=np.int32)), pa.array(out.ravel()))
            keys = pa.array(order[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(b).take(keys) for b in groups), number, sums], names=[*groups, "_number", "_s"])

    parts = rows.mapInArrow(run, schema)
    if resamples is not None:
        parts, by = parts.withColumnRenamed("_number", "r"), [*by, "r"]
    summed = parts.select(*by, F.posexplode("_s").alias("g", "s")).groupBy(*by, "g").agg(F.sum("s").alias("s"))
    whole = F.sum("s").over(Window.partitionBy(*by))  # `grid` rows each
    return summed.select(*by, "g", F.when(whole > 0, F.col("s") / whole).otherwise(F.col("s")).alias("p"))


def density_distances(density: DataFrame, ref_density: DataFrame, ref: DataFrame, by: list[str], ref_by: list[str], grid: int = GRID) -> DataFrame:
    """Per group: wasserstein (in units of the scale) and js (a distance, in nats)."""
    met = density.join(F.broadcast(ref_density.select(*ref_by, "g", F.col("p").alias("p0"))), [*ref_by, "g"])
    upto = Window.partitionBy(*by).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    met = met.withColumn("gap", F.abs(F.sum(F.col("p") - F.col("p0")).over(upto)))
    clipped = lambda c: F.greatest(F.col(c), F.lit(LEAST)) / F.sum(F.greatest(F.col(c), F.lit(LEAST))).over(whole)
    met = met.withColumns({"a": clipped("p0"), "b": clipped("p")})
    mid = (F.col("a") + F.col("b")) / 2
    terms = F.col("a") * F.log(F.col("a") / mid) + F.col("b") * F.log(F.col("b") / mid)
    sums = met.withColumn("t", terms).groupBy(*by).agg(F.sum(F.when(F.col("g") < grid - 1, F.col("gap"))).alias("w"), F.sum("t").alias("t"))
    sums = sums.join(F.broadcast(ref.select(*ref_by, "low", "high", "scale")), ref_by)
    step = (F.col("high") - F.col("low")) / F.lit(float(grid - 1))
    return sums.select(*by, (F.col("w") * step / F.col("scale")).alias("wasserstein"), F.sqrt(F.greatest(F.col("t") / 2, F.lit(0.0))).alias("js"))


def values_side_by_side(samples: DataFrame, by: list[str], resamples: int, buckets: int | None = None) -> DataFrame:
    """As `value_table` with r in the groups, from samples side by side: (by, x, f0_below, f0_upto, c0, e0, c1, e1, ...), a
    row for each value with each resample's draws and events. Only those rows are shuffled, not one for each resample."""
    every = range(resamples)
    whole = samples.groupBy(*by).agg(*(F.array(F.sum(f"c{r}"), F.sum(f"e{r}"), F.count_if(F.col(f"c{r}") > 0)).alias(f"_t{r}") for r in every))  # a row for each group
    run = running_totals(samples, by, "x", [f"c{r}" for r in every], buckets).join(F.broadcast(whole), by)
    one = lambda r: F.struct(F.lit(r).alias("r"), F.col(f"c{r}").alias("c"), F.col(f"e{r}").alias("e"), F.col(f"below_c{r}").alias("below"), *(F.col(f"_t{r}")[i].alias(n) for i, n in enumerate(("m", "events", "n_values"))))
    return run.select(*by, "x", "f0_below", "f0_upto", F.explode(F.array(*map(one, every))).alias("v")).select(*by, "x", "f0_below", "f0_upto", "v.*").filter("c > 0")


def draws_side_by_side(samples: DataFrame, by: list[str], resamples: int) -> DataFrame:
    """Rows (by, r, x, y, cnt) of samples side by side, as metrics of single samples take them."""
    one = lambda r: [F.struct(F.lit(r).alias("r"), F.lit(y).alias("y"), n.alias("cnt")) for y, n in ((1, F.col(f"e{r}")), (0, F.col(f"c{r}") - F.coalesce(F.col(f"e{r}"), F.lit(0))))]
    carried = [c for c in samples.columns if c in ("f0_below", "f0_upto")]
    return samples.select(*by, "x", *carried, F.explode(F.array(*(s for r in range(resamples) for s in one(r)))).alias("v")).select(*by, "x", *carried, "v.*").filter("cnt > 0")


def rank_statistics(values: DataFrame, by: list[str], shares: Sequence[float] = ()) -> DataFrame:
    """Per group of `value_table` rows that carry f0_below and f0_upto (the full sample's
    shares below and up to x): m, events, degenerate, ks, spearman, and quantiles q."""
    m = F.col("m").cast("double")
    below, upto = F.col("below") / m, (F.col("below") + F.col("c")) / m
    gap = F.greatest(F.abs(F.col("f0_upto") - upto), F.abs(F.col("f0_below") - below))
    rank = F.col("below") + (F.col("c") + 1) / 2.0 - (m + 1) / 2.0  # centred average rank
    share = F.max("events") / F.max("m")
    cov = F.sum(rank * F.col("e")) / F.max("m")
    var = F.sum(F.col("c") * rank * rank) / F.max("m")
    rho = F.when((var > 0) & (share > 0) & (share < 1), F.abs(cov / F.sqrt(var * share * (1 - share))))
    degenerate = (F.max("n_values") < 2) | F.coalesce((F.max("events") == 0) | (F.max("events") == F.max("m")), F.lit(False))
    extra = {"m": F.max("m"), "events": F.max("events"), "degenerate": degenerate, "ks": F.max(gap), "spearman": rho}
    return order_quantiles(values, by, shares or (0.5,), extra=extra)


def _side_by_side(a: DataFrame, b: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows (by, x, ca, cb, na, nb): two samples' weights of each value, and their totals."""
    x = F.col(value).cast("double").alias("x")
    w = F.col(weight) if weight else F.lit(1)
    both = a.select(*by, x, w.alias("ca"), F.lit(0).alias("cb")).unionByName(b.select(*by, x, F.lit(0).alias("ca"), w.alias("cb")))
    v = both.filter("x is not null").groupBy(*by, "x").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    totals = v.groupBy(*by).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    return v.join(totals, by) if by else v.crossJoin(F.broadcast(totals))  # one row


def _gap() -> Column:
    """Between the two distribution functions, after a value."""
    return F.abs((F.col("below_ca") + F.col("ca")) / F.col("na") - (F.col("below_cb") + F.col("cb")) / F.col("nb"))


def ks_two_sample(a: DataFrame, b: DataFrame, by: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """Per group: the largest gap between two samples' distribution functions, over pooled values."""
    run = running_totals(_side_by_side(a, b, by, value), by, "x", ["ca", "cb"], buckets)
    return (run.groupBy(*by) if by else run).agg(F.max(_gap()).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def ks_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """As `ks_two_sample`, of values counted already: (by, x, ca, cb), x unique in its group and not null. The
    table is read several times, so it should be one that is written."""
    totals = counts.groupBy(*by).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    run = running_totals(counts.select(*by, "x", "ca", "cb"), by, "x", ["ca", "cb"]).join(F.broadcast(totals), by)  # a row for each group
    return run.groupBy(*by).agg(F.max(_gap()).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def wasserstein_two_sample(a: DataFrame, b: DataFrame, by: list[str], value: str, weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Per group: the integral of the gap between two samples' distribution functions."""
    run = running_totals(_side_by_side(a, b, by, value, weight), by, "x", ["ca", "cb"], buckets, "_next")
    part = _gap() * (F.col("_next") - F.col("x"))
    return (run.groupBy(*by) if by else run).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("wasserstein"))


#: Rows of a bucket of values that a task of `wasserstein_to_reference` holds.
REFERENCE_ROWS = 1 << 19


def wasserstein_to_reference(samples: DataFrame, reference: DataFrame, by: list[str], group: str, value: str, buckets: int | None = None) -> DataFrame:
    """Per (by, group): the integral of the gap between a sample's distribution function and that of
    the group's reference (group, value), which all samples share.

    A bucket of a group's values is one task's work: it holds the reference's values once, and the
    samples are laid over them one after another, from where they stand at the bucket's start. So
    the reference is not repeated for each sample, and no sample is sorted by itself.
    """
    x = F.col(value).cast("double").alias("x")
    own = samples.select(F.xxhash64(*by).alias("_id"), group, x).filter("not isnan(coalesce(x, double('NaN')))")
    ref = reference.select(group, x).filter("not isnan(coalesce(x, double('NaN')))")
    if buckets is None:
        buckets = buckets_for(own.groupBy(group).count().agg(F.max("count")).first()[0] or 0, REFERENCE_ROWS)
    # the reference has the samples' spread in a fraction of their rows; `buckets` numbers for each group
    cuts = value_cuts(ref, [group], "x", buckets).collect() if buckets > 1 else []
    names = {r[group]: i for i, r in enumerate(cuts)}
    places = [np.array(r["_cuts"], float) for r in cuts]

    @F.pandas_udf("int")
    def bucket(g: pd.Series, v: pd.Series) -> pd.Series:
        out, g, v = np.zeros(len(v), np.int32), g.to_numpy(), v.to_numpy()
        for i, cut in enumerate(places):
            at = g == i
            out[at] = np.searchsorted(cut, v[at], side="left")
        return pd.Series(out)

    if cuts:
        number = F.create_map(*(F.lit(k) for pair in names.items() for k in pair))
        place = lambda d: d.withColumn("_bucket", bucket(F.coalesce(F.try_element_at(number, F.col(group)), F.lit(-1)), F.col("x")))
    else:
        place = lambda d: d.withColumn("_bucket", F.lit(0))
    both = place(own.withColumn("_is_ref", F.lit(False)).unionByName(ref.select(F.lit(0).cast("long").alias("_id"), group, "x", F.lit(True).alias("_is_ref"))))
    key = ["_is_ref", "_id"]
    counts = both.groupBy(group, "_bucket", *key).agg(F.count("*").alias("n"), F.min("x").alias("first"))
    counts = counts.localCheckpoint()  # a row for each sample and bucket
    firsts = counts.groupBy(group, "_bucket").agg(F.min("first").alias("_first"))
    firsts = firsts.withColumn("next", F.lead("_first").over(Window.partitionBy(group).orderBy("_bucket"))).drop("_first")
    every = firsts.join(F.broadcast(counts.groupBy(group, *key).agg(F.sum("n").alias("total"))), group).join(counts.drop("first"), [group, "_bucket", *key], "left").fillna(0, ["n"])
    earlier = Window.partitionBy(group, *key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rows = both.select(group, "_bucket", *key, "x", F.lit(1).cast("long").alias("c"), *(F.lit(None).cast(t).alias(n) for n, t in (("start", "long"), ("total", "long"), ("next", "double"))))
    rows = rows.unionByName(starts.select(group, "_bucket", *key, F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("c"), "start", "total", "next"))
    rows = rows.repartition(group, "_bucket").groupBy(group, "_bucket", *key, "x").agg(F.sum("c").alias("c"), *(F.max(n).alias(n) for n in ("start", "total", "next")))
    kind = samples.schema[group].dataType

    def run(t: pa.Table) -> pa.Table:
        is_ref, sample, v, c, start, total = (t.column(n).to_numpy() for n in ("_is_ref", "_id", "x", "c", "start", "total"))
        info = np.flatnonzero(np.isnan(v))
        at = np.flatnonzero(~np.isnan(v))
        ref_info = info[is_ref[info]]
        values, place = np.unique(v[at], return_inverse=True)
        after = t.column("next").combine_chunks().take(pa.array(info[:1])).to_pylist()[0]
        steps = np.diff(np.append(values, values[-1] if after is None else after))
        of_ref = is_ref[at]
        n_ref = total[ref_info[0]] if len(ref_info) else 0
        share = (np.bincount(place[of_ref], c[at][of_ref], len(values)).cumsum() + (start[ref_info[0]] if n_ref else 0)) / max(n_ref, 1)
        place, weight, who = place[~of_ref], c[at][~of_ref], sample[at][~of_ref]
        order = np.argsort(who, kind="stable")
        who = who[order]
        ids, parts = [], []
        for i in info[~is_ref[info]]:
            mine = order[np.searchsorted(who, sample[i], "left") : np.searchsorted(who, sample[i], "right")]
            gap = np.bincount(place[mine], weight[mine], len(values)).cumsum() + start[i]
            ids.append(sample[i])
            parts.append(float(np.abs(gap / total[i] - share) @ steps) if n_ref else None)
        g = t.column(group).combine_chunks().take(pa.array(np.zeros(len(ids), np.int64)))
        return pa.table({group: g, "_id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.float64())})

    schema = T.StructType([T.StructField(group, kind), T.StructField("_id", T.LongType()), T.StructField("part", T.DoubleType())])
    found = rows.groupBy(group, "_bucket").applyInArrow(run, schema).groupBy(group, "_id").agg(F.sum("part").alias("wasserstein"))
    ids = samples.select(*by).distinct().withColumn("_id", F.xxhash64(*by))  # a row for each sample
    return found.join(F.broadcast(ids), "_id").select(*by, group, "wasserstein")


# -- weight of evidence --------------------------------------------------------------------


def binned(samples: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, bin, events, others, n_bins): every bin of the group's distinct edges, empty ones
    too; a value lies in the bin whose inner edges it has reached. Fewer than 3 edges: no rows."""
    cuts = edges.select(*by, F.array_distinct("q").alias("q")).filter(F.size("q") >= 3)
    cuts = cuts.select(*by, F.slice("q", F.lit(2), F.size("q") - 2).alias("inner"))
    met = samples.join(F.broadcast(cuts), by)  # a row for each group; dealt by group, one task would read all its values
    number = F.size(F.filter("inner", lambda c: c <= F.col("x")))
    counts = met.groupBy(*by, number.alias("bin")).agg(F.sum(F.col("cnt") * F.col("y")).alias("events"), F.sum(F.col("cnt") * (1 - F.col("y"))).alias("others"))
    n_bins = F.size("inner") + 1
    all_bins = cuts.select(*by, n_bins.alias("n_bins"), F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    return all_bins.join(counts, [*by, "bin"], "left").fillna(0, ["events", "others"])


def by_value(samples: DataFrame, by: list[str]) -> DataFrame:
    """As `binned`, one bin for each value, in the order of values."""
    counts = samples.groupBy(*by, "x").agg(F.sum(F.col("cnt") * F.col("y")).alias("events"), F.sum(F.col("cnt") * (1 - F.col("y"))).alias("others"))
    order = Window.partitionBy(*by).orderBy("x")
    return counts.withColumns({"bin": F.row_number().over(order) - 1, "n_bins": F.count("*").over(Window.partitionBy(*by))}).drop("x")


def woe(bins: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, bin, n_bins, woe, iv_part), smoothed by half a row; groups with one class only have none."""
    whole = Window.partitionBy(*by)
    b = bins.withColumns({"_e": F.sum("events").over(whole), "_o": F.sum("others").over(whole)}).filter("_e > 0 and _o > 0")
    e = (F.col("events") + 0.5) / (F.col("_e") + 0.5 * F.col("n_bins"))
    o = (F.col("others") + 0.5) / (F.col("_o") + 0.5 * F.col("n_bins"))
    return b.select(*by, "bin", "n_bins", F.log(e / o).alias("woe"), ((e - o) * F.log(e / o)).alias("iv_part"))


def information_value(woes: DataFrame, by: list[str]) -> DataFrame:
    """Per group: iv, monotonicity (rank correlation of bin and evidence, absolute), woe_profile."""
    ranked = average_rank(woes, by, "woe", "_r")
    rho = F.coalesce(F.when(F.var_pop("_r") > 0, F.abs(F.corr(F.col("bin").cast("double"), F.col("_r")))), F.lit(0.0))
    mono = F.when(F.count("*") > 2, rho).when(F.count("*") == 2, (F.min("woe") != F.max("woe")).cast("double")).otherwise(F.lit(1.0))
    profile = F.transform(F.sort_array(F.collect_list(F.struct("bin", "woe"))), lambda s: s["woe"])  # n_bins values
    return ranked.groupBy(*by).agg(F.sum("iv_part").alias("iv"), mono.alias("monotonicity"), profile.alias("woe_profile"))


# -- categories ------------------------------------------------------------------------------


def category_distances(samples: DataFrame, full: DataFrame, by: list[str], full_by: list[str]) -> DataFrame:
    """Per group: tv (half the sum of share gaps) and js, over the union of values.

    full: (full_by..., x, cnt) of the whole sample; a group's values are among them or not.
    """
    whole = Window.partitionBy(*by)
    p = samples.groupBy(*by, "x").agg(F.sum("cnt").alias("c"))
    groups = p.select(*by).distinct()
    q = full.groupBy(*full_by, "x").agg(F.sum("cnt").alias("c0"))
    every = groups.join(F.broadcast(q), full_by) if full_by else groups.crossJoin(F.broadcast(q))
    met = every.join(p, [*by, "x"], "full").fillna(0, ["c", "c0"])
    met = met.withColumns({"p": F.col("c") / F.sum("c").over(whole), "p0": F.col("c0") / F.sum("c0").over(whole)})
    clipped = lambda c: F.greatest(F.col(c), F.lit(LEAST)) / F.sum(F.greatest(F.col(c), F.lit(LEAST))).over(whole)
    met = met.withColumns({"a": clipped("p0"), "b": clipped("p")})
    mid = (F.col("a") + F.col("b")) / 2
    terms = F.col("a") * F.log(F.col("a") / mid) + F.col("b") * F.log(F.col("b") / mid)
    met = met.withColumns({"t": terms, "gap": F.abs(F.col("p") - F.col("p0"))})
    return met.groupBy(*by).agg((F.sum("gap") / 2).alias("tv"), F.sqrt(F.greatest(F.sum("t") / 2, F.lit(0.0))).alias("js"))


# -- all of them -------------------------------------------------------------------------------


def full_sample(long: DataFrame) -> DataFrame:
    """Rows (feature, x, y, cnt) of a long table (feature, x, y)."""
    return long.groupBy("feature", "x", "y").agg(F.count("*").alias("cnt"))


def with_full_shares(values: DataFrame) -> DataFrame:
    """(feature, x, f0_below, f0_upto) from the full sample's `value_table`."""
    return values.select("feature", "x", (F.col("below") / F.col("m")).alias("f0_below"), ((F.col("below") + F.col("c")) / F.col("m")).alias("f0_upto"))


def continuous_metrics(samples: DataFrame, by: list[str], ref: DataFrame, ref_density: DataFrame, has_target: bool, n_bins: int = 5, cuts: DataFrame | None = None, values: DataFrame | None = None, density: DataFrame | None = None, hold: Callable = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Per group (which holds `feature`): the six metrics. samples carry f0_below and f0_upto.

    Also returns the degenerate groups: (by, degenerate). values, density: the samples' `value_table` and
    `densities`, where they come from elsewhere. hold: writes the statistics of groups, which are read again.
    """
    values = value_table(samples, by, cuts, ["feature"], ["f0_below", "f0_upto"]) if values is None else values
    stats = hold(rank_statistics(values, by, [i / n_bins for i in range(n_bins + 1)]))
    good = stats.filter("not degenerate")
    density = densities(samples, by, ref, ["feature"]) if density is None else density
    distances = density_distances(density, ref_density, ref, by, ["feature"])
    out = good.join(distances, by)
    if has_target:
        evidence = information_value(woe(binned(samples, good.select(*by, "q"), by), by), by)
        out = out.join(evidence, by, "left")
    else:
        out = out.withColumns({"iv": F.lit(None).cast("double"), "monotonicity": F.lit(None).cast("double"), "woe_profile": F.lit(None).cast("array<double>")})
    return out.select(*by, "wasserstein", "ks", "js", "spearman", "iv", "monotonicity", "woe_profile"), stats.select(*by, "degenerate")


def categorical_metrics(samples: DataFrame, by: list[str], full: DataFrame, has_target: bool, cuts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As `continuous_metrics`, for features of few values: total variation stands in for wasserstein; no monotonicity."""
    values = value_table(samples, by, cuts, ["feature"], ["f0_below", "f0_upto"])
    stats = rank_statistics(values, by)
    out = stats.filter("not degenerate").join(category_distances(samples, full, by, ["feature"]).withColumnRenamed("tv", "wasserstein"), by)
    if has_target:
        evidence = information_value(woe(by_value(samples, by), by), by).drop("monotonicity")
        out = out.join(evidence, by, "left")
    else:
        out = out.withColumns({"iv": F.lit(None).cast("double"), "woe_profile": F.lit(None).cast("array<double>")})
    out = out.withColumn("monotonicity", F.lit(None).cast("double"))
    return out.select(*by, "wasserstein", "ks", "js", "spearman", "iv", "monotonicity", "woe_profile"), stats.select(*by, "degenerate")
