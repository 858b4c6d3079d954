"""Checks, sampling, marginal metrics and curves over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.operators import checks, curves, marginal, out_of_sample, sampling
from plumbline.operators.analyzer import StabilityAnalyzer
from plumbline.operators.ranking import spearman
from plumbline.plans.registry import query
from plumbline.plans.tables import DRAW_SQL, LINE_FEATURES, LINE_KEY, LINES_SQL, ORDERS_SQL, lines, long_sql, orders

LONG = long_sql(LINES_SQL, LINE_FEATURES)
SEVERITY = "CASE WHEN m < 0.01 THEN 'critical' WHEN m < 0.05 THEN 'severe' WHEN m < 0.10 THEN 'moderate' ELSE 'none' END"


def long_lines(read):
    return checks.to_long(lines(read), LINE_FEATURES, "target")


@query("imbalance_check", "n_obs ~event_rate ~minority_rate severity imbalance_flag", f"""
    SELECT n_obs, p AS event_rate, m AS minority_rate, {SEVERITY} AS severity, m < 0.05 AS imbalance_flag
    FROM (SELECT *, least(p, 1 - p) AS m FROM (SELECT count(*) AS n_obs, avg(target) AS p FROM ({LINES_SQL})))""")
def _(read):
    return checks.imbalance(lines(read), "target")


@query("imbalance_by_priority", "o_orderpriority n_obs ~event_rate ~minority_rate severity imbalance_flag", f"""
    SELECT o_orderpriority, n_obs, p AS event_rate, m AS minority_rate, {SEVERITY} AS severity, m < 0.05 AS imbalance_flag
    FROM (SELECT *, least(p, 1 - p) AS m FROM (SELECT o_orderpriority, count(*) AS n_obs, avg(target) AS p FROM ({ORDERS_SQL}) GROUP BY ALL))""")
def _(read):
    return checks.imbalance(orders(read), "target", by=["o_orderpriority"])


@query("feature_kind", "feature n_obs n_distinct kind", f"""
    SELECT feature, count(*) AS n_obs, count(DISTINCT x) AS n_distinct, CASE WHEN count(DISTINCT x) = 2 THEN 'binary' WHEN count(DISTINCT x) <= 10 THEN 'categorical' ELSE 'continuous' END AS kind
    FROM ({LONG}) GROUP BY feature""")
def _(read):
    return checks.kinds(long_lines(read))


@query("truncation_severity", "feature n_obs ~share_low ~share_high flag_low flag_high ~severity_low ~severity_high censoring_flag ~censoring_severity note", f"""
    WITH t AS ({LONG}), e AS (SELECT feature, min(x) AS lo, max(x) AS hi, count(*) AS n, count(DISTINCT x) AS d FROM t GROUP BY feature),
    m AS (SELECT feature, any_value(n) AS n, any_value(d) AS d, avg((x = lo)::INT) AS pl, avg((x = hi)::INT) AS ph,
            avg((x <= lo + 0.01::DOUBLE * (hi - lo))::INT) AS ol, avg((x <= lo + 0.05::DOUBLE * (hi - lo) AND x > lo + 0.01::DOUBLE * (hi - lo))::INT) AS bl,
            avg((x >= hi - 0.01::DOUBLE * (hi - lo))::INT) AS oh, avg((x >= hi - 0.05::DOUBLE * (hi - lo) AND x < hi - 0.01::DOUBLE * (hi - lo))::INT) AS bh FROM t JOIN e USING (feature) GROUP BY feature),
    r AS (SELECT *, CASE WHEN bl > 0 THEN ol / bl ELSE 0 END AS rl, CASE WHEN bh > 0 THEN oh / bh ELSE 0 END AS rh, n >= 100 AND d > 2 AS ok FROM m),
    f AS (SELECT *, ok AND (pl > 0.1 OR rl > 3) AS fl, ok AND (ph > 0.1 OR rh > 3) AS fh FROM r),
    s AS (SELECT *, CASE WHEN fl THEN 0.5 * least(pl, 1) + 0.3 * least(rl / 20, 1) + 0.2 * least(ol, 1) ELSE 0 END AS sl, CASE WHEN fh THEN 0.5 * least(ph, 1) + 0.3 * least(rh / 20, 1) + 0.2 * least(oh, 1) ELSE 0 END AS sh FROM f)
    SELECT feature, n AS n_obs, pl AS share_low, ph AS share_high, fl AS flag_low, fh AS flag_high, sl AS severity_low, sh AS severity_high, fl OR fh AS censoring_flag, greatest(sl, sh) AS censoring_severity,
           CASE WHEN n < 100 THEN 'insufficient samples' WHEN d <= 2 THEN 'binary' ELSE 'checked' END AS note FROM s""")
def _(read):
    return checks.truncation(long_lines(read))


@query("table_snapshot", "n_rows n_features ~event_rate n_binary n_categorical n_continuous", f"""
    WITH k AS (SELECT feature, count(DISTINCT x) AS d FROM ({LONG}) GROUP BY feature)
    SELECT (SELECT count(*) FROM lineitem) AS n_rows, 4::BIGINT AS n_features, (SELECT avg(target) FROM ({LINES_SQL})) AS event_rate,
           count(*) FILTER (d = 2) AS n_binary, count(*) FILTER (d <> 2 AND d <= 10) AS n_categorical, count(*) FILTER (d > 10) AS n_continuous FROM k""")
def _(read):
    return checks.snapshot(lines(read), LINE_FEATURES, "target")


@query("complete_cases", "feature n ~mean_x events", """
    SELECT 'quality' AS feature, count(*) AS n, avg(d.n_chars) AS mean_x, sum(l.toxic)::BIGINT AS events FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL""")
def _(read):
    joined = read("documents").select("doc_id", F.col("n_chars").alias("quality")).join(read("labels").select("doc_id", "toxic"), "doc_id", "left")
    return checks.to_long(joined, ["quality"], "toxic").groupBy("feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.sum("y").alias("events"))


@query("null_shares", "name ~null_share", """
    WITH j AS (SELECT l.toxic, l.quality, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'toxic' AS name, avg((toxic IS NULL)::INT) AS null_share FROM j UNION ALL SELECT 'quality', avg((quality IS NULL)::INT) FROM j UNION ALL SELECT 'n_chars', avg((n_chars IS NULL)::INT) FROM j""")
def _(read):
    return checks.null_shares(read("documents").drop("quality").join(read("labels"), "doc_id", "left"), ["toxic", "quality", "n_chars"])


@query("median_impute", "doc_id ~toxic ~quality", """
    WITH j AS (SELECT d.doc_id, l.toxic::DOUBLE AS toxic, l.quality::DOUBLE AS quality FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT quantile_cont(toxic, 0.5) AS t, quantile_cont(quality, 0.5) AS q FROM j)
    SELECT doc_id, coalesce(toxic, t) AS toxic, coalesce(quality, q) AS quality FROM j, m""")
def _(read):
    joined = read("documents").select("doc_id").join(read("labels"), "doc_id", "left")
    return checks.impute_medians(joined, ["toxic", "quality"])


@query("winsorise", "o_orderkey ~o_totalprice", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
    SELECT o_orderkey, least(greatest(o_totalprice, lo), hi) AS o_totalprice FROM orders, q""")
def _(read):
    return checks.winsorise(read("orders"), ["o_totalprice"])


# -- keyed draws: the hash of the key decides --------------------------------------------------

_DRAW = DRAW_SQL
#: The ladder of pools up to all customers, as `sampling.pool_ladder` climbs it: 25 steps, from 50.
_POOLS = """SELECT row_number() OVER (ORDER BY pool_size) - 1 AS pool, pool_size FROM (
    SELECT unnest(CASE WHEN n <= 1000 THEN [round_even(i * ((n - 50) / 24.0::DOUBLE) + 50, 0)::BIGINT for i in range(25)]
        ELSE list_concat([round_even(i * (950 / 11.0::DOUBLE) + 50, 0)::BIGINT for i in range(12)], [round_even(pow(10.0::DOUBLE, i * ((log10(n) - 3) / 13.0::DOUBLE) + 3), 0)::BIGINT for i in range(1, 14)]) END) AS pool_size
    FROM (SELECT count(*) AS n FROM customer) UNION SELECT count(*) FROM customer)"""
_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY {_DRAW.format("concat_ws('-', 'row', c_custkey)")}, c_custkey) - 1 AS row_id FROM customer"
_POOLED = f"""SELECT * FROM (SELECT r.*, p.*, row_number() OVER (PARTITION BY pool ORDER BY {_DRAW.format("concat_ws('-', 42, 'pool', pool, 0, row_id)")}, row_id) - 1 AS slot FROM ({_NUMBERED}) r, ({_POOLS}) p) WHERE slot < pool_size"""
_DRAWS = f"""SELECT pool, pool_size, r, ({_DRAW.format("concat_ws('-', 42, 'boot', pool, 0, r, i)")} % pool_size) AS slot, count(*) AS cnt
    FROM (SELECT p.*, unnest(range(4)) AS r FROM ({_POOLS}) p) q, LATERAL (SELECT unnest(range(greatest(1, floor(q.pool_size * 0.8::DOUBLE)::BIGINT))) AS i) GROUP BY ALL"""
_SAMPLES = f"""SELECT d.pool, d.pool_size, d.r, c_acctbal AS x, (c_mktsegment = 'BUILDING')::INT AS y, sum(cnt) AS cnt FROM ({_DRAWS}) d JOIN ({_POOLED}) p USING (pool, pool_size, slot) GROUP BY ALL"""


def _numbered(read):
    return sampling.number_rows(read("customer"), ["c_custkey"], backend="md5")


def _plan(read):
    rows = [(i, 0, size) for i, size in enumerate(sampling.pool_ladder(read("customer").count()))]
    return read("region").sparkSession.createDataFrame(rows, "pool int, draw_no int, pool_size long")


def _pooled(read):
    return sampling.draw_pools(_numbered(read), _plan(read), [], 42, backend="md5")


def _samples(read):
    """customer balances in pools and resamples, with the full sample's shares."""
    base = _pooled(read).withColumns({"x": F.col("c_acctbal"), "y": (F.col("c_mktsegment") == "BUILDING").cast("int"), "feature": F.lit("c_acctbal")})
    full = _full(read)
    shares = marginal.with_full_shares(marginal.value_table(full, ["feature"], _cuts(read), ["feature"]))
    pooled = base.join(shares, ["feature", "x"])
    plan = _plan(read).withColumn("feature", F.lit("c_acctbal"))
    return sampling.bootstrap(pooled, plan, ["feature"], 4, 0.8, 42, ["x", "y", "f0_below", "f0_upto"], "md5")


def _full(read):
    c = read("customer").select(F.lit("c_acctbal").alias("feature"), F.col("c_acctbal").alias("x"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    return marginal.full_sample(c)


def _cuts(read):
    return marginal.cuts_of(_full(read), ["feature"])


@query("pool_ladder", "pool pool_size", f"SELECT pool::INT AS pool, pool_size::BIGINT AS pool_size FROM ({_POOLS})")
def _(read):
    return _plan(read).drop("draw_no")


@query("pool_draw", "pool pool_size slot c_custkey", f"SELECT pool::INT AS pool, pool_size::BIGINT AS pool_size, slot, c_custkey FROM ({_POOLED})")
def _(read):
    return _pooled(read)


@query("bootstrap_resample", "pool r slot cnt", f"SELECT pool::INT AS pool, r::INT AS r, slot, cnt FROM ({_DRAWS})")
def _(read):
    return sampling.draw_resamples(_plan(read), [], 4, 0.8, 42, "md5")


@query("exact_subsample", "o_orderkey", f"""SELECT o_orderkey FROM orders ORDER BY {_DRAW.format("concat_ws('-', 7, 'sample', o_orderkey)")}, o_orderkey LIMIT 100""")
def _(read):
    return sampling.exact_subsample(read("orders"), 100, 7, ["o_orderkey"], "md5")


@query("kfold_assign", "o_orderkey fold", f"""SELECT o_orderkey, ((row_number() OVER (ORDER BY {_DRAW.format("concat_ws('-', 7, 'fold', o_orderkey)")}, o_orderkey) - 1) % 5)::INT AS fold FROM orders""")
def _(read):
    return sampling.kfold(read("orders"), 5, 7, ["o_orderkey"], "md5")


@query("repeated_split", "split n ~mean_price", f"""
    SELECT split::INT AS split, count(*) AS n, avg(o_totalprice) AS mean_price FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_DRAW.format("concat_ws('-', 7, 'split', split, o_orderkey)")}, o_orderkey) AS k FROM orders, (SELECT unnest(range(3)) AS split))
    WHERE k <= floor((SELECT count(*) FROM orders) * 0.8::DOUBLE) GROUP BY split""")
def _(read):
    return sampling.repeated_split(read("orders"), 3, 0.8, 7, ["o_orderkey"], "md5").groupBy("split").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))


@query("stratified_split", "target n n_test", f"""
    SELECT target, count(*) AS n, count(*) FILTER (k <= floor(c * 0.3::DOUBLE)) AS n_test FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY {_DRAW.format("concat_ws('-', 7, 'strata', o_orderkey)")}, o_orderkey) AS k, count(*) OVER (PARTITION BY target) AS c FROM ({ORDERS_SQL})) GROUP BY target""")
def _(read):
    s = sampling.stratified_split(orders(read), "target", 0.3, 7, ["o_orderkey"], "md5")
    return s.groupBy("target").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


@query("positional_split", "is_train n last_key", """
    SELECT is_train, count(*) AS n, max(o_orderkey) AS last_key FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8::DOUBLE) AS is_train FROM orders) GROUP BY is_train""")
def _(read):
    s = sampling.positional_split(read("orders"), 0.8, ["o_orderkey"], buckets=8)
    return s.groupBy("is_train").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query("feature_permutation", "permutation n ~total ~rho", f"""
    WITH b AS (SELECT row_id, c_acctbal, c_nationkey FROM ({_NUMBERED})), d AS (SELECT p AS permutation, c_acctbal, row_number() OVER (PARTITION BY p ORDER BY {_DRAW.format("concat_ws('-', 3, 'perm', p, row_id)")}, row_id) - 1 AS row_id FROM b, (SELECT unnest([1, 2]) AS p))
    SELECT permutation::INT AS permutation, count(*) AS n, sum(d.c_acctbal) AS total, corr(d.c_acctbal, b.c_nationkey) AS rho FROM d JOIN b USING (row_id) GROUP BY permutation""")
def _(read):
    p = sampling.permuted(_numbered(read).select("row_id", "c_acctbal", "c_nationkey"), "c_acctbal", 2, 3, backend="md5")
    return p.groupBy("permutation").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.corr("c_acctbal", F.col("c_nationkey").cast("double")).alias("rho"))


# -- metrics ---------------------------------------------------------------------------------------

_C = "SELECT c_acctbal AS x, (c_mktsegment = 'BUILDING')::INT AS y FROM customer"
_REF = f"""SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, stddev_samp(x) AS sd,
    1.06 * CASE WHEN least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) > 0 THEN least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END * pow(count(*), -0.2::DOUBLE) AS h,
    CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS scale FROM ({_C})"""
_GRID = "SELECT unnest(range(200)) AS g"
_KDE0 = f"SELECT g, s / sum(s) OVER () AS p0 FROM (SELECT g, sum(exp(-0.5 * pow((lo + (hi - lo) * (g / 199.0::DOUBLE) - x) / h, 2))) AS s FROM ({_C}), ({_REF}), ({_GRID}) GROUP BY g)"
_KDE = f"""SELECT pool, r, g, s / sum(s) OVER (PARTITION BY pool, r) AS p FROM (SELECT pool, r, g, sum(cnt * exp(-0.5 * pow((lo + (hi - lo) * (g / 199.0::DOUBLE) - x) / h, 2))) AS s FROM ({_SAMPLES}), ({_REF}), ({_GRID}) GROUP BY ALL)"""
_DIST = f"""SELECT pool, r, sum(gap) FILTER (g < 199) * any_value((hi - lo) / 199.0::DOUBLE / scale) AS wasserstein, sqrt(greatest(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2, 0)) AS js
    FROM (SELECT *, abs(sum(p - p0) OVER (PARTITION BY pool, r ORDER BY g)) AS gap, greatest(p0, 1e-10) / sum(greatest(p0, 1e-10)) OVER (PARTITION BY pool, r) AS a, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER (PARTITION BY pool, r) AS b FROM ({_KDE}) JOIN ({_KDE0}) USING (g)), ({_REF}) GROUP BY pool, r"""
_VALUES = f"""SELECT *, coalesce(sum(c) OVER (PARTITION BY pool, r ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(c) OVER (PARTITION BY pool, r) AS m, sum(e) OVER (PARTITION BY pool, r) AS ev
    FROM (SELECT pool, r, x, sum(cnt) AS c, sum(cnt * y) AS e FROM ({_SAMPLES}) GROUP BY ALL)"""
_F0 = f"SELECT x, (sum(c) OVER (ORDER BY x) - c) / (sum(c) OVER ())::DOUBLE AS f_below, sum(c) OVER (ORDER BY x) / (sum(c) OVER ())::DOUBLE AS f_upto FROM (SELECT x, count(*) AS c FROM ({_C}) GROUP BY x)"
_RANKS = f"""SELECT pool, r, max(greatest(abs(f_upto - (below + c) / m), abs(f_below - below / m))) AS ks,
    abs((sum(rk * e) / any_value(m)) / sqrt((sum(c * rk * rk) / any_value(m)) * (any_value(ev) / any_value(m)) * (1 - any_value(ev) / any_value(m)))) AS spearman
    FROM (SELECT *, below + (c + 1) / 2 - (m + 1) / 2 AS rk FROM (SELECT pool, r, x, c::DOUBLE AS c, e::DOUBLE AS e, below::DOUBLE AS below, m::DOUBLE AS m, ev::DOUBLE AS ev FROM ({_VALUES})) JOIN ({_F0}) USING (x)) GROUP BY pool, r"""
_EXPANDED = f"SELECT pool, r, x, y FROM ({_SAMPLES}), LATERAL (SELECT unnest(range(cnt::BIGINT)) AS k)"


def woe_sql(rows: str, by: str, n_bins: int = 5) -> str:
    """Rows (by, bin, n_bins, woe, iv_part) of rows (by, x, y)."""
    shares = ", ".join(str(i / n_bins) for i in range(n_bins + 1))
    return f"""WITH t AS ({rows}), q AS (SELECT {by}, list_sort(list_distinct(quantile_cont(x, [{shares}]))) AS edges FROM t GROUP BY {by}),
    b AS (SELECT {by}, len(list_filter(edges[2:-2], lambda c: c <= x)) AS bin, len(edges) - 1 AS n_bins, y FROM t JOIN q USING ({by}) WHERE len(edges) >= 3),
    a AS (SELECT {by}, n_bins, unnest(range(n_bins)) AS bin FROM (SELECT {by}, any_value(n_bins) AS n_bins FROM b GROUP BY {by})),
    k AS (SELECT {by}, a.bin, any_value(a.n_bins) AS n_bins, coalesce(sum(y), 0)::DOUBLE AS e, coalesce(sum(1 - y), 0)::DOUBLE AS o FROM a LEFT JOIN b USING ({by}, bin) GROUP BY {by}, a.bin),
    d AS (SELECT {by}, bin, n_bins, (e + 0.5) / (sum(e) OVER w + 0.5 * n_bins) AS de, (o + 0.5) / (sum(o) OVER w + 0.5 * n_bins) AS dn FROM k WINDOW w AS (PARTITION BY {by}))
    SELECT {by}, bin, n_bins, ln(de / dn) AS woe, (de - dn) * ln(de / dn) AS iv_part FROM d"""


def iv_sql(woes: str, by: str) -> str:
    return f"""SELECT {by}, sum(iv_part) AS iv, CASE WHEN count(*) > 2 THEN CASE WHEN var_pop(rk) > 0 THEN abs(corr(bin, rk)) ELSE 0 END WHEN count(*) = 2 THEN (min(woe) <> max(woe))::INT ELSE 1 END AS monotonicity
    FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY woe) + (count(*) OVER (PARTITION BY {by}, woe) - 1) / 2.0 AS rk FROM ({woes})) GROUP BY {by}"""


_METRICS = f"""SELECT * FROM ({_DIST}) JOIN ({_RANKS}) USING (pool, r) JOIN ({iv_sql(woe_sql(_EXPANDED, "pool, r"), "pool, r")}) USING (pool, r)"""
_LONG_METRICS = " UNION ALL ".join(f"SELECT pool, r, '{m}' AS metric, {'1 - ' if m == 'monotonicity' else ''}{m} AS value FROM m" for m in curves.METRICS)
_SIZES = f"SELECT pool, pool_size FROM ({_POOLS})"
_CURVES = f"""SELECT metric, pool_size, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS stderr, count(*) AS n_values FROM (WITH m AS ({_METRICS}) {_LONG_METRICS}) JOIN ({_SIZES}) USING (pool) GROUP BY metric, pool_size"""
_FITS = f"""SELECT metric, k, floor, r2, r2 IS NULL OR r2 < 0.7 OR k * (pow(lo + (hi - lo) / 49, -0.5::DOUBLE) - pow(lo, -0.5::DOUBLE)) > 1e-10 AS anomalous
    FROM (SELECT metric, regr_slope(mean, z) AS k, regr_intercept(mean, z) AS floor, CASE WHEN var_pop(mean) > 0 THEN regr_r2(mean, z) END AS r2, min(pool_size)::DOUBLE AS lo, max(pool_size)::DOUBLE AS hi FROM (SELECT *, pow(pool_size, -0.5::DOUBLE) AS z FROM ({_CURVES})) GROUP BY metric)"""


def _metrics(read):
    full, cuts = _full(read), _cuts(read)
    ref = marginal.reference(marginal.value_table(full, ["feature"], cuts, ["feature"]), ["feature"]).persist()
    density = marginal.densities(full, ["feature"], ref, ["feature"])
    samples = Written(ref.sparkSession)(_samples(read))
    got, _ = marginal.continuous_metrics(samples, ["feature", "pool", "draw_no", "pool_size", "r"], ref, density, True, cuts=cuts)
    return got


def _points(read):
    """A row for each metric and pool, written: fits use it several times, and each would measure all resamples again."""
    points = curves.aggregate(curves.instability_long(_metrics(read), ["pool", "pool_size", "r"]), ["pool", "pool_size"])
    return Written(points.sparkSession)(points)


@query("reference_statistics", "n ~low ~high ~q25 ~q50 ~q75 ~sd ~bandwidth ~scale", f"SELECT n, lo AS low, hi AS high, q25, q50, q75, sd, h AS bandwidth, scale FROM ({_REF})")
def _(read):
    return marginal.reference(marginal.value_table(_full(read), ["feature"], _cuts(read), ["feature"]), ["feature"])


@query("kde_grid", "g ~p0", f"SELECT g::INT AS g, p0 FROM ({_KDE0})")
def _(read):
    full = _full(read)
    ref = marginal.reference(marginal.value_table(full, ["feature"], _cuts(read), ["feature"]), ["feature"])
    return marginal.densities(full, ["feature"], ref, ["feature"]).withColumnRenamed("p", "p0")


@query("resample_metrics", "pool r ~wasserstein ~js ~ks ~spearman ~iv ~monotonicity", f"SELECT pool::INT AS pool, r::INT AS r, wasserstein, js, ks, spearman, iv, monotonicity FROM ({_METRICS})")
def _(read):
    return _metrics(read)


@query("learning_curve", "metric pool_size ~mean ~stderr n_values", f"SELECT metric, pool_size::BIGINT AS pool_size, mean, stderr, n_values FROM ({_CURVES})")
def _(read):
    return _points(read)


@query("learning_curve_fit", "metric ~k ~floor ~r2 anomalous", _FITS)
def _(read):
    return curves.fit(_points(read), [])


@query("alpha_grid_fit", "metric ~k ~floor ~alpha ~r2 anomalous fit_failed")
def _(read):
    return curves.fit(_points(read), [], estimate_alpha=True)


@query("complexity_score", "~overall ~target_agnostic ~target_dependent", f"""
    WITH w AS (SELECT * FROM (VALUES ('wasserstein', 0.45, 0), ('ks', 0.30, 0), ('js', 0.25, 0), ('spearman', 0.40, 1), ('monotonicity', 0.30, 1), ('iv', 0.30, 1)) AS t(metric, weight, kind)), f AS (SELECT * FROM ({_FITS}) JOIN w USING (metric) WHERE NOT anomalous)
    SELECT sum(weight * floor) / sum(weight) AS overall, sum(weight * floor) FILTER (kind = 0) / sum(weight) FILTER (kind = 0) AS target_agnostic, sum(weight * floor) FILTER (kind = 1) / sum(weight) FILTER (kind = 1) AS target_dependent FROM f""")
def _(read):
    return curves.scores(curves.fit(_points(read), []).withColumn("all", F.lit(0)), ["all"])


@query("woe_profile_stability", "bin ~mean ~sd ~flip_rate status", f"""
    WITH p AS (SELECT * FROM ({woe_sql(_EXPANDED, "pool, r")})), m AS (SELECT bin, median(woe) AS mid FROM p GROUP BY bin),
    s AS (SELECT bin, avg(woe) AS mean, stddev_samp(woe) AS sd, avg((sign(woe) <> sign(mid))::INT) AS flip_rate FROM p JOIN m USING (bin) GROUP BY bin)
    SELECT bin::INT AS bin, mean, sd, flip_rate, CASE WHEN sd < 0.15 AND flip_rate < 0.10 THEN 'stable' WHEN flip_rate > 0.30 THEN 'unstable' ELSE 'noisy' END AS status FROM s""")
def _(read):
    return curves.woe_stability(_metrics(read), [])


@query("percentile_stability", "pool ~p10 ~p25 ~p50 ~p75 ~p90", f"""
    SELECT pool::INT AS pool, quantile_cont(c_acctbal, 0.1) AS p10, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.75) AS p75, quantile_cont(c_acctbal, 0.9) AS p90 FROM ({_POOLED}) GROUP BY pool""")
def _(read):
    rows = _pooled(read).select(F.lit("c_acctbal").alias("feature"), "pool", F.col("c_acctbal").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("cnt"))
    values = marginal.value_table(rows, ["feature", "pool"], _cuts(read), ["feature"])
    q = marginal.order_quantiles(values, ["pool"], (0.1, 0.25, 0.5, 0.75, 0.9))
    return q.select("pool", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))


@query("degenerate_rate", "pool ~degenerate_rate high", f"""
    SELECT pool::INT AS pool, avg(d) AS degenerate_rate, avg(d) > 0.5 AS high FROM (SELECT pool, r, (count(DISTINCT x) < 2 OR sum(cnt * y) = 0 OR sum(cnt * y) = sum(cnt))::INT AS d FROM ({_SAMPLES}) GROUP BY ALL) GROUP BY pool""")
def _(read):
    by = ["feature", "pool", "r"]
    values = marginal.value_table(_samples(read), by, _cuts(read), ["feature"], ["f0_below", "f0_upto"])
    return curves.degenerate_rates(marginal.rank_statistics(values, by), ["pool"])


@query("ks_two_sample", "~ks n_a n_b", """
    WITH v AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT c_acctbal AS x, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier) GROUP BY x)
    SELECT max(abs(ca / ta - cb / tb)) AS ks, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b FROM (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v)""")
def _(read):
    return marginal.ks_two_sample(read("customer").select(F.col("c_acctbal").alias("v")), read("supplier").select(F.col("s_acctbal").alias("v")), [], "v")


@query("wasserstein_by_nation", "nation ~wasserstein", """
    WITH v AS (SELECT nation, x, sum(a) AS a, sum(b) AS b FROM (SELECT c_nationkey AS nation, c_acctbal AS x, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 0, 1 FROM supplier) GROUP BY ALL),
    c AS (SELECT nation, abs(sum(a) OVER w / sum(a) OVER n - sum(b) OVER w / sum(b) OVER n) * (lead(x) OVER w - x) AS part FROM v WHERE nation IN (SELECT s_nationkey FROM supplier) WINDOW w AS (PARTITION BY nation ORDER BY x), n AS (PARTITION BY nation))
    SELECT nation, coalesce(sum(part), 0) AS wasserstein FROM c GROUP BY nation""")
def _(read):
    a = read("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    b = read("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    return marginal.wasserstein_two_sample(a.join(b.select("nation").distinct(), "nation", "left_semi"), b, ["nation"], "v")


@query("spearman_by_flag", "l_returnflag ~rho n", """
    SELECT l_returnflag, corr(a, b) AS rho, count(*) AS n FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem) GROUP BY l_returnflag""")
def _(read):
    return spearman(read("lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


def _feature_bins(read):
    full = marginal.full_sample(checks.to_long(lines(read), ["l_quantity", "l_extendedprice", "l_discount"], "target"))
    full = Written(full.sparkSession)(full)
    values = marginal.value_table(full, ["feature"], marginal.cuts_of(full, ["feature"]), ["feature"])
    return marginal.binned(full, marginal.order_quantiles(values, ["feature"], [i / 5 for i in range(6)]), ["feature"])


_THREE = long_sql(LINES_SQL, ["l_quantity", "l_extendedprice", "l_discount"])


@query("woe_quantile_bins", "feature bin n_bins ~woe ~iv_part", f"SELECT feature, bin::INT AS bin, n_bins::INT AS n_bins, woe, iv_part FROM ({woe_sql(_THREE, 'feature')})")
def _(read):
    return marginal.woe(_feature_bins(read), ["feature"])


@query("information_value", "feature ~iv ~monotonicity", iv_sql(woe_sql(_THREE, "feature"), "feature"))
def _(read):
    return marginal.information_value(marginal.woe(_feature_bins(read), ["feature"]), ["feature"])


_TYPES = "SELECT p_brand, dense_rank() OVER (ORDER BY p_type) AS x, (p_size > 25)::INT AS y FROM part"


def _types(read):
    codes = read("part").select("p_type").distinct()
    codes = codes.withColumn("x", F.dense_rank().over(Window.orderBy("p_type")))  # a row for each type
    return read("part").join(F.broadcast(codes), "p_type").select("p_brand", "x", (F.col("p_size") > 25).cast("int").alias("y"), F.lit(1).alias("cnt"))


@query("category_distances", "p_brand ~tv ~js", f"""
    WITH t AS ({_TYPES}), q AS (SELECT x, count(*) AS c0 FROM t GROUP BY x), b AS (SELECT DISTINCT p_brand FROM t), p AS (SELECT p_brand, x, count(*) AS c FROM t GROUP BY ALL),
    j AS (SELECT b.p_brand, coalesce(c, 0) / sum(coalesce(c, 0)) OVER w AS p, c0 / sum(c0) OVER w AS p0 FROM b CROSS JOIN q LEFT JOIN p ON p.p_brand = b.p_brand AND p.x = q.x WINDOW w AS (PARTITION BY b.p_brand)),
    k AS (SELECT p_brand, abs(p - p0) AS gap, greatest(p0, 1e-10) / sum(greatest(p0, 1e-10)) OVER w AS a, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER w AS b FROM j WINDOW w AS (PARTITION BY p_brand))
    SELECT p_brand, sum(gap) / 2 AS tv, sqrt(greatest(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2, 0)) AS js FROM k GROUP BY p_brand""")
def _(read):
    t = _types(read)
    return marginal.category_distances(t, t.select("x", "cnt"), ["p_brand"], [])


@query("category_iv", "~iv n_bins", f"""
    WITH t AS ({_TYPES}), k AS (SELECT x, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS o FROM t GROUP BY x), d AS (SELECT (e + 0.5) / (sum(e) OVER () + 0.5 * count(*) OVER ()) AS de, (o + 0.5) / (sum(o) OVER () + 0.5 * count(*) OVER ()) AS dn FROM k)
    SELECT sum((de - dn) * ln(de / dn)) AS iv, count(*) AS n_bins FROM d""")
def _(read):
    bins = marginal.by_value(_types(read).withColumn("all", F.lit(0)), ["all"])
    return marginal.woe(bins, ["all"]).groupBy("all").agg(F.sum("iv_part").alias("iv"), F.count("*").alias("n_bins"))


# -- a later sample against a fitted reference ---------------------------------------------

_DEV, _LATER = "l_shipdate < TIMESTAMP '1999-01-01'", "l_shipdate >= TIMESTAMP '1999-01-01'"
_SHIFTED = ["l_quantity", "l_extendedprice", "l_discount"]


def _later_sql() -> str:
    """Metrics of the later lines against the earlier ones; l_discount has few enough values for shares if there are ten at most."""
    dev, new = (long_sql(f"{LINES_SQL} WHERE {when}", _SHIFTED) for when in (_DEV, _LATER))
    return f"""
    WITH a AS MATERIALIZED ({dev}), b AS MATERIALIZED ({new}),
    q AS (SELECT feature, count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS sd FROM a GROUP BY feature),
    s AS (SELECT *, CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd ELSE 1 END AS w FROM q),
    ref AS (SELECT feature, lo, hi, 1.06 * w * pow(n, -0.2::DOUBLE) AS h, CASE WHEN iqr > 0 THEN iqr WHEN hi > lo THEN hi - lo ELSE 1 END AS scale FROM s),
    k AS (SELECT feature, g, sum(c * exp(-0.5 * pow((lo + (hi - lo) * (g / 199.0::DOUBLE) - x) / h, 2))) AS s0, sum(d * exp(-0.5 * pow((lo + (hi - lo) * (g / 199.0::DOUBLE) - x) / h, 2))) AS s1
          FROM (SELECT feature, x, sum(c) AS c, sum(d) AS d FROM (SELECT feature, x, 1 AS c, 0 AS d FROM a UNION ALL SELECT feature, x, 0, 1 FROM b) GROUP BY ALL) JOIN ref USING (feature), (SELECT unnest(range(200)) AS g) GROUP BY feature, g),
    p AS (SELECT feature, g, s0 / sum(s0) OVER w AS p0, s1 / sum(s1) OVER w AS p FROM k WINDOW w AS (PARTITION BY feature)),
    d AS (SELECT feature, sum(gap) FILTER (g < 199) AS gap, sqrt(greatest(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2, 0)) AS js
          FROM (SELECT *, abs(sum(p - p0) OVER (PARTITION BY feature ORDER BY g)) AS gap, greatest(p0, 1e-10) / sum(greatest(p0, 1e-10)) OVER (PARTITION BY feature) AS a, greatest(p, 1e-10) / sum(greatest(p, 1e-10)) OVER (PARTITION BY feature) AS b FROM p) GROUP BY feature),
    v AS (SELECT feature, x, sum(c) AS c, sum(d) AS d FROM (SELECT feature, x, 1 AS c, 0 AS d FROM a UNION ALL SELECT feature, x, 0, 1 FROM b) GROUP BY ALL),
    f AS (SELECT feature, max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT feature, sum(c) OVER (PARTITION BY feature ORDER BY x) AS ca, sum(d) OVER (PARTITION BY feature ORDER BY x) AS cb, sum(c) OVER (PARTITION BY feature) AS ta, sum(d) OVER (PARTITION BY feature) AS tb FROM v) GROUP BY feature),
    r AS (SELECT feature, abs(corr(rk, y)) AS spearman FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM b) GROUP BY feature),
    m AS (SELECT feature, gap * (hi - lo) / 199 / scale AS wasserstein, ks, js, spearman, iv, monotonicity FROM ref JOIN d USING (feature) JOIN f USING (feature) JOIN r USING (feature) JOIN ({iv_sql(woe_sql("SELECT * FROM b", "feature"), "feature")}) USING (feature))
    SELECT *, (0.45 * wasserstein + 0.3 * ks + 0.25 * js + 0.4 * spearman + 0.3 * abs(iv)) / 1.7 AS composite FROM m"""


@query("out_of_sample", "feature ~wasserstein ~ks ~js ~spearman ~iv ~monotonicity ~composite", _later_sql())
def _(read):
    rows = lines(read)
    reference = out_of_sample.Reference.fit(rows.filter(_DEV), _SHIFTED, "target")
    return out_of_sample.composite(reference.apply(rows.filter(_LATER), _SHIFTED, "target", by_category=False))


@query("out_of_sample_shares", "feature kind ~tv ~js", """
    WITH v AS (SELECT l_tax AS x, count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS c, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS d FROM lineitem GROUP BY l_tax),
    p AS (SELECT greatest(c / sum(c) OVER (), 1e-10) AS a, greatest(d / sum(d) OVER (), 1e-10) AS b, abs(c / sum(c) OVER () - d / sum(d) OVER ()) AS gap FROM v)
    SELECT 'l_tax' AS feature, 'categorical' AS kind, sum(gap) / 2 AS tv, sqrt(greatest(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2, 0)) AS js FROM p""")
def _(read):
    rows = lines(read)
    reference = out_of_sample.Reference.fit(rows.filter(_DEV), ["l_tax"])
    return reference.apply(rows.filter(_LATER), ["l_tax"]).withColumnRenamed("wasserstein", "tv")


@query("panel_summary", "feature n_obs ~event_rate feature_type imbalance_flag censoring_flag ~complexity_score ~wasserstein_floor ~ks_floor ~js_floor ~spearman_floor ~iv_floor ~monotonicity_floor ~wasserstein_r2")
def panel_summary(read):
    analyzer = StabilityAnalyzer(n_resamples=6, n_points=6)
    return analyzer.fit_panel(lines(read), "target", ["l_quantity", "l_discount"], LINE_KEY).summary


@query("panel_with_categories", "feature feature_type distributional_metric ~complexity_score")
def _(read):
    analyzer = StabilityAnalyzer(n_resamples=4, n_points=5, support_categorical=True)
    return analyzer.fit_panel(orders(read).join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")), "target", ["o_totalprice", "c_nationkey"], ["o_orderkey"]).summary
