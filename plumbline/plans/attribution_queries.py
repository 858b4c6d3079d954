"""Attribution metrics, drift, reliability and comparison over the driver's tables."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.operators import attribution, categories, compare, drift, importance, inference, mergeable, models, reliability, sampling, selection
from plumbline.operators.ranking import spearman
from plumbline.plans.registry import query
from plumbline.plans.tables import DRAW_SQL, LINE_KEY, LINES_SQL, PHI_SQL, attributions, lines, orders

# -- attribution metrics ----------------------------------------------------------------------

_IMP = f"SELECT resample, feature, avg(abs(phi)) AS importance FROM ({PHI_SQL}) GROUP BY ALL"
_RANKS = f"SELECT *, floor(rank() OVER (PARTITION BY resample ORDER BY importance DESC) + (count(*) OVER (PARTITION BY resample, importance) - 1) / 2.0) AS rk FROM ({_IMP})"
_REF = f"SELECT feature, phi FROM ({PHI_SQL}) WHERE resample = 0"
_DIRECTION = f"""SELECT feature, avg(s) AS direction_consistency FROM (SELECT sample, feature, avg((sign(phi) = CASE WHEN m < 0 THEN -1 ELSE 1 END)::INT) AS s FROM (SELECT *, avg(phi) OVER (PARTITION BY sample, feature) AS m FROM ({PHI_SQL})) GROUP BY ALL) GROUP BY feature"""
_CV = f"SELECT feature, stddev_samp(importance) / avg(importance) AS magnitude_cv FROM ({_IMP}) GROUP BY feature"
_IQR = f"SELECT feature, (quantile_cont(importance, 0.75) - quantile_cont(importance, 0.25)) / quantile_cont(importance, 0.5) AS magnitude_iqr FROM ({_IMP}) GROUP BY feature"
#: The number of features.
_N = "(SELECT max(len(embedding)) FROM embeddings)"
_STABILITY = f"SELECT feature, least(greatest(1 - sqrt(var_samp(rk) / ({_N} * ({_N} + 1) / 12.0)), 0), 1) AS rank_stability FROM ({_RANKS}) GROUP BY feature"
_W1 = f"""SELECT feature, avg(w) AS wasserstein FROM (SELECT resample, feature, sum(part) AS w FROM (
    SELECT resample, feature, abs(sum(a) OVER o / sum(a) OVER n - sum(b) OVER o / sum(b) OVER n) * (lead(phi) OVER o - phi) AS part FROM (
      SELECT resample, feature, phi, sum(a) AS a, sum(b) AS b FROM (SELECT resample, feature, phi, 1 AS a, 0 AS b FROM ({PHI_SQL}) UNION ALL SELECT r.resample, q.feature, q.phi, 0, 1 FROM ({_REF}) q, (SELECT unnest(range(5))::INT AS resample) r) GROUP BY ALL)
    WINDOW o AS (PARTITION BY resample, feature ORDER BY phi), n AS (PARTITION BY resample, feature)) GROUP BY ALL) GROUP BY feature"""
_JS = f"""WITH phi AS ({PHI_SQL}), q AS ({_REF}), e AS (SELECT resample, feature, least(min(phi), any_value(l)) AS lo, greatest(max(phi), any_value(h)) AS hi FROM phi JOIN (SELECT feature, min(phi) AS l, max(phi) AS h FROM q GROUP BY feature) USING (feature) GROUP BY ALL),
    a AS (SELECT resample, feature, least(floor((phi - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS c FROM phi JOIN e USING (resample, feature) GROUP BY ALL),
    b AS (SELECT resample, feature, least(floor((phi - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS d FROM q JOIN e USING (feature) GROUP BY ALL),
    h AS (SELECT e.resample, e.feature, (coalesce(c, 0) / sum(coalesce(c, 0)) OVER w + 1e-10) / (1 + 50 * 1e-10) AS p, (coalesce(d, 0) / sum(coalesce(d, 0)) OVER w + 1e-10) / (1 + 50 * 1e-10) AS r
          FROM (SELECT resample, feature, unnest(range(50))::INT AS bin FROM e) e LEFT JOIN a USING (resample, feature, bin) LEFT JOIN b USING (resample, feature, bin) WINDOW w AS (PARTITION BY e.resample, e.feature))
    SELECT feature, avg(js) AS js_divergence FROM (SELECT resample, feature, sum(p * ln(p / ((p + r) / 2)) + r * ln(r / ((p + r) / 2))) / 2 AS js FROM h GROUP BY ALL) GROUP BY feature"""


def _reference(read):
    return attributions(read).filter("resample = 0")


@query("kendall_w", "~rank_stability", f"SELECT least(greatest(12 * var_pop(s) * count(*) / (any_value(r) * any_value(r) * (pow(count(*), 3) - count(*))), 0), 1) AS rank_stability FROM (SELECT sum(rk) AS s, count(*) AS r FROM ({_RANKS}) GROUP BY feature)")
def _(read):
    return attribution.rank_agreement(attribution.importances(attributions(read)))


@query("rank_stability", "feature ~rank_stability", _STABILITY)
def _(read):
    return attribution.rank_stability(attribution.importances(attributions(read)))


@query("attribution_wasserstein", "feature ~wasserstein", _W1)
def _(read):
    return attribution.wasserstein(attributions(read), _reference(read))


@query("attribution_js", "feature ~js_divergence", _JS)
def _(read):
    return attribution.js_divergence(attributions(read), _reference(read))


@query("direction_consistency", "feature ~direction_consistency", _DIRECTION)
def _(read):
    return attribution.direction_consistency(attributions(read))


@query("magnitude_cv", "feature ~magnitude_cv", _CV)
def _(read):
    return attribution.magnitude_cv(attribution.importances(attributions(read)))


@query("magnitude_iqr", "feature ~magnitude_iqr", _IQR)
def _(read):
    return attribution.magnitude_iqr(attribution.importances(attributions(read)))


@query("topk_overlap", "~topk_overlap", f"""
    WITH t AS (SELECT resample, feature FROM (SELECT *, row_number() OVER (PARTITION BY resample ORDER BY importance DESC, feature) AS k FROM ({_IMP})) WHERE k <= 3),
    r AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY count(*) DESC, feature) AS k FROM t GROUP BY feature) WHERE k <= 3)
    SELECT avg(b / (o + (SELECT count(*) FROM r) - b)) AS topk_overlap FROM (SELECT resample, count(r.feature) AS b, count(*) AS o FROM t LEFT JOIN r USING (feature) GROUP BY resample)""")
def _(read):
    return attribution.topk_overlap(attribution.importances(attributions(read)), 3)


_FEATURES = f"SELECT * FROM ({_STABILITY}) JOIN ({_W1}) USING (feature) JOIN ({_JS}) USING (feature) JOIN ({_DIRECTION}) USING (feature) JOIN ({_CV}) USING (feature) JOIN ({_IQR}) USING (feature)"


@query("attribution_features", "feature ~rank_stability ~wasserstein ~js_divergence ~direction_consistency ~magnitude_cv ~magnitude_iqr ~complexity_score", f"""
    SELECT *, 0.3 * (1 - rank_stability) + 0.3 * (1 - direction_consistency) + 0.15 * wasserstein + 0.15 * magnitude_cv + 0.1 * js_divergence AS complexity_score FROM ({_FEATURES})""")
def _(read):
    return attribution.feature_complexity(attribution.feature_metrics(attributions(read), _reference(read)))


@query("constant_attributions", "feature constant", f"SELECT feature, stddev_pop(phi) < 1e-10 AS constant FROM ({PHI_SQL}) GROUP BY feature")
def _(read):
    return attribution.constant_features(attributions(read))


@query("linear_attribution", "sample feature ~phi", f"""
    WITH t AS (SELECT o_orderkey, o_totalprice, o_custkey FROM orders)
    SELECT o_orderkey AS sample, 'o_totalprice' AS feature, 0.002 * (o_totalprice - (SELECT avg(o_totalprice) FROM t)) AS phi FROM t UNION ALL SELECT o_orderkey, 'o_custkey', -0.5 * (o_custkey - (SELECT avg(o_custkey) FROM t)) FROM t""")
def _(read):
    return models.linear_attributions(read("orders"), {"o_totalprice": 0.002, "o_custkey": -0.5}, "o_orderkey")


@query("tree_attribution", "feature n ~mean_abs")
def _(read):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = lines(read).withColumn("id", F.monotonically_increasing_id())
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(models.assemble(rows, features, "target"))
    phi = models.tree_attributions(rows, model, features, "id")
    return phi.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs("phi")).alias("mean_abs"))


def _stability(read, **how):
    """Orders explained by a logistic model: per feature the mean and the spread of its metrics over the ladder of pools."""
    factory = lambda: LogisticRegression(maxIter=20)
    got = models.AttributionStability(model_factory=factory, **how).fit(orders(read), ["o_totalprice", "o_custkey"], "target", ["o_orderkey"])
    return got["features"]


_STABLE = "feature ~rank_stability ~wasserstein ~js_divergence ~direction_consistency ~magnitude_cv ~magnitude_iqr ~wasserstein_std ~magnitude_cv_std ~complexity_score"


@query("attribution_stability", _STABLE)
def _(read):
    return _stability(read)


@query("category_attribution", "feature n ~mean_abs ~low ~high", f"""
    WITH l AS ({LINES_SQL}), g AS (SELECT l_shipmonth, avg(target) AS m, count(*) AS n FROM (SELECT *, CASE WHEN month(l_shipdate) <= 6 THEN 'first' ELSE 'second' END AS l_shipmonth FROM l) GROUP BY l_shipmonth), a AS (SELECT avg(target) AS m FROM l)
    SELECT 'half' AS feature, sum(n)::BIGINT AS n, sum(n * abs(g.m - a.m)) / sum(n) AS mean_abs, min(g.m - a.m) AS low, max(g.m - a.m) AS high FROM g, a""")
def _(read):
    rows = lines(read).withColumns({"half": F.when(F.month("l_shipdate") <= 6, "first").otherwise("second"), "id": F.monotonically_increasing_id()})
    model = DecisionTreeRegressor(maxDepth=1, seed=1)
    rows, _, _ = categories.prepare_categorical(model, rows, ["half"], ["half"])
    phi = models.tree_attributions(rows, model.fit(models.assemble(rows, ["half"], "target")), ["half"], "id")
    return phi.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.abs("phi")).alias("mean_abs"), F.min("phi").alias("low"), F.max("phi").alias("high"))


#: Lines that are both discounted and large: a tree needs both features, the rarer one first.
_MARKED = {"discounted": "l_discount > 0.075", "large": "l_quantity > 25"}
_MARKED_SQL = f"SELECT {', '.join(f'({c})::INT AS {n}' for n, c in _MARKED.items())} FROM lineitem"


def _marked_model(read):
    rows = read("lineitem").select(*(F.expr(c).cast("int").alias(n) for n, c in _MARKED.items()), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("target", F.col("discounted") * F.col("large"))
    return rows, DecisionTreeClassifier(maxDepth=2, seed=1).fit(models.assemble(rows, list(_MARKED), "target"))


@query("tree_interactions", "a b n ~total ~strength", f"""
    WITH r AS ({_MARKED_SQL}), s AS (SELECT avg(discounted) AS pa, avg(large) FILTER (discounted = 1) AS pb FROM r),
         i AS (SELECT (discounted - pa) * (large - pb) / 2 AS pair, (discounted - pa) * pb + (discounted - pa) * (large - pb) / 2 AS a, (large - pb) * pa + (discounted - pa) * (large - pb) / 2 AS b FROM r, s),
         p AS (SELECT 'discounted' AS a, 'discounted' AS b, a - pair AS phi FROM i UNION ALL SELECT 'large', 'large', b - pair FROM i UNION ALL SELECT 'discounted', 'large', pair FROM i UNION ALL SELECT 'large', 'discounted', pair FROM i)
    SELECT a, b, count(*) AS n, sum(phi) AS total, avg(abs(phi)) AS strength FROM p GROUP BY a, b""")
def _(read):
    rows, model = _marked_model(read)
    phi = models.tree_interactions(rows, model, list(_MARKED), "id")
    return phi.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("phi").alias("total"), F.avg(F.abs("phi")).alias("strength"))


@query("interaction_strength", "feature ~total_interaction", f"""
    WITH r AS ({_MARKED_SQL}), s AS (SELECT avg(discounted) AS pa, avg(large) FILTER (discounted = 1) AS pb FROM r), t AS (SELECT avg(abs((discounted - pa) * (large - pb) / 2)) AS x FROM r, s)
    SELECT unnest(['discounted', 'large']) AS feature, x AS total_interaction FROM t""")
def _(read):
    rows, model = _marked_model(read)
    return models.total_interaction(models.interaction_strength(rows, model, list(_MARKED)))


# -- drift ----------------------------------------------------------------------------------------

_SIDE = f"SELECT *, row_number() OVER (ORDER BY imp DESC, feature) AS rk FROM (SELECT feature, avg(abs(phi)) AS imp, stddev_pop(abs(phi)) AS imp_sd, avg(phi) AS m, avg((phi > 0)::INT) AS pos FROM ({PHI_SQL}) WHERE resample {{}} 3 GROUP BY feature)"
_TRAIN, _HOLD = _SIDE.format("<"), _SIDE.format(">=")
_DRIFT_W = f"""SELECT feature, coalesce(sum(part), 0) AS wasserstein FROM (SELECT feature, abs(sum(a) OVER o / sum(a) OVER n - sum(b) OVER o / sum(b) OVER n) * (lead(phi) OVER o - phi) AS part
    FROM (SELECT feature, phi, sum((resample < 3)::INT) AS a, sum((resample >= 3)::INT) AS b FROM ({PHI_SQL}) GROUP BY ALL) WINDOW o AS (PARTITION BY feature ORDER BY phi), n AS (PARTITION BY feature)) GROUP BY feature"""
_DRIFT = f"""SELECT feature, t.rk AS rank_train, h.rk AS rank_holdout, t.rk - h.rk AS rank_change, t.imp AS magnitude_train, h.imp AS magnitude_holdout, h.imp / (t.imp + 1e-10) AS magnitude_ratio,
    (t.m < 0) = (h.m < 0) AS direction_consistent, wasserstein, CASE WHEN (t.m < 0) = (h.m < 0) THEN 0 ELSE 0.4 END + 0.3 * least(abs(t.rk - h.rk) / {_N}, 1) + 0.3 * least(abs(h.imp / (t.imp + 1e-10) - 1) / 2, 1) AS drift_score
    FROM ({_TRAIN}) t JOIN ({_HOLD}) h USING (feature) JOIN ({_DRIFT_W}) USING (feature)"""
_OVERALL = f"""SELECT *, least(greatest(0.3 * (1 - greatest(rank_correlation, 0)) + 0.3 * direction_flip_rate + 0.2 * (1 - topk_overlap) + 0.2 * least(magnitude_drift, 1), 0), 1) AS overall_drift_score FROM (
    SELECT corr(rank_train, rank_holdout) AS rank_correlation, avg((NOT direction_consistent)::INT) AS direction_flip_rate, avg(abs(magnitude_holdout - magnitude_train) / (magnitude_train + 1e-10)) AS magnitude_drift,
      count(*) FILTER (rank_train <= 3 AND rank_holdout <= 3) / count(*) FILTER (rank_train <= 3 OR rank_holdout <= 3) AS topk_overlap, count(*) FILTER (drift_score > 0.25) AS n_drifted FROM ({_DRIFT}))"""


def _sides(read):
    phi = attributions(read)
    return phi.filter("resample < 3"), phi.filter("resample >= 3")


@query("attribution_summary", "feature ~importance ~importance_sd ~mean_phi ~share_positive rank", f"SELECT feature, imp AS importance, imp_sd AS importance_sd, m AS mean_phi, pos AS share_positive, rk::INT AS rank FROM ({_TRAIN})")
def _(read):
    return drift.summarise(_sides(read)[0])


@query("feature_drift", "feature rank_train rank_holdout rank_change ~magnitude_train ~magnitude_holdout ~magnitude_ratio direction_consistent ~wasserstein ~drift_score", f"SELECT * REPLACE (rank_train::INT AS rank_train, rank_holdout::INT AS rank_holdout, rank_change::INT AS rank_change) FROM ({_DRIFT})")
def _(read):
    return drift.feature_drift(*_sides(read))


@query("drift_grade", "~rank_correlation ~direction_flip_rate ~magnitude_drift ~topk_overlap n_drifted ~overall_drift_score drift_grade flag_rank_correlation flag_direction_flip_rate", f"""
    SELECT *, CASE WHEN overall_drift_score < 0.1 THEN 'A' WHEN overall_drift_score < 0.25 THEN 'B' WHEN overall_drift_score < 0.4 THEN 'C' WHEN overall_drift_score < 0.6 THEN 'D' ELSE 'F' END AS drift_grade,
      rank_correlation < 0.8 AS flag_rank_correlation, direction_flip_rate > 0.15 AS flag_direction_flip_rate FROM ({_OVERALL})""")
def _(read):
    return drift.overall(drift.feature_drift(*_sides(read)), 3)


# -- reliability -----------------------------------------------------------------------------------

_ROWS = "SELECT p_brand AS feature_name, avg(p_size) / 60 AS complexity_score, avg(p_retailprice) / 2500 AS importance_score, count(*) / 200.0::DOUBLE AS coverage_ratio, stddev_samp(p_size) / 20 AS cross_seed_std FROM part GROUP BY p_brand"
_WEIGHTED = "0.3 * i + 0.4 * s + 0.15 * c + 0.15 * k"


def _rows(read):
    return read("part").groupBy(F.col("p_brand").alias("feature_name")).agg(
        (F.avg("p_size") / 60).alias("complexity_score"), (F.avg("p_retailprice") / 2500).alias("importance_score"), (F.count("*") / 200.0).alias("coverage_ratio"), (F.stddev_samp("p_size") / 20).alias("cross_seed_std"),
    )


def _bounded(c: str, invert: bool) -> str:
    place = f"least(greatest({c}, 0), 1)"
    return f"coalesce({'1 - ' + place if invert else place}, 0.5)"


def _placed(c: str, method: str, invert: bool) -> str:
    if method == "rank":
        place = f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"
    elif method == "zscore":
        z = f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"
        place = f"({z} - (min({c}) OVER () - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) / ((max({c}) OVER () - min({c}) OVER ()) / stddev_samp({c}) OVER ())"
    else:
        place = f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"
    return f"1 - ({place})" if invert else place


def _reliability_sql(place) -> str:
    parts = f"{place('importance_score', False)} AS i, {place('complexity_score', True)} AS s, {place('coverage_ratio', False)} AS c, {place('cross_seed_std', True)} AS k"
    grade = "CASE WHEN v >= 0.8 THEN 'A' WHEN v >= 0.6 THEN 'B' WHEN v >= 0.4 THEN 'C' WHEN v >= 0.2 THEN 'D' ELSE 'F' END"
    return f"SELECT feature_name, s AS stability_component, i AS importance_component, v AS reliability_score, {grade} AS grade FROM (SELECT *, {_WEIGHTED} AS v FROM (SELECT feature_name, {parts} FROM ({_ROWS})))"


_COLUMNS = "feature_name ~stability_component ~importance_component ~reliability_score grade"


@query("reliability_bounded", _COLUMNS, _reliability_sql(_bounded))
def _(read):
    return reliability.ReliabilityScorer().compute_all(_rows(read))


def _register(method: str) -> None:
    @query(f"reliability_{method}", _COLUMNS, _reliability_sql(lambda c, invert: _placed(c, method, invert)))
    def _(read):
        config = reliability.ReliabilityConfig(normalization_method=method)
        return reliability.ReliabilityScorer(config).compute_all(_rows(read), series=True)


for _method in reliability.METHODS:
    _register(_method)


@query("simple_reliability", "feature_name ~score grade", f"""
    SELECT feature_name, s AS score, CASE WHEN s >= 0.1 THEN 'A' WHEN s >= 0.05 THEN 'B' WHEN s >= 0.02 THEN 'C' WHEN s >= 0.01 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT feature_name, importance_score * (1 - least(greatest((complexity_score * 300 + 300) / 500, 0), 1)) AS s FROM ({_ROWS}))""")
def _(read):
    s = _rows(read).withColumn("score", reliability.simple_score(F.col("importance_score"), F.col("complexity_score") * 300))
    return s.withColumn("grade", reliability.grade(F.col("score"), reliability.SIMPLE_GRADES))


# -- comparison ---------------------------------------------------------------------------------------


def _scores(read):
    rows = _rows(read)
    return rows.select(F.col("feature_name").alias("feature"), "complexity_score"), rows.select(F.col("feature_name").alias("feature"), F.col("cross_seed_std").alias("complexity_score"))


_BOTH = f"SELECT feature_name AS feature, complexity_score AS m, cross_seed_std AS s FROM ({_ROWS})"


@query("quadrants", "feature ~marginal_complexity ~shap_complexity quadrant", f"""
    SELECT feature, m AS marginal_complexity, s AS shap_complexity, CASE WHEN m > a AND s > b THEN 'concordant_unstable' WHEN m > a THEN 'false_alarm' WHEN s > b THEN 'missed_risk' ELSE 'concordant_stable' END AS quadrant
    FROM ({_BOTH}), (SELECT median(m) AS a, median(s) AS b FROM ({_BOTH}))""")
def _(read):
    return compare.MarginalVsAttribution().compare(*_scores(read))["comparison"]


@query("quadrant_counts", "quadrant n", f"""
    SELECT quadrant, count(*) AS n FROM (SELECT CASE WHEN m > a AND s > b THEN 'concordant_unstable' WHEN m > a THEN 'false_alarm' WHEN s > b THEN 'missed_risk' ELSE 'concordant_stable' END AS quadrant
      FROM ({_BOTH}), (SELECT median(m) AS a, median(s) AS b FROM ({_BOTH}))) GROUP BY quadrant""")
def _(read):
    return compare.MarginalVsAttribution().compare(*_scores(read))["counts"]


@query("classes", "feature five_way divergence tier conflict band", f"""
    WITH r AS (SELECT *, rank() OVER (ORDER BY m) AS ri, rank() OVER (ORDER BY s) AS rc, count(*) OVER () AS n FROM ({_BOTH}))
    SELECT feature, CASE WHEN m > 0.42 AND NOT s > 0.42 THEN 'FALSE_ALARM' WHEN s > 0.42 AND NOT m > 0.42 THEN 'MISSED_RISK' WHEN m > 0.42 THEN 'CONFIRMED_UNSTABLE' WHEN m - s > 0.3 THEN 'HOLDOUT_DRIFT' ELSE 'STABLE' END AS five_way,
      CASE WHEN m > 0.3 AND s - 0.5 < 0.15 THEN 'FALSE ALARM' WHEN m < 0.15 AND s - 0.5 > 0.25 THEN 'MISSED RISK' WHEN m < 0.15 AND s - 0.5 < 0.15 THEN 'Agree (Stable)' WHEN m > 0.3 AND s - 0.5 > 0.25 THEN 'Agree (Unstable)' ELSE 'Mixed' END AS divergence,
      CASE WHEN m - 0.4 < 0.02 THEN 'stable' WHEN m - 0.4 < 0.05 THEN 'moderate' ELSE 'unstable' END AS tier,
      CASE WHEN ri <= floor(n / 3) AND rc > floor(2 * n / 3) THEN 'important_unstable' WHEN ri > floor(2 * n / 3) AND rc <= floor(n / 3) THEN 'unimportant_stable' ELSE 'none' END AS conflict,
      CASE WHEN m >= 0.9 THEN 'Very strong agreement' WHEN m >= 0.7 THEN 'Strong agreement' WHEN m >= 0.5 THEN 'Moderate agreement' WHEN m >= 0.3 THEN 'Weak agreement' ELSE 'Very weak / no agreement' END AS band FROM r""")
def _(read):
    m, s = F.col("marginal_complexity"), F.col("shap_complexity")
    both = compare.join_scores(*_scores(read))
    both = both.withColumns({"ri": F.rank().over(Window.orderBy(m)), "rc": F.rank().over(Window.orderBy(s)), "n": F.count("*").over(Window.partitionBy())})
    return both.select(
        "feature", compare.five_way(m, s, m - s, high=0.42).alias("five_way"), compare.divergence(m, s - 0.5).alias("divergence"), compare.stability_tier(m - 0.4).alias("tier"),
        compare.rank_conflict(F.col("ri"), F.col("rc"), F.col("n")).alias("conflict"), compare.agreement_band(m).alias("band"),
    )


@query("complexity_rank_correlation", "~rho n", f"""
    SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM ({_BOTH}))""")
def _(read):
    return spearman(compare.join_scores(*_scores(read)), [], "marginal_complexity", "shap_complexity")


@query("complexity_shift", "feature ~dev_complexity ~holdout_complexity ~abs_shift", f"SELECT feature, m AS dev_complexity, s AS holdout_complexity, abs(s - m) AS abs_shift FROM ({_BOTH})")
def _(read):
    return compare.complexity_shift(*_scores(read))


@query("set_overlap", "n_both n_either only_a only_b ~jaccard", """
    WITH a AS (SELECT DISTINCT c_nationkey AS f FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS f FROM supplier)
    SELECT count(*) FILTER (a.f IS NOT NULL AND b.f IS NOT NULL) AS n_both, count(*) AS n_either, count(*) FILTER (b.f IS NULL) AS only_a, count(*) FILTER (a.f IS NULL) AS only_b, count(*) FILTER (a.f IS NOT NULL AND b.f IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.f = b.f""")
def _(read):
    a = read("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("feature")).distinct()
    return compare.set_overlap(a, read("supplier").select(F.col("s_nationkey").alias("feature")).distinct())


@query("master_table", "feature ~complexity_score ~importance ~reliability", f"""
    SELECT feature_name AS feature, complexity_score, CASE WHEN importance_score > 0.55 THEN importance_score END AS importance, CASE WHEN coverage_ratio > 0.3 THEN coverage_ratio END AS reliability FROM ({_ROWS})""")
def _(read):
    rows = _rows(read).withColumnRenamed("feature_name", "feature")
    parts = [rows.filter("importance_score > 0.55").select("feature", F.col("importance_score").alias("importance")), rows.filter("coverage_ratio > 0.3").select("feature", F.col("coverage_ratio").alias("reliability"))]
    return compare.master_table(rows.select("feature", "complexity_score"), parts)


# -- inference and importances ---------------------------------------------------------------------------

_DRAW = "('0x' || substr(md5({}), 1, 13))::BIGINT"


@query("bootstrap_ci_mean", "~point ~low ~high", f"""
    WITH s AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY {_DRAW.format("concat_ws('-', 'row', s_suppkey)")}, s_suppkey) - 1 AS slot FROM supplier), n AS (SELECT count(*) AS n FROM s),
    d AS (SELECT r, {_DRAW.format("concat_ws('-', 42, 'ci', r, i)")} % n AS slot FROM n, (SELECT unnest(range(200)) AS r), LATERAL (SELECT unnest(range(n)) AS i)), v AS (SELECT r, avg(x) AS m FROM d JOIN s USING (slot) GROUP BY r)
    SELECT (SELECT avg(x) FROM s) AS point, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM v""")
def _(read):
    ci = inference.bootstrap_ci(read("supplier"), "s_acctbal", n_boot=200, keys=["s_suppkey"], backend="md5")
    return read("region").sparkSession.createDataFrame([(ci["point_estimate"], ci["ci_lower"], ci["ci_upper"])], "point double, low double, high double")


_ORDER_ROWS = f"SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (ORDER BY {_DRAW.format("concat_ws('-', 'row', o_orderkey)")}, o_orderkey) - 1 AS slot FROM orders"
_ORDER_DRAWS = f"""WITH s AS MATERIALIZED ({_ORDER_ROWS}), n AS (SELECT count(*) AS n FROM s),
    d AS (SELECT r, {_DRAW.format("concat_ws('-', 42, 'ci', r, i)")} % n AS slot FROM n, (SELECT unnest(range(20)) AS r), LATERAL (SELECT unnest(range(n)) AS i)), c AS (SELECT r, slot, count(*) AS cnt FROM d GROUP BY ALL)"""


@query("bootstrap_ratio", "r ~stat", f"{_ORDER_DRAWS} SELECT r::INT AS r, sum(cnt * o_totalprice) / sum(cnt * o_custkey) AS stat FROM c JOIN s USING (slot) GROUP BY r")
def _(read):
    return inference.bootstrap_values(read("orders"), ["o_totalprice", "o_custkey"], mergeable.Ratio(), 20, keys=["o_orderkey"], backend="md5")


@query("bootstrap_trimmed_mean", "r ~stat", f"""{_ORDER_DRAWS}, v AS (SELECT r, o_custkey % 97 AS x, sum(cnt) AS c FROM c JOIN s USING (slot) GROUP BY ALL),
    u AS (SELECT *, sum(c) OVER (PARTITION BY r ORDER BY x) AS upto, sum(c) OVER (PARTITION BY r) AS m FROM v), k AS (SELECT r, x, greatest(least(upto, m * 0.9::DOUBLE) - greatest(upto - c, m * 0.1::DOUBLE), 0) AS w FROM u)
    SELECT r::INT AS r, sum(w * x) / sum(w) AS stat FROM k GROUP BY r""")
def _(read):
    rows = read("orders").withColumn("x", F.col("o_custkey") % 97)
    return inference.bootstrap_values(rows, "x", mergeable.TrimmedMean.of(rows, "x", 0.1), 20, keys=["o_orderkey"], backend="md5")


@query("meta_intervals", "p_brand ~mean ~std ~ci_lower ~ci_upper n_splits", """
    WITH t AS (SELECT * FROM (VALUES (2, 12.706204736174698::DOUBLE), (3, 4.302652729696142), (4, 3.182446305283708), (5, 2.7764451051977987)) AS v(n, t)), s AS (SELECT p_brand, avg(p_size) AS x FROM part WHERE p_type IS NOT NULL GROUP BY p_brand, p_partkey % 4),
    a AS (SELECT p_brand, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM s GROUP BY p_brand)
    SELECT p_brand, m AS mean, coalesce(sd, 0) AS std, m - coalesce(t * sd / sqrt(n), 0) AS ci_lower, m + coalesce(t * sd / sqrt(n), 0) AS ci_upper, n AS n_splits FROM a LEFT JOIN t USING (n)""")
def _(read):
    scores = read("part").groupBy("p_brand", (F.col("p_partkey") % 4).alias("split")).agg(F.avg("p_size").alias("score"))
    return inference.t_intervals(scores, ["p_brand"], "score")


@query("permutation_pvalue", "p_brand ~observed ~null_mean ~null_std ~p_value ~z_score significant", f"""
    WITH b AS (SELECT row_number() OVER (ORDER BY {DRAW_SQL.format("concat_ws('-', 'row', p_partkey)")}, p_partkey) - 1 AS row_id, p_brand, p_size FROM part),
    d AS (SELECT p AS permutation, p_size, row_number() OVER (PARTITION BY p ORDER BY {DRAW_SQL.format("concat_ws('-', 3, 'perm', p, row_id)")}, row_id) - 1 AS row_id FROM b, (SELECT unnest(range(1, 26)) AS p)),
    s AS (SELECT p_brand, permutation, avg(d.p_size) AS score FROM d JOIN (SELECT row_id, p_brand FROM b) USING (row_id) GROUP BY ALL), o AS (SELECT p_brand, avg(p_size) AS observed FROM b GROUP BY p_brand),
    a AS (SELECT p_brand, any_value(observed) AS observed, avg(score) AS m, stddev_samp(score) AS sd, avg((score >= observed)::INT) AS p FROM s JOIN o USING (p_brand) GROUP BY p_brand)
    SELECT p_brand, observed, m AS null_mean, sd AS null_std, p AS p_value, CASE WHEN sd > 0 THEN (observed - m) / sd END AS z_score, p < 0.05 AS significant FROM a""")
def _(read):
    numbered = sampling.number_rows(read("part"), ["p_partkey"], backend="md5").select("row_id", "p_brand", "p_size")
    dealt = sampling.permuted(numbered, "p_size", 25, 3, backend="md5")
    nulls = dealt.groupBy("p_brand", "permutation").agg(F.avg("p_size").alias("score")).select("p_brand", "score")
    return inference.null_summary(nulls, numbered.groupBy("p_brand").agg(F.avg("p_size").alias("observed")), ["p_brand"])


@query("detection_metrics", "p_brand tp fp fn tn ~tpr ~fpr ~precision ~recall ~f1", """
    WITH c AS (SELECT p_brand, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND NOT f) AS tn FROM (SELECT p_brand, p_size > 30 AS t, p_retailprice > 1400 AS f FROM part) GROUP BY p_brand),
    d AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS tpr, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision" FROM c)
    SELECT *, tpr AS recall, coalesce(2 * "precision" * tpr / nullif("precision" + tpr, 0), 0) AS f1 FROM d""")
def _(read):
    flags = read("part").select("p_brand", (F.col("p_size") > 30).alias("corrupted"), (F.col("p_retailprice") > 1400).alias("flagged"))
    return inference.detection(flags, ["p_brand"])


@query("mann_whitney_u", "o_orderpriority ~u n1 n0", """
    SELECT o_orderpriority, sum(rk) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2 AS u, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0
    FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rk FROM orders) GROUP BY o_orderpriority""")
def _(read):
    return inference.mann_whitney(read("orders").withColumn("g", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "g", "o_totalprice")


@query("ranking_metrics", "l_linestatus ~auc ~gini ~ks ~brier", f"""
    WITH t AS (SELECT l_linestatus, target AS y, l_discount * 5 AS s FROM ({LINES_SQL})), c AS (SELECT l_linestatus, s, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY ALL),
    d AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(n) OVER a AS tn, sum(p) OVER a AS tp FROM c WINDOW w AS (PARTITION BY l_linestatus ORDER BY s), a AS (PARTITION BY l_linestatus))
    SELECT l_linestatus, auc, 2 * auc - 1 AS gini, ks, brier FROM (SELECT l_linestatus, sum(p * (cn - n / 2)) / (any_value(tp)::DOUBLE * any_value(tn)) AS auc, max(abs(cp / tp - cn / tn)) AS ks, sum(p * pow(1 - s, 2) + n * pow(s, 2)) / any_value(tp + tn) AS brier FROM d GROUP BY l_linestatus)""")
def _(read):
    return importance.ranking_metrics(lines(read).withColumn("score", F.col("l_discount") * 5), ["l_linestatus"], "target", "score")


@query("vif_two_columns", "name ~vif", """
    SELECT 'l_quantity' AS name, 1 / (1 - regr_r2(l_quantity, l_extendedprice)) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', 1 / (1 - regr_r2(l_quantity, l_extendedprice)) FROM lineitem""")
def _(read):
    got = importance.vif(read("lineitem"), ["l_quantity", "l_extendedprice"])
    return read("region").sparkSession.createDataFrame(got, "name string, vif double")


@query("forward_selection", "place feature")
def _(read):
    """Which columns tell discounted large lines from others, by areas under the curve of five folds."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = read("lineitem").select(*LINE_KEY, *(c for c in columns if c not in LINE_KEY), F.expr(" and ".join(_MARKED.values())).cast("int").alias("target"))
    rows = Written(rows.sparkSession)(sampling.kfold(rows, 5, 42, LINE_KEY))
    chosen = selection.forward_selection(rows, columns, lambda own: selection.fold_auc(rows, own, "target", 5))
    return rows.sparkSession.createDataFrame(list(enumerate(chosen)), "place int, feature string")


@query("attribution_entropy", "resample ~entropy ~max_entropy ~normalized_entropy concentration", f"""
    SELECT *, CASE WHEN normalized_entropy > 0.85 THEN 'distributed' WHEN normalized_entropy > 0.65 THEN 'moderate' ELSE 'concentrated' END AS concentration FROM (SELECT *, entropy / max_entropy AS normalized_entropy FROM (
      SELECT resample, -sum(p * ln(p)) AS entropy, ln(count(*)) AS max_entropy FROM (SELECT resample, importance / sum(importance) OVER (PARTITION BY resample) AS p FROM ({_IMP})) GROUP BY resample))""")
def _(read):
    return importance.entropy(attribution.importances(attributions(read)), ["resample"])


@query("attribution_shape", "feature ~skew ~kurtosis ~bimodality bimodal", f"""
    SELECT feature, skew, kurtosis, (skew * skew + 1) / (kurtosis + 3) AS bimodality, (skew * skew + 1) / (kurtosis + 3) > 0.555 AS bimodal FROM (
      SELECT feature, avg(pow(d, 3)) / pow(avg(d * d), 1.5) AS skew, avg(pow(d, 4)) / pow(avg(d * d), 2) - 3 AS kurtosis FROM (SELECT feature, phi - avg(phi) OVER (PARTITION BY feature) AS d FROM ({PHI_SQL})) GROUP BY feature)""")
def _(read):
    return importance.shape(attributions(read), ["feature"])


@query("attribution_dispersion", "feature ~sd ~mean_abs ~cv", f"SELECT feature, stddev_pop(phi) AS sd, avg(abs(phi)) AS mean_abs, stddev_pop(phi) / avg(abs(phi)) AS cv FROM ({PHI_SQL}) GROUP BY feature")
def _(read):
    return importance.dispersion(attributions(read), ["feature"])


@query("seed_ranks", "feature ~rank_mean ~rank_std rank_range", f"SELECT feature, avg(rk) AS rank_mean, stddev_pop(rk) AS rank_std, (max(rk) - min(rk))::BIGINT AS rank_range FROM ({_RANKS})  GROUP BY feature")
def _(read):
    return importance.seed_ranks(attribution.importances(attributions(read)).withColumnRenamed("resample", "seed"))


@query("rank_correlation_pairs", "a b ~rho n", f"""
    WITH r AS (SELECT rank() OVER (ORDER BY complexity_score) + (count(*) OVER (PARTITION BY complexity_score) - 1) / 2.0 AS c, rank() OVER (ORDER BY importance_score) + (count(*) OVER (PARTITION BY importance_score) - 1) / 2.0 AS i, rank() OVER (ORDER BY coverage_ratio) + (count(*) OVER (PARTITION BY coverage_ratio) - 1) / 2.0 AS v FROM ({_ROWS}))
    SELECT 'complexity_score' AS a, 'importance_score' AS b, corr(c, i) AS rho, count(*) AS n FROM r UNION ALL SELECT 'complexity_score', 'coverage_ratio', corr(c, v), count(*) FROM r UNION ALL SELECT 'importance_score', 'coverage_ratio', corr(i, v), count(*) FROM r""")
def _(read):
    return importance.correlation_pairs(_rows(read), ["complexity_score", "importance_score", "coverage_ratio"])


@query("tree_importances", "feature n_splits ~gain ~coverage depth_min depth_max")
def _(read):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    model = RandomForestClassifier(numTrees=5, maxDepth=3, seed=1).fit(models.assemble(lines(read), features, "target"))
    return importance.tree_importances(read("region").sparkSession, model, features)
