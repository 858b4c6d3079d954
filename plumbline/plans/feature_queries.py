"""Feature arithmetic, periods and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.functions.numeric import at_least, clip, safe_div
from plumbline.operators import inference, loan_features, marginal, synthetic
from plumbline.operators.analyzer import StabilityAnalyzer
from plumbline.plans.registry import query
from plumbline.plans.tables import DRAW_SQL, LINE_KEY, LINES_SQL, lines


@query("safe_division", "l_orderkey l_linenumber l_partkey ~per_unit ~filled ~clipped", """
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_extendedprice / nullif(l_discount, 0), 0) AS per_unit, l_tax / greatest(l_quantity - 25, 1) AS filled, least(greatest(l_quantity, 10), 40) AS clipped FROM lineitem""")
def _(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", safe_div("l_extendedprice", "l_discount").alias("per_unit"), safe_div("l_tax", at_least(F.col("l_quantity") - 25, 1)).alias("filled"), clip("l_quantity", 10, 40).alias("clipped"))


#: orders and lines as loans: raw columns that the engineered features need, nulls among them.
_LOANS_SQL = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Charged Off' WHEN 'O' THEN 'Fully Paid' ELSE 'Current' END AS loan_status, o_totalprice AS loan_amnt,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_totalprice / 3 END AS annual_inc, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 11 END AS inq_last_6mths, o_custkey % 13 AS inq_last_12m,
    (o_custkey % 90)::VARCHAR || '%' AS revol_util, CASE o_custkey % 4 WHEN 0 THEN '10+ years' WHEN 1 THEN '< 1 year' WHEN 2 THEN '3 years' END AS emp_length, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 40 END AS dti FROM orders"""


def _loans(read):
    o, k = read("orders"), F.col("o_custkey")
    loans = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "Charged Off").when(F.col("o_orderstatus") == "O", "Fully Paid").otherwise("Current").alias("loan_status"), F.col("o_totalprice").alias("loan_amnt"),
        F.when(k % 5 != 0, F.col("o_totalprice") / 3).alias("annual_inc"), F.when(k % 3 != 0, k % 11).alias("inq_last_6mths"), (k % 13).alias("inq_last_12m"), F.concat((k % 90).cast("string"), F.lit("%")).alias("revol_util"),
        F.when(k % 4 == 0, "10+ years").when(k % 4 == 1, "< 1 year").when(k % 4 == 2, "3 years").alias("emp_length"), F.when(k % 7 != 0, k % 40).alias("dti"),
    )
    raw = {c for own in loan_features.FILLED.values() for c, _ in own.values()} | {c for own in loan_features.RATIOS.values() for pair in own.values() for c in pair}
    raw |= {"installment", "fico_range_low", "fico_range_high", "total_rev_hi_lim", "tot_hi_cred_lim", "num_actv_rev_tl", *loan_features.MEDIAN_FILLED}
    return loans.withColumns({c: F.lit(None).cast("double") for c in raw if c not in loans.columns})


@query("loan_features", "id charged_off ~inq_last_6m ~inq_acceleration ~revol_util ~loan_to_income ~emp_length_yrs ~fico_mid ~dti ~clean_payment_track ~mths_since_last_delinq", f"""
    WITH l AS ({_LOANS_SQL}), f AS (SELECT * FROM l WHERE loan_status <> 'Current'), m AS (SELECT median(dti) AS med FROM f)
    SELECT id, (loan_status = 'Charged Off')::INT AS charged_off, coalesce(inq_last_6mths, 0) AS inq_last_6m, coalesce(inq_last_6mths, 0) / greatest(inq_last_12m, 1) AS inq_acceleration, replace(revol_util, '%', '')::DOUBLE AS revol_util,
      coalesce(loan_amnt / CASE WHEN annual_inc IS NOT NULL THEN greatest(annual_inc, 1) END, 0) AS loan_to_income, CASE emp_length WHEN '10+ years' THEN 10 WHEN '< 1 year' THEN 0 WHEN '3 years' THEN 3 END AS emp_length_yrs,
      662 AS fico_mid, coalesce(dti, med) AS dti, 1 AS clean_payment_track, 999 AS mths_since_last_delinq FROM f, m""")
def _(read):
    rows = loan_features.with_target(_loans(read))
    features = {n: e for own in loan_features.expressions(loan_features.medians(rows)).values() for n, e in own.items()}
    return rows.select("id", F.col("default").alias("charged_off"), *(e.alias(n) for n, e in features.items()))


@query("temporal_split", "period n ~mean_price", """
    SELECT period, count(*) AS n, avg(o_totalprice) AS mean_price FROM (SELECT *, CASE WHEN o_orderdate <= TIMESTAMP '1997-12-31' THEN 'dev' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'holdout' END AS period FROM orders) WHERE period IS NOT NULL GROUP BY period""")
def _(read):
    return loan_features.by_month(read("orders"), "1997-12-31", "1999-01-01", "o_orderdate").groupBy("period").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))


# -- known instability in given tables ------------------------------------------------------

_CLEAN, _CORRUPTED = ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]
_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KINDS = [k.value for k in synthetic.InstabilityType]


def _u(purpose: str, feature: str, keys: list[str]) -> str:
    key = ", ".join(f"'{k}'" if k in (purpose, feature, "42") else k for k in ("42", purpose, feature, *keys))
    return f"({DRAW_SQL.format(f'concat_ws(chr(45), {key})')} / {float(1 << 52)!r}::DOUBLE)"


def _injected_sql(kind: str) -> str:
    """Rows (y, and each feature) of the lines with one kind of instability."""
    names, design = [*_CLEAN, *_CORRUPTED], synthetic.Design()
    facts = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in names)
    scores = ", ".join(f"abs({n} - m_{n}) / s_{n} AS z_{n}" for n in names)
    draws = ", ".join(f"{_u(p, f, _ROW)} AS {p}_{f}" for f in _CORRUPTED for p in ("pick", "size", "gone"))
    most = ", ".join([f"max(z_{n}) AS all_{n}" for n in names] + [f"max(z_{f}) FILTER (pick_{f} >= {design.influential}) AS left_{f}" for f in _CORRUPTED])
    columns = list(_CLEAN)
    for f in _CORRUPTED:
        scale = {"distribution_shift": str(design.shift_magnitude)}.get(kind, str(design.noise_scale))
        if kind == "interaction":
            partner = synthetic.partner_of(names, f, 42)
            scale = f"(0.5 + z_{partner} / (all_{partner} + 1e-8)) * {design.interaction_strength}"
        value = f"CASE WHEN pick_{f} < {design.influential} THEN m_{f} + (2.0::DOUBLE * target - 1) * (4 + 4 * size_{f}) * {scale} * s_{f} ELSE {f} END"
        if kind == "mnar":
            value = f"CASE WHEN NOT (pick_{f} >= {design.influential} AND gone_{f} < z_{f} / left_{f} * {design.missing_fraction}) THEN {value} END"
        columns.append(f"{value} AS {f}")
    return f"""(WITH l AS ({LINES_SQL}), f AS (SELECT {facts} FROM l), d AS (SELECT l.*, f.*, {scores}, {draws} FROM l, f), t AS (SELECT {most} FROM d)
        SELECT '{kind}' AS kind, target AS y, {', '.join(columns)}, {', '.join(f'pick_{f} < {design.influential} AS in_{f}' for f in _CORRUPTED)} FROM d, t)"""


_GAPS = "WITH r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {_injected_sql(k)}" for k in _KINDS) + "), x AS (" + " UNION ALL ".join(
    f"SELECT kind, y, '{n}' AS feature, {n}::DOUBLE AS x, {f'in_{n}' if n in _CORRUPTED else 'false'} AS extreme FROM r" for n in [*_CLEAN, *_CORRUPTED]
) + """), n AS (SELECT kind, feature, count(*) FILTER (extreme) AS n_extreme, count(*) FILTER (x IS NULL) AS n_missing FROM x GROUP BY ALL),
    v AS (SELECT kind, feature, x, sum(y) AS a, sum(1 - y) AS b FROM x WHERE x IS NOT NULL GROUP BY ALL),
    g AS (SELECT kind, feature, max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT kind, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM v WINDOW w AS (PARTITION BY kind, feature ORDER BY x), p AS (PARTITION BY kind, feature)) GROUP BY ALL)
    SELECT kind, feature, feature IN ('l_discount', 'l_tax') AS corrupted, n_extreme, n_missing, ks, ks >= 0.1 AS flagged FROM n JOIN g USING (kind, feature)"""  # fmt: skip


def _detected(read):
    rows = lines(read)
    names = [*_CLEAN, *_CORRUPTED]
    every = synthetic.inject_each(rows, list(_KINDS), _CORRUPTED, names, "target", _ROW, backend="md5")
    values = every.groupBy("kind", "feature", "x").agg(F.count_if(F.col("y") == 1).alias("ca"), F.count_if(F.col("y") == 0).alias("cb"), F.count_if("extreme").alias("extreme"), F.count("*").alias("n"))
    values = Written(rows.sparkSession)(values)
    counts = values.groupBy("kind", "feature").agg(F.sum("extreme").alias("n_extreme"), F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    gaps = marginal.ks_of_counts(values.filter("x is not null"), ["kind", "feature"])
    return counts.join(gaps, ["kind", "feature"]).select("kind", "feature", F.col("feature").isin(_CORRUPTED).alias("corrupted"), "n_extreme", "n_missing", "ks", (F.col("ks") >= 0.1).alias("flagged"))


@query("detect_injected", "kind feature corrupted n_extreme n_missing ~ks flagged", _GAPS)
def _(read):
    return _detected(read)


@query("injected_detection", "kind tp fp fn tn ~tpr ~fpr ~precision ~recall ~f1", f"""
    SELECT *, 2 * precision * tpr / (precision + tpr) AS f1, tpr AS recall FROM (SELECT kind, tp, fp, fn, tn, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tp / (tp + fp) AS precision FROM (
    SELECT kind, count(*) FILTER (corrupted AND flagged) AS tp, count(*) FILTER (NOT corrupted AND flagged) AS fp, count(*) FILTER (corrupted AND NOT flagged) AS fn, count(*) FILTER (NOT corrupted AND NOT flagged) AS tn FROM ({_GAPS}) GROUP BY kind))""")
def _(read):
    return inference.detection(_detected(read), ["kind"])


@query("synthetic_base", "n events ~corrupted_spread", f"""
    WITH c AS (SELECT *, (c_mktsegment = 'BUILDING')::INT AS y FROM customer), f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM c)
    SELECT count(*) AS n, sum(y)::BIGINT AS events, stddev_pop(CASE WHEN {_u('pick', 'c_acctbal', ['c_custkey'])} < 0.2 THEN m + (2.0::DOUBLE * y - 1) * (4 + 4 * {_u('size', 'c_acctbal', ['c_custkey'])}) * 3 * s ELSE c_acctbal END) AS corrupted_spread FROM c, f""")
def _(read):
    table = synthetic.inject_into(_customers(read), "heteroscedastic", ["c_acctbal"], ["c_acctbal"], "target", ["c_custkey"], backend="md5")
    return table.agg(F.count("*").alias("n"), F.sum("target").alias("events"), F.stddev_pop("c_acctbal").alias("corrupted_spread"))


def _customers(read):
    return read("customer").withColumn("target", (F.col("c_mktsegment") == "BUILDING").cast("int"))


@query("meta_bootstrap", "feature ~mean ~std ~ci_lower ~ci_upper n_splits")
def _(read):
    return inference.MetaBootstrap().fit(_customers(read), "target", ["c_acctbal", "c_nationkey"], ["c_custkey"])["report"]


@query("permutation_baseline", "feature ~observed ~p_value ~z_score significant")
def _(read):
    return inference.PermutationBaseline().fit(_customers(read), ["c_acctbal", "c_nationkey"], "target", ["c_custkey"])


@query("poisson_panel", "feature n_obs ~complexity_score")
def _(read):
    return StabilityAnalyzer(n_resamples=4, n_points=5, resample="poisson").fit_panel(lines(read), "target", ["l_quantity"], LINE_KEY).summary
