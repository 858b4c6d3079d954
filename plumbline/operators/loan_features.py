"""Engineered loan features as column expressions, by theme; the target, and the split by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import at_least, clean, safe_div
from plumbline.functions.rng import draw
from plumbline.operators import checks
from plumbline.operators.ranking import hash_rank

# -- fixed values: raw columns and their fills ---------------------------------------------
FINAL_STATUSES = ("Fully Paid", "Charged Off")
EVENT_STATUS = "Charged Off"
MEDIAN_FILLED = ("bc_util", "il_util", "all_util", "dti")
#: Features that are a raw column with nulls filled.
FILLED = {
    "velocity": {"inq_last_6m": ("inq_last_6mths", 0), "inq_last_12m": ("inq_last_12m", 0), "mths_since_recent_inq": ("mths_since_recent_inq", 24), "new_rev_12m": ("open_rv_12m", 0), "new_il_12m": ("open_il_12m", 0)},
    "utilisation": {"pct_bc_gt75": ("percent_bc_gt_75", 0)},
    "discipline": {
        "delinq_2yrs": ("delinq_2yrs", 0), "num_tl_30dpd": ("num_tl_30dpd", 0), "num_tl_90g_dpd_24m": ("num_tl_90g_dpd_24m", 0), "num_accts_ever_120pd": ("num_accts_ever_120_pd", 0),
        "pub_rec": ("pub_rec", 0), "pub_rec_bankruptcies": ("pub_rec_bankruptcies", 0), "collections_12m": ("collections_12_mths_ex_med", 0), "mths_since_last_delinq": ("mths_since_last_delinq", 999),
        "mths_since_last_record": ("mths_since_last_record", 999), "mths_since_last_major_derog": ("mths_since_last_major_derog", 999), "pct_tl_nvr_dlq": ("pct_tl_nvr_dlq", 100),
    },
    "lifecycle": {
        "mo_sin_old_il": ("mo_sin_old_il_acct", 0), "mo_sin_old_rev": ("mo_sin_old_rev_tl_op", 0), "mo_sin_rcnt_tl": ("mo_sin_rcnt_tl", 0), "mo_sin_rcnt_rev": ("mo_sin_rcnt_rev_tl_op", 0),
        "mths_since_recent_bc": ("mths_since_recent_bc", 0), "num_il_tl": ("num_il_tl", 0), "num_rev_accts": ("num_rev_accts", 0), "mort_acc": ("mort_acc", 0),
    },
    "capacity": {"avg_cur_bal": ("avg_cur_bal", 0), "tot_coll_amt": ("tot_coll_amt", 0)},
}
#: Ratios: numerator (nulls as 0) by denominator (1 at least).
RATIOS = {
    "velocity": {"acct_expansion_rate_24m": ("acc_open_past_24mths", "total_acc")},
    "utilisation": {"bc_liquidity_buffer": ("bc_open_to_buy", "total_bc_limit"), "revol_bal_concentration": ("revol_bal", "tot_cur_bal"), "il_bal_concentration": ("total_bal_il", "tot_cur_bal")},
    "discipline": {"delinq_intensity": ("delinq_2yrs", "open_acc")},
    "lifecycle": {"bc_active_ratio": ("num_actv_bc_tl", "num_bc_tl"), "acct_churn_24m": ("acc_open_past_24mths", "total_acc")},
    "capacity": {
        "bal_to_income": ("tot_cur_bal", "annual_inc"), "debt_ex_mort_to_income": ("total_bal_ex_mort", "annual_inc"), "revol_to_income": ("revol_bal", "annual_inc"),
        "credit_limit_to_income": ("tot_hi_cred_lim", "annual_inc"), "il_leverage": ("total_bal_il", "total_il_high_credit_limit"),
    },
}
# -- end of fixed values ---------------------------------------------------------------------


def filled(c: str, value: float) -> Column:
    return F.coalesce(clean(c), F.lit(float(value)))


def ratio(a: Column, b: str | Column) -> Column:
    """a / max(b, 1); 0 where either is null."""
    return safe_div(a, at_least(b, 1.0))


def percent(c: str, fill: float = 50.0) -> Column:
    """'12.5%' as 12.5."""
    return F.coalesce(F.expr(f"try_cast(replace(cast(`{c}` as string), '%', '') as double)"), F.lit(fill))


def employment_years(c: str) -> Column:
    """'10+ years' as 10, '< 1 year' as 0; null where no number is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\+? ?years?", ""), r"< ?1", "0"))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))


def with_target(df: DataFrame, status: str = "loan_status", name: str = "default") -> DataFrame:
    """Rows with a final status; 1 where the loan was charged off."""
    return df.filter(F.col(status).isin(*FINAL_STATUSES)).withColumn(name, (F.col(status) == EVENT_STATUS).cast("int"))


def medians(df: DataFrame) -> dict[str, float]:
    row = df.agg(*(F.percentile(clean(c), F.lit(0.5)).alias(c) for c in MEDIAN_FILLED)).first()
    return {c: row[c] for c in MEDIAN_FILLED}


def expressions(fills: dict[str, float | None]) -> dict[str, dict[str, Column]]:
    """Theme to feature to expression. fills: medians of MEDIAN_FILLED."""
    out = {theme: {n: filled(c, v) for n, (c, v) in own.items()} for theme, own in FILLED.items()}
    for theme, own in RATIOS.items():
        out[theme] |= {n: ratio(filled(a, 0), b) for n, (a, b) in own.items()}
    median = lambda c: F.coalesce(clean(c), F.lit(fills.get(c)).cast("double"))
    v, u, d, life, cap = (out[t] for t in ("velocity", "utilisation", "discipline", "lifecycle", "capacity"))
    v["inq_acceleration"] = ratio(v["inq_last_6m"], v["inq_last_12m"])
    v["inq_to_acct_ratio"] = ratio(v["inq_last_12m"], v["new_rev_12m"] + v["new_il_12m"])
    u |= {"revol_util": percent("revol_util"), "bc_util": median("bc_util"), "il_util": median("il_util"), "all_util": median("all_util")}
    u["util_gap_bc_vs_all"] = u["all_util"] - u["bc_util"]
    d["clean_payment_track"] = ((d["delinq_2yrs"] == 0) & (d["pct_tl_nvr_dlq"] >= 99) & (d["pub_rec"] == 0)).cast("double")
    life["rev_active_ratio"] = ratio(filled("num_actv_rev_tl", 0), life["num_rev_accts"])
    life["has_mortgage"] = (life["mort_acc"] > 0).cast("double")
    life["seasoning_gap"] = life["mo_sin_old_rev"] - life["mo_sin_rcnt_tl"]
    cap["dti"] = median("dti")
    cap["installment_to_income"] = ratio(12 * clean("installment"), "annual_inc")
    out["loan"] = {
        "loan_to_income": ratio(clean("loan_amnt"), "annual_inc"),
        "emp_length_yrs": employment_years("emp_length"),
        "fico_mid": (filled("fico_range_low", 660) + filled("fico_range_high", 664)) / 2,
        "loan_to_revol_limit": ratio(clean("loan_amnt"), "total_rev_hi_lim"),
        "loan_to_total_credit": ratio(clean("loan_amnt"), "tot_hi_cred_lim"),
    }
    return out


def build(df: DataFrame, sample: int | None = None, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """The engineered table: target and 57 features; sparse features go, other nulls become medians."""
    rows = with_target(df)
    if sample:
        hashed = rows.withColumn("_h", draw(seed, "loans", *(F.col(k) for k in keys or rows.columns)))
        rows = hash_rank(hashed, [], "_h", list(keys or []), "_n").filter(F.col("_n") < sample).drop("_h", "_n")
    features = {n: e for own in expressions(medians(rows)).values() for n, e in own.items()}
    table = rows.select("default", *(e.alias(n) for n, e in features.items()))
    table = checks.drop_sparse(table, list(features))
    return checks.impute_medians(table, [c for c in table.columns if c != "default"])


def by_month(df: DataFrame, dev_end: str, holdout_start: str, column: str = "issue_d", pattern: str = "MMM-yyyy") -> DataFrame:
    """Adds `period` (dev or holdout); rows between the two, and those without a month, go."""
    at = F.try_to_timestamp(F.col(column), F.lit(pattern)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("timestamp")
    name = F.when(at <= F.lit(dev_end).cast("timestamp"), "dev").when(at >= F.lit(holdout_start).cast("timestamp"), "holdout")
    return df.withColumn("period", name).filter("period is not null")
