"""Tables with known instability, to measure how well it is found. Values are hashes of row and feature.

`generate` makes a table up; `inject_into` corrupts columns of a table that is there.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lineage import Written
from plumbline.functions.rng import draw, normal, uniform
from plumbline.operators import inference, marginal
from plumbline.operators.analyzer import StabilityAnalyzer
from plumbline.operators.ranking import hash_rank


class InstabilityType(Enum):
    HETEROSCEDASTIC = "heteroscedastic"
    DISTRIBUTION_SHIFT = "distribution_shift"
    INTERACTION = "interaction"
    MNAR = "mnar"


@dataclass(frozen=True)
class Design:
    """Sizes and strengths; a fifth of the rows is influential."""

    n_samples: int = 1000
    n_features: int = 10
    n_corrupted: int = 3
    noise_scale: float = 3.0
    shift_magnitude: float = 4.0
    interaction_strength: float = 3.0
    missing_fraction: float = 0.3
    influential: float = 0.20
    random_state: int = 42


def base(spark: SparkSession, design: Design, seed: int) -> DataFrame:
    """row_id, feature_0..., target: 1 where a logistic of the first three features passes one half."""
    rows = spark.range(design.n_samples).withColumnRenamed("id", "row_id")
    names = [f"feature_{i}" for i in range(design.n_features)]
    rows = rows.withColumns({n: normal(seed, n, F.col("row_id")) for n in names})
    signal = sum((F.col(n) for n in names[:3]), F.lit(0.0))
    return rows.withColumn("target", (1 / (1 + F.exp(-signal)) > 0.5).cast("int"))


def inject(df: DataFrame, kind: InstabilityType, features: list[str], design: Design, seed: int) -> DataFrame:
    """Makes a fifth of the rows of each feature extreme along the target; the kinds differ in how far, and in missing values."""
    names = [c for c in df.columns if c.startswith("feature_")]
    for f in features:
        hashed = df.withColumn("_h", draw(seed, "pick", f, F.col("row_id")))
        df = hash_rank(hashed, [], "_h", ["row_id"], "_rank").withColumn("_in", F.col("_rank") < int(design.influential * design.n_samples)).drop("_h", "_rank")
        size = 4 + 4 * uniform(seed, "size", f, F.col("row_id"))
        scale: Column = F.lit(design.noise_scale)
        if kind is InstabilityType.DISTRIBUTION_SHIFT:
            scale = F.lit(design.shift_magnitude)
        elif kind is InstabilityType.INTERACTION:
            others = [n for n in names if n != f]
            partner = others[(seed * 31 + names.index(f)) % len(others)]
            most = df.agg(F.max(F.abs(partner))).first()[0] or 0.0
            scale = (0.5 + F.abs(partner) / (most + 1e-8)) * design.interaction_strength
        extreme = (2.0 * F.col("target") - 1.0) * size * scale
        df = df.withColumn(f, F.when(F.col("_in"), extreme).otherwise(F.col(f)))
        if kind is InstabilityType.MNAR:
            most = df.filter(~F.col("_in")).agg(F.max(F.abs(f))).first()[0] or 1.0
            gone = ~F.col("_in") & (uniform(seed, "gone", f, F.col("row_id")) < F.abs(f) / most * design.missing_fraction)
            df = df.withColumn(f, F.when(~gone, F.col(f)))
        df = df.drop("_in")
    return df


def generate(spark: SparkSession, kind: InstabilityType, design: Design = Design()) -> tuple[DataFrame, list[str]]:
    """The table and its corrupted features (the last ones, which the target does not use)."""
    seed = design.random_state + list(InstabilityType).index(kind)
    corrupted = [f"feature_{i}" for i in range(design.n_features - design.n_corrupted, design.n_features)]
    return inject(base(spark, design, seed), kind, corrupted, design, seed), corrupted


def partner_of(names: list[str], feature: str, seed: int) -> str:
    """The other feature by whose size an interaction scales a corrupted one."""
    others = [n for n in names if n != feature]
    return others[(seed * 31 + names.index(feature)) % len(others)]


def inject_into(df: DataFrame, kind: InstabilityType | str, corrupted: list[str], names: list[str], target: str, keys: list[str], design: Design = Design(), seed: int = 42, backend: str = "xxhash64") -> DataFrame:
    """The table with its corrupted columns made extreme along the target, in units of their spread, and
    `_extreme`: for each of them whether this row's value is one of the injected ones.

    A row is picked by a hash of its keys, so nothing is shuffled or ranked: about `influential` of
    the rows are. All columns are changed from the values that they had. What is missing
    not at random goes by size against the largest of the values that stay, from one aggregation.
    """
    draws = _draws_into(corrupted, keys, seed, backend)
    out = _injected(InstabilityType(kind), corrupted, names, target, design, seed, _facts(df, corrupted, names, draws, design), draws)
    return df.withColumns(out | {"_extreme": F.struct(*((draws["pick", f] < design.influential).alias(f) for f in corrupted))})


def inject_each(df: DataFrame, kinds: list[str], corrupted: list[str], names: list[str], target: str, keys: list[str], design: Design = Design(), seed: int = 42, backend: str = "xxhash64") -> DataFrame:
    """Rows (kind, feature, y, x, extreme): the columns of `inject_into` for several kinds, from one pass after that for
    the facts. All kinds draw alike, so a row's draws are made once."""
    facts = _facts(df, corrupted, names, _draws_into(corrupted, keys, seed, backend), design)
    made = {f"_{what}_{f}": c for (what, f), c in _draws_into(corrupted, keys, seed, backend).items()}
    base = df.select(F.col(target), *names, *(c.alias(n) for n, c in made.items()))
    draws = {(what, f): F.col(f"_{what}_{f}") for what in _DRAWN for f in corrupted}
    cells = []
    for k in kinds:
        out = _injected(InstabilityType(k), corrupted, names, target, design, seed, facts, draws)
        for n in names:
            extreme = draws["pick", n] < design.influential if n in corrupted else F.lit(False)
            cells.append(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("feature"), out.get(n, F.col(n).cast("double")).alias("x"), extreme.alias("extreme")))
    return base.select(F.col(target).alias("y"), F.explode(F.array(*cells)).alias("p")).select("p.kind", "p.feature", "y", "p.x", "p.extreme")


_DRAWN = ("pick", "size", "gone")


def _draws_into(corrupted: list[str], keys: list[str], seed: int, backend: str) -> dict[tuple[str, str], Column]:
    return {(what, f): uniform(seed, what, f, *(F.col(k) for k in keys), backend=backend) for what in _DRAWN for f in corrupted}


def _facts(df: DataFrame, corrupted: list[str], names: list[str], draws: dict[tuple[str, str], Column], design: Design) -> tuple[dict, dict]:
    """Of each column: mean, spread, and the largest standard scores of all values and of those that stay. None depends on the kind."""
    value = {n: F.col(n).cast("double") for n in names}
    moments = df.agg(*(f(value[n]).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_pop))).first()  # two numbers a column
    z = _standard(names, moments.asDict())
    picked = {f: draws["pick", f] < design.influential for f in corrupted}
    most = df.agg(*(F.max(F.abs(z[n])).alias(f"all_{n}") for n in names), *(F.max(F.when(~picked[f], F.abs(z[f]))).alias(f"left_{f}") for f in corrupted)).first()
    return moments.asDict(), most.asDict()


def _standard(names: list[str], moments: dict) -> dict[str, Column]:
    return {n: (F.col(n).cast("double") - F.lit(moments[f"avg_{n}"] or 0.0)) / F.lit(moments[f"stddev_pop_{n}"] or 1.0) for n in names}


def _injected(kind: InstabilityType, corrupted: list[str], names: list[str], target: str, design: Design, seed: int, facts: tuple[dict, dict], draws: dict[tuple[str, str], Column]) -> dict[str, Column]:
    """The corrupted columns."""
    moments, most = facts
    z = _standard(names, moments)
    side = 2.0 * F.col(target) - 1.0
    out = {}
    for f in corrupted:
        picked = draws["pick", f] < design.influential
        size = 4 + 4 * draws["size", f]
        scale: Column = F.lit(design.shift_magnitude if kind is InstabilityType.DISTRIBUTION_SHIFT else design.noise_scale)
        if kind is InstabilityType.INTERACTION:
            partner = partner_of(names, f, seed)
            scale = (0.5 + F.abs(z[partner]) / F.lit((most[f"all_{partner}"] or 0.0) + 1e-8)) * design.interaction_strength
        extreme = F.lit(moments[f"avg_{f}"] or 0.0) + side * size * scale * F.lit(moments[f"stddev_pop_{f}"] or 1.0)
        own = F.when(picked, extreme).otherwise(F.col(f).cast("double"))
        if kind is InstabilityType.MNAR:
            gone = ~picked & (draws["gone", f] < F.abs(z[f]) / F.lit(most[f"left_{f}"] or 1.0) * design.missing_fraction)
            own = F.when(~gone, own)
        out[f] = own
    return out


def class_gaps(df: DataFrame, names: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """(by, feature, ks): how far each feature's distribution differs between the two classes."""
    by = by or []
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names)))
    long = df.select(*by, F.col(target).alias("y"), pairs.alias("p")).select(*by, "y", "p.feature", "p.x")
    return marginal.ks_two_sample(long.filter("y = 1"), long.filter("y = 0"), [*by, "feature"], "x")


@dataclass
class TestResult:
    kind: InstabilityType
    flags: DataFrame
    metrics: dict


class SyntheticValidation:
    def __init__(self, spark: SparkSession, design: Design = Design()):
        self.spark, self.design = spark, design

    def run_test(self, kind: InstabilityType | str, threshold: float = 0.05, use_permutation: bool = True, n_permutations: int = 30, **settings) -> TestResult:
        """Flags features by permutation, or by a score of at least the threshold; a feature without a score is not flagged."""
        kind = InstabilityType(kind)
        table, corrupted = generate(self.spark, kind, self.design)
        names = [c for c in table.columns if c.startswith("feature_")]
        return self._tested(table, kind, names, corrupted, "target", ["row_id"], threshold, use_permutation, n_permutations, settings)

    def run_on(self, df: DataFrame, kind: InstabilityType | str, corrupted: list[str], names: list[str], target: str, keys: list[str], threshold: float = 0.05, use_permutation: bool = True, n_permutations: int = 30, **settings) -> TestResult:
        """As run_test, with the instability injected into columns of a given table."""
        kind = InstabilityType(kind)
        table = inject_into(df, kind, corrupted, names, target, keys, self.design, self.design.random_state).drop("_extreme")
        return self._tested(table, kind, names, corrupted, target, keys, threshold, use_permutation, n_permutations, settings)

    def _tested(self, table: DataFrame, kind: InstabilityType, names: list[str], corrupted: list[str], target: str, keys: list[str], threshold: float, use_permutation: bool, n_permutations: int, settings: dict) -> TestResult:
        settings = {"n_resamples": 20, "random_state": self.design.random_state} | settings
        if use_permutation:
            p = inference.PermutationBaseline(n_permutations, threshold, self.design.random_state).fit(table, names, target, keys, **settings)
            flags = p.select("feature", F.col("observed").alias("score"), F.col("significant").alias("flagged"))
        else:
            panel = StabilityAnalyzer(**settings).fit_panel(table, target, names, keys)
            flags = panel.complexity_scores.select("feature", F.col("target_dependent").alias("score"), F.coalesce(F.col("target_dependent") >= threshold, F.lit(False)).alias("flagged"))
        every = self.spark.createDataFrame([(n, n in corrupted) for n in names], "feature string, corrupted boolean")
        flags = Written(self.spark)(every.join(flags, "feature", "left").fillna(False, ["flagged"]))
        return TestResult(kind, flags, inference.detection(flags, []).first().asDict())

    def run_full_suite(self, **options) -> list[TestResult]:
        return [self.run_test(kind, **options) for kind in InstabilityType]


def report(results: list[TestResult]) -> str:
    rows = [f"{r.kind.value:<20} tpr {r.metrics['tpr']:.2f}  fpr {r.metrics['fpr']:.2f}  precision {r.metrics['precision']:.2f}  f1 {r.metrics['f1']:.2f}" for r in results]
    return "\n".join(rows)
