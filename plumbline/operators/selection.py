"""Forward selection with one pass for collinearity and one job per Newton step for all folds.

Inflation comes from the cross products of all candidates, read once: a Cholesky factor of
the chosen ones grows by a row for each column admitted. A set of columns is judged by
logistic models of all folds together: each row adds its gradient and curvature to the
models of the folds that it trains, a batch at a time, so an iteration is one job of a few
sums, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean
from plumbline.operators.importance import gram, ranking_metrics

#: Pivots below this share of a column's own square mean that the chosen columns determine it.
DETERMINED = 1e-9
#: Rows of a kind on average from which equal rows are counted once before models are fitted.
REPEATS = 8


class GrowingFactor:
    """Lower Cholesky factor of the scaled cross products of admitted columns."""

    def __init__(self, cross: np.ndarray):
        size = np.sqrt(np.diag(cross))
        self.constant = size == 0
        scale = np.where(self.constant, 1.0, size)
        self.r = cross / np.outer(scale, scale)
        self.chosen: list[int] = []
        self.factor = np.zeros((0, 0))

    def _row(self, i: int) -> np.ndarray:
        """The candidate's row of the factor, without its pivot."""
        out = np.zeros(len(self.chosen))
        for k, j in enumerate(self.chosen):
            out[k] = (self.r[i, j] - out[:k] @ self.factor[k, :k]) / self.factor[k, k]
        return out

    def inflation(self, i: int) -> float:
        """Variance inflation of a candidate next to the admitted columns; 1 without any, or for a constant."""
        if not self.chosen or self.constant[i]:
            return 1.0
        row = self._row(i)
        return 1 / max(1 - float(row @ row), DETERMINED)

    def admit(self, i: int) -> None:
        row = self._row(i)
        n = len(self.chosen)
        grown = np.zeros((n + 1, n + 1))
        grown[:n, :n] = self.factor
        grown[n, :n] = row
        # a column that the others determine adds nothing to later rows, whatever its pivot
        grown[n, n] = np.sqrt(max(self.r[i, i] - float(row @ row), DETERMINED))
        self.factor = grown
        self.chosen.append(i)


def inflations(cross: np.ndarray, chosen: Sequence[int]) -> list[float]:
    """Of each chosen column next to the others: the diagonal of the inverse of their correlations; infinite if they determine it."""
    size = np.sqrt(np.diag(cross))[list(chosen)]
    live = [k for k in range(len(chosen)) if size[k] > 0]
    out = [np.inf] * len(chosen)
    if live:
        at = [chosen[k] for k in live]
        r = cross[np.ix_(at, at)] / np.outer(size[live], size[live])
        values, vectors = np.linalg.eigh(r)
        for n, k in enumerate(live):
            own = vectors[n] ** 2
            free = values > DETERMINED
            out[k] = float((own[free] / values[free]).sum()) if own[~free].sum() < 1e-6 else np.inf
    return out


def _counted(df: DataFrame, columns: Sequence[str], target: str, fold: str) -> tuple[DataFrame, bool]:
    """Rows (fold, y, x0, x1, ..., cnt), nulls as 0; equal ones once with their number, and kept, where there are at least REPEATS of a kind."""
    x = [F.coalesce(clean(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.col(target).cast("double").alias("y"), *x)
    kinds = F.approx_count_distinct(F.xxhash64(*rows.columns))  # decides what is counted, and changes no result
    n, different = rows.agg(F.count("*"), kinds).first()
    if different * REPEATS > n:
        return rows.withColumn("cnt", F.lit(1).cast("long")), False
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("cnt")).persist(), True


def _fitted(rows: DataFrame, d: int, k: int, most: int, ridge: float, close: float) -> np.ndarray:
    """`fold_models` of `_counted` rows; d: columns and intercept."""
    weight, names = F.col("cnt"), [f"x{i}" for i in range(d - 1)]
    facts = rows.agg(F.sum(weight), *(F.sum(weight * F.col(n)) for n in names)).first()  # a number a column
    mean = np.array(facts[1:], float) / facts[0]
    spread = rows.agg(*(F.sum(weight * F.pow(F.col(n) - F.lit(float(m)), 2)) for n, m in zip(names, mean, strict=True))).first()
    sd = np.sqrt(np.array(spread, float) / facts[0])
    sd = np.where(sd > 0, sd, 1.0)
    beta = np.zeros((k, d))

    def sums(current: np.ndarray) -> Callable:
        def run(batches):
            out = np.zeros((k, d + d * d))
            for b in batches:
                own, y, cnt, *x = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y", "cnt", *names))
                for a in range(0, len(y), 4096):
                    at = slice(a, a + 4096)
                    z = np.column_stack([np.ones(len(y[at])), *((v[at] - m) / s for v, m, s in zip(x, mean, sd, strict=True))])
                    # a row counts for the models of all folds but its own
                    trains = (own[at, None] != np.arange(k)) * cnt[at, None]
                    p = 1 / (1 + np.exp(-np.clip(z @ current.T, -35, 35)))
                    out[:, :d] += (trains * (y[at, None] - p)).T @ z
                    out[:, d:] += (trains * p * (1 - p)).T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), d + d * d)), pa.array(np.tile(np.arange(d + d * d, dtype=np.int32), k)), pa.array(out.ravel())], names=["f", "i", "s"])

        return run

    for _ in range(most):
        total = rows.mapInArrow(sums(beta.copy()), "f int, i int, s double").groupBy("f", "i").agg(F.sum("s").alias("s")).toPandas()  # squares of the columns, for each fold
        table = np.zeros((k, d + d * d))
        table[total["f"], total["i"]] = total["s"]
        step = np.stack([np.linalg.solve(t[d:].reshape(d, d) + ridge * np.eye(d), t[:d]) for t in table])
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < close:
            break
    out = beta.copy()
    out[:, 1:] /= sd
    out[:, 0] -= (beta[:, 1:] * mean / sd).sum(1)
    return out


def fold_models(df: DataFrame, columns: Sequence[str], target: str, k: int, fold: str = "fold", most: int = 25, ridge: float = 1e-8, close: float = 1e-8) -> np.ndarray:
    """Logistic coefficients (k, 1 + columns), intercept first: model f of the rows whose fold is not f. Nulls count as 0."""
    rows, kept = _counted(df, columns, target, fold)
    beta = _fitted(rows, len(columns) + 1, k, most, ridge, close)
    if kept:
        rows.unpersist()
    return beta


def fold_auc(df: DataFrame, columns: Sequence[str], target: str, k: int, fold: str = "fold") -> float:
    """Mean area under the curve of held-out folds; one half without columns."""
    if not columns:
        return 0.5
    rows, kept = _counted(df, columns, target, fold)
    beta = _fitted(rows, len(columns) + 1, k, 25, 1e-8, 1e-8)
    of = lambda i: F.element_at(F.array(*(F.lit(float(b)) for b in beta[:, i])), F.col("fold") + 1)
    score = sum((of(i + 1) * F.col(f"x{i}") for i in range(len(columns))), of(0))
    scored = rows.select("fold", F.col("y").cast("int").alias("label"), (1 / (1 + F.exp(-score))).alias("score"), "cnt")
    auc = ranking_metrics(scored, ["fold"], "label", "score", weight="cnt").agg(F.avg("auc")).first()[0] or 0.5
    if kept:
        rows.unpersist()
    return auc


def forward_selection(df: DataFrame, candidates: Sequence[str], evaluate: Callable[[list[str]], float], gain: float = 0.003, more: float = 0.005, high: float = 5.0, most: float = 10.0) -> list[str]:
    """Greedy: candidates by rising inflation, each admitted if `evaluate(columns)` (an area under the
    curve, `fold_auc` for one) gains enough, and by more where its inflation is over `high`; then the
    most inflated column goes while it is over `most`. The table is read once for all inflations."""
    cross = gram(df, list(candidates))
    first = inflations(cross, range(len(candidates)))
    grown, best = GrowingFactor(cross), 0.5
    for i in sorted(range(len(candidates)), key=lambda i: (first[i], i)):
        need = gain + (more if grown.inflation(i) > high else 0.0)
        score = evaluate([candidates[j] for j in [*grown.chosen, i]])
        if score - best >= need:
            grown.admit(i)
            best = score
    chosen = list(grown.chosen)
    while len(chosen) > 1:
        own = inflations(cross, chosen)
        worst = int(np.argmax(own))
        if own[worst] <= most:
            break
        chosen.pop(worst)
    return [candidates[i] for i in chosen]
