"""Categorical features as Spark ML's trees take them: as numbered values with nominal metadata.

An encoded column holds the number of its value in the alphabet's order of the values seen
when the encoding was fitted; other values, and nulls, have one number of their own.
Trees then split it by sets of values, and `models.leaf_paths` explains such splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Estimators that split by sets of values.
NATIVE = (DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier, RandomForestRegressor, GBTClassifier, GBTRegressor)


def supports_categorical(estimator: Estimator | None) -> bool:
    return isinstance(estimator, NATIVE)


def categorical_indices(features: Sequence[str], categorical: Sequence[str | int] | None) -> list[int] | None:
    """Positions of the categorical features, given by name or position; names that are no features are left out. None if there are none."""
    if categorical is None:
        return None
    found = [c if isinstance(c, int) else list(features).index(c) for c in categorical if isinstance(c, int) or c in features]
    return found or None


def is_nominal(df: DataFrame, column: str) -> bool:
    return df.schema[column].metadata.get("ml_attr", {}).get("type") == "nominal"


class CategoryEncoder:
    """Numbers the values of columns; the values seen are the model, bounded by the trees' bins."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.model: StringIndexerModel | None = None

    def fit(self, df: DataFrame) -> CategoryEncoder:
        if self.columns:
            self.model = StringIndexer(inputCols=self.columns, outputCols=[f"_code_{c}" for c in self.columns], handleInvalid="keep", stringOrderType="alphabetAsc").fit(self._text(df))
        return self

    def labels(self) -> dict[str, list[str]]:
        return dict(zip(self.columns, map(list, self.model.labelsArray), strict=True)) if self.model else {}

    def transform(self, df: DataFrame) -> DataFrame:
        """The table with the columns as numbers, in the place of their values."""
        if not self.model:
            return df
        coded = self.model.transform(self._text(df)).drop(*self.columns)
        return coded.withColumnsRenamed({f"_code_{c}": c for c in self.columns}).select(*df.columns)

    def _text(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("string") for c in self.columns})


def prepare_categorical(estimator: Estimator, df: DataFrame, features: Sequence[str], categorical: Sequence[str | int] | None = None) -> tuple[DataFrame, list[int] | None, bool]:
    """The table for training, positions of the categorical features, and whether they still need an encoding.

    An estimator that takes categories gets them numbered, and enough bins for them; for
    others the table stays as it is.
    """
    found = categorical_indices(features, categorical)
    if not supports_categorical(estimator):
        return df, found, True
    if found:
        encoder = CategoryEncoder([features[i] for i in found]).fit(df)
        df = encoder.transform(df)
        most = max(len(v) + 1 for v in encoder.labels().values())
        if most > estimator.getMaxBins():
            estimator.setMaxBins(most)
    return df, found, False
