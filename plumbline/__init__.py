"""Feature-stability analytics as Spark DataFrame, SQL and Spark ML plans.

The names below can be imported from here; their modules are loaded when they are used.
"""

from importlib import import_module

VERSION = "0.1.0"

_HOME = {
    "analyzer": "StabilityAnalyzer Settings Panel complexity_score",
    "attribution": "DEFAULT_SHAP_WEIGHTS all_metrics rank_agreement rank_stability direction_consistency magnitude_cv magnitude_iqr topk_overlap js_divergence",
    "categories": "CategoryEncoder supports_categorical categorical_indices prepare_categorical",
    "checks": "ImbalanceError TARGET_AGNOSTIC_METRICS TARGET_DEPENDENT_METRICS SHAP_TARGET_AGNOSTIC_METRICS SHAP_TARGET_DEPENDENT_METRICS metric_category",
    "compare": "join_scores",
    "curves": "DEFAULT_WEIGHTS fit",
    "drift": "grade overall_score feature_drift",
    "inference": "bootstrap_ci bootstrap_values MetaBootstrap SplitStrategy PermutationBaseline detection",
    "mergeable": "Statistic Ratio TrimmedMean",
    "models": "AttributionStability tree_attributions tree_interactions interaction_strength linear_attributions",
    "out_of_sample": "Reference composite against_scores",
    "reliability": "ReliabilityConfig ReliabilityScorer",
    "report": "panel_report curve_plot_data panel_plot_data",
    "sampling": "pool_ladder draw_pools bootstrap permuted",
    "selection": "forward_selection fold_auc",
    "synthetic": "InstabilityType SyntheticValidation inject_into",
}
_MODULE = {name: module for module, names in _HOME.items() for name in names.split()}
__all__ = ["VERSION", *sorted(_MODULE)]


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.operators.{_MODULE[name]}"), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
