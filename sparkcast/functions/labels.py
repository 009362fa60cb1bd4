"""Labels derived from diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages of the error analysis.
CAUSE_BIAS = "Significant under-prediction bias detected."
CAUSE_AUTOCORRELATION = "High residual autocorrelation suggests missing lagged features or seasonality."
CAUSE_NONE = "No obvious root causes identified in standard residuals."


def drift_severity(p_value: Column, effect_size: Column) -> Column:
    return (
        F.when((p_value < 0.01) & (effect_size > 0.5), "high").when(p_value < 0.05, "medium").otherwise("low")
    )


def drift_action(severity: Column) -> Column:
    return F.when(
        severity == "high", "Consider retraining the model if this feature is highly important globally."
    ).otherwise("Monitor feature.")


def root_causes(mean_residual: Column, autocorrelation: Column) -> Column:
    """Array of suspected causes, never empty."""
    found = F.array_compact(
        F.array(
            F.when(mean_residual > 10.0, F.lit(CAUSE_BIAS)),
            F.when(autocorrelation > 0.5, F.lit(CAUSE_AUTOCORRELATION)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(CAUSE_NONE)))


def root_cause_severity(mean_residual: Column, autocorrelation: Column) -> Column:
    """Highest severity among the causes: bias is high, autocorrelation medium."""
    return F.when(mean_residual > 10.0, "high").when(autocorrelation > 0.5, "medium").otherwise("low")


def bias_label(mean_residual: Column) -> Column:
    """Direction of error for residuals taken as actual - prediction."""
    return (
        F.when(mean_residual < 0, "over_predicting").when(mean_residual > 0, "under_predicting").otherwise("neutral")
    )
