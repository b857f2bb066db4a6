"""Monthly-usage preparation: cohort, label, leakage drop, cleaning, features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from churnkit.operators.clean import USAGE_DROP, drop_if_present, drop_period, fill_zero
from churnkit.operators.cohort import avg_spend, top_quantile, usage_label
from churnkit.operators.features import usage_change_features


def prepare_usage(usage: DataFrame, q: float = 0.7, label_month: int = 9,
                  keep_id: str | None = "customer_id") -> DataFrame:
    """High-value cohort with label; every label-month column and helper dropped.

    Order matters for leakage: the label is read from month ``label_month``
    first, then every ``_{label_month}`` column goes, then nulls become 0.
    """
    cohort = usage_label(top_quantile(avg_spend(usage), "av_amt_data_6_7", q), label_month)
    drop = [c for c in USAGE_DROP if c != keep_id]
    cleaned = drop_if_present(drop_period(cohort, label_month), drop)
    return fill_zero(cleaned)


def usage_model_frame(usage: DataFrame, q: float = 0.7) -> DataFrame:
    """Prepared cohort plus behaviour-change features."""
    return usage_change_features(prepare_usage(usage, q))
