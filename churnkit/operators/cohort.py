"""Cohort selection and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col
from churnkit.operators.ordered import exact_quantile


def _z(name: str):
    return F.coalesce(col(name), F.lit(0.0))


def spend(month: int):
    """Recharge spend of one month: amount + data count x data amount, nulls as 0."""
    return _z(f"total_rech_amt_{month}") + _z(f"total_rech_data_{month}") * _z(f"av_rech_amt_data_{month}")


def avg_spend(df: DataFrame, months=(6, 7), out: str = "av_amt_data_6_7") -> DataFrame:
    """Mean spend over the good months."""
    total = None
    for m in months:
        total = spend(m) if total is None else total + spend(m)
    return df.withColumn(out, total / F.lit(float(len(months))))


def quantile_threshold(df: DataFrame, col_name: str, q: float) -> DataFrame:
    """One-row frame with the interpolated q-quantile (exact, distributed)."""
    return exact_quantile(df, col_name, q)


def top_quantile(df: DataFrame, col_name: str, q: float = 0.7) -> DataFrame:
    """Keep rows with ``col >= quantile(q)`` (inclusive, interpolated)."""
    thr = quantile_threshold(df, col_name, q)
    return (df.crossJoin(F.broadcast(thr))  # one row
            .filter(col(col_name) >= F.col("quantile")).drop("quantile"))


def usage_label(df: DataFrame, month: int = 9, out: str = "Churn") -> DataFrame:
    """churn = no calls and no data in the label month."""
    calls = _z(f"total_ic_mou_{month}") + _z(f"total_og_mou_{month}")
    data = _z(f"vol_2g_mb_{month}") + _z(f"vol_3g_mb_{month}")
    return df.withColumn(out, F.when((calls == 0) & (data == 0), 1).otherwise(0))


def value_share(df: DataFrame, col_name: str) -> DataFrame:
    """Counts and percentage per value.

    The share divides by a grand total computed as a second aggregate and
    joined as one row, instead of an un-partitioned window.
    """
    counts = df.groupBy(col(col_name).alias(col_name)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .select(col(col_name), "count",
                    (F.col("count") * F.lit(100.0) / F.col("_total")).alias("percent")))


def rate(df: DataFrame, col_name: str) -> DataFrame:
    """P5: class rate (mean of a 0/1 column) as a one-row frame."""
    return df.agg(F.avg(col(col_name).cast("double")).alias("rate"), F.count(F.lit(1)).alias("rows"))


def high_value_cohort(usage: DataFrame, q: float = 0.7, label_month: int = 9) -> DataFrame:
    """P1 -> P2 -> P3: high-value customers with their churn label."""
    return usage_label(top_quantile(avg_spend(usage), "av_amt_data_6_7", q), label_month)

