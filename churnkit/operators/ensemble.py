"""Voting and model choice over score columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col


def soft_vote(df: DataFrame, prob_cols: list[str], out: str = "soft_prob") -> DataFrame:
    """Mean of the models' probabilities."""
    return df.withColumn(out, reduce(add, [col(c) for c in prob_cols]) / F.lit(float(len(prob_cols))))


def hard_vote(df: DataFrame, pred_cols: list[str], out: str = "hard_pred") -> DataFrame:
    """Majority of 0/1 predictions; a tie goes to 0."""
    votes = reduce(add, [col(c).cast("int") for c in pred_cols])
    return df.withColumn(out, (votes * 2 > F.lit(len(pred_cols))).cast("int"))


def weighted_vote(df: DataFrame, prob_cols: list[str], weights: DataFrame, out: str = "weighted_prob") -> DataFrame:
    """Sum of w_m * p_m, w_m = score_m / sum(score).

    ``weights`` is a one-row frame with one column per entry of ``prob_cols``
    (e.g. each model's best F1); it is normalised here and broadcast.
    """
    total = reduce(add, [F.col(f"w_{c}") for c in prob_cols])
    w = weights.select(*[col(c).alias(f"w_{c}") for c in prob_cols])
    w = w.select(*[(F.col(f"w_{c}") / total).alias(f"nw_{c}") for c in prob_cols])
    j = df.crossJoin(F.broadcast(w))  # one row
    return j.withColumn(out, reduce(add, [F.col(f"nw_{c}") * col(c) for c in prob_cols])).drop(
        *[f"nw_{c}" for c in prob_cols])


def pick_best(metrics: DataFrame, by: str = "accuracy", model: str = "model", order: str = "order") -> DataFrame:
    """The candidate with the highest metric; ties keep the first by ``order``."""
    key = F.struct(col(by), (-col(order)).alias("_first"))
    return metrics.agg(F.max_by(F.struct(col(model).alias(model), col(by).alias(by)), key).alias("b")).select("b.*")
