"""Evaluation: curves, thresholds and metric tables.

Every metric is one aggregate of conditional counts.  The precision-recall
curve needs running sums over descending scores; it collapses rows to
distinct scores first and uses the sliced running sum of
:mod:`churnkit.operators.ordered`, so no window runs over the whole table on
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col, qi
from churnkit.operators.ordered import running_totals

EPS = 1e-10            # F1 denominator guard of the threshold search
DEFAULT_THRESHOLD = 0.5


def pr_curve(df: DataFrame, prob: str = "prob", label: str = "label", by: list[str] | None = None,
             score_range: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """V1: one point per distinct score t (pred = score >= t), per ``by`` group.

    Columns: by..., threshold, tp, fp, precision, recall, f1.  Scores are
    probabilities by default (fixed slices over [0, 1]); pass
    ``score_range=None`` for unbounded scores (quantile slices).
    """
    by = list(by or [])
    pts = df.groupBy(*[col(b) for b in by], col(prob).alias("threshold")).agg(
        F.sum(col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    cum = running_totals(pts, "threshold", ["pos", "cnt"], descending=True, by=by, value_range=score_range)
    totals = df.groupBy(*[col(b) for b in by]).agg(F.sum(col(label).cast("long")).alias("_P"))
    j = cum.join(F.broadcast(totals), by) if by else cum.crossJoin(F.broadcast(totals))
    tp = F.col("cum_pos")
    fp = F.col("cum_cnt") - F.col("cum_pos")
    precision = tp / (tp + fp)
    recall = F.when(F.col("_P") == 0, F.lit(1.0)).otherwise(tp / F.col("_P"))
    out = j.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"),
                   precision.alias("precision"), recall.alias("recall"))
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS))
    return out.withColumn("f1", f1)


def best_threshold(df: DataFrame, prob: str = "prob", label: str = "label",
                   by: list[str] | None = None) -> DataFrame:
    """V2: threshold of the highest F1 (ties -> lowest threshold); 0.5 when no point.

    Columns: by..., threshold, f1, precision, recall.
    """
    by = list(by or [])
    curve = pr_curve(df, prob, label, by)
    order = F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"))
    best = curve.groupBy(*by).agg(
        F.max_by(F.struct("threshold", "f1", "precision", "recall"), order).alias("b"))
    best = best.select(*by, "b.*")
    if by:
        return best
    # a global aggregate always yields one row: an empty curve gives the default
    return best.select(F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
                       F.coalesce("f1", F.lit(0.0)).alias("f1"), "precision", "recall")


def apply_threshold(df: DataFrame, threshold, prob: str = "prob", out: str = "pred") -> DataFrame:
    """V3: pred = prob >= threshold (a number or a column)."""
    t = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    return df.withColumn(out, (col(prob) >= t).cast("int"))


def metric_columns(pred: str = "pred", label: str = "label"):
    p, y = qi(pred), qi(label)
    tp = F.expr(f"cast(sum(case when {p} = 1 and {y} = 1 then 1 else 0 end) as bigint)")
    fp = F.expr(f"cast(sum(case when {p} = 1 and {y} = 0 then 1 else 0 end) as bigint)")
    fn = F.expr(f"cast(sum(case when {p} = 0 and {y} = 1 then 1 else 0 end) as bigint)")
    n = F.expr("count(1)")
    return tp, fp, fn, n


def evaluate(df: DataFrame, pred: str = "pred", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """V4: accuracy, precision, recall, F1 of the positive class; 0/0 -> 0."""
    by = list(by or [])
    tp, fp, fn, n = metric_columns(pred, label)
    counts = df.groupBy(*[col(b) for b in by]).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), n.alias("n"))
    return counts.selectExpr(*[qi(b) for b in by], *METRICS_SQL)


def _ratio(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0.0D else ({a}) / ({b}) end"


METRICS_SQL = [f"{_ratio('n - fp - fn', 'n')} as accuracy", f"{_ratio('tp', 'tp + fp')} as precision",
               f"{_ratio('tp', 'tp + fn')} as recall", f"{_ratio('2 * tp', '2 * tp + fp + fn')} as f1"]


def metrics_from_counts():
    return [F.expr(m) for m in METRICS_SQL]


def overfit_table(preds: DataFrame, model: str = "model", part: str = "part", pred: str = "pred",
                  label: str = "label", train: str = "train", test: str = "test") -> DataFrame:
    """V5: train and test accuracy / F1 per model with the gaps."""
    m = evaluate(preds, pred, label, by=[model, part])
    wide = m.groupBy(model).pivot(part, [train, test]).agg(F.first("accuracy").alias("acc"),
                                                           F.first("f1").alias("f1"))
    return wide.select(
        model,
        F.col(f"{train}_acc").alias("train_acc"), F.col(f"{test}_acc").alias("test_acc"),
        (F.col(f"{train}_acc") - F.col(f"{test}_acc")).alias("acc_gap"),
        F.col(f"{train}_f1").alias("train_f1"), F.col(f"{test}_f1").alias("test_f1"),
        (F.col(f"{train}_f1") - F.col(f"{test}_f1")).alias("f1_gap"))


def gap_verdict(gap_col: str = "f1_gap"):
    """Rule of thumb on a train-test gap: >0.10 high, <0.05 healthy, else moderate."""
    g = F.col(gap_col)
    return F.when(g > 0.10, "high").when(g < 0.05, "healthy").otherwise("moderate")


def compare_models(scores: DataFrame, model: str = "model", part: str = "part", prob: str = "prob",
                   label: str = "label", fit_part: str = "train", report_part: str = "test") -> DataFrame:
    """V6: per model, threshold picked on ``fit_part``, metrics and Brier on ``report_part``."""
    fit = scores.filter(col(part) == fit_part)
    thr = best_threshold(fit, prob, label, by=[model]).select(model, F.col("threshold"))
    rep = scores.filter(col(part) == report_part).join(F.broadcast(thr), model)
    rep = rep.withColumn("pred", (col(prob) >= F.col("threshold")).cast("int"))
    tp, fp, fn, n = metric_columns("pred", label)
    err = col(prob) - col(label)
    counts = rep.groupBy(model).agg(F.first("threshold").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                                    fn.alias("fn"), n.alias("n"), F.avg(err * err).alias("brier"))
    return counts.select(model, "threshold", *metrics_from_counts(), "brier")


def target_gap(metrics: DataFrame, labels: DataFrame, label: str = "label", target: float = 0.95,
               metric: str = "accuracy") -> DataFrame:
    """V7: distance of a metric to a target and to the majority-class baseline."""
    base = labels.agg(F.avg(col(label).cast("double")).alias("_rate"))
    base = base.select(F.greatest(F.col("_rate"), F.lit(1.0) - F.col("_rate")).alias("baseline"))
    return metrics.crossJoin(F.broadcast(base)).select(
        "*", (col(metric) - F.lit(target)).alias("gap_to_target"),
        (col(metric) - F.col("baseline")).alias("gap_to_baseline"))
