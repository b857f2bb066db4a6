"""Registered queries on the scored fixture (FX3): B1-B3, B6, V1-V7, K4-K6, E2-E4, E6, S6."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.operators import calibration as cal
from churnkit.operators import ensemble as ens
from churnkit.operators import evaluate as ev
from churnkit.operators.split import class_weights, fold_ids, stratified_split
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.sources import fixtures
from churnkit.sources.sinks import compare_runs

# Two more deterministic scores per row, so that there are three "models".

def model_b():
    return ((F.col("id") * 104729 + 7919) % 883 + F.when(F.col("label") == 1, 200).otherwise(0)).cast("double") / 1100


def model_c():
    return ((F.col("id") * 15485863 + 32452843) % 509
            + F.when(F.col("label") == 1, 150).otherwise(0)).cast("double") / 700


MODEL_B_SQL = "cast((id * 104729 + 7919) % 883 + case when label = 1 then 200 else 0 end as double) / 1100"
MODEL_C_SQL = "cast((id * 15485863 + 32452843) % 509 + case when label = 1 then 150 else 0 end as double) / 700"


def _rank_sql(src, seed=42):
    return (f"select *, row_number() over (partition by label order by md5(cast(id as varchar) || ':{seed}'), id) "
            f"as rk, count(*) over (partition by label) as cn from {src}")


SPLIT_SQL = ("select id, label, prob, case when rk <= (cn * 1 + 4) // 5 then 'test' else 'train' end as part "
             "from (" + _rank_sql("fx3") + ")")
WIDE_SQL = f"select id, label, part, prob as prob_a, {MODEL_B_SQL} as prob_b, {MODEL_C_SQL} as prob_c from split"
LONG_SQL = " union all ".join(f"select id, label, part, '{m}' as model, prob_{m} as prob from wide" for m in "abc")
SCORE_CTES = [("split", SPLIT_SQL), ("wide", WIDE_SQL), ("long", LONG_SQL)]


def _curve_ctes(src, prefix=""):
    """PR curve per model over ``src`` (columns model, prob, label)."""
    p = prefix
    return [
        (f"{p}pts", f"select model, prob as threshold, cast(sum(label) as bigint) as pos, count(*) as cnt "
                    f"from {src} group by model, prob"),
        (f"{p}cum", f"select model, threshold, cast(sum(pos) over w as bigint) as tp, "
                    f"cast(sum(cnt) over w - sum(pos) over w as bigint) as fp from {p}pts "
                    f"window w as (partition by model order by threshold desc "
                    f"rows between unbounded preceding and current row)"),
        (f"{p}tot", f"select model, cast(sum(label) as bigint) as big_p from {src} group by model"),
        (f"{p}curve", f"select c.model, threshold, tp, fp, cast(tp as double) / (tp + fp) as precision, "
                      f"case when big_p = 0 then 1.0 else cast(tp as double) / big_p end as recall "
                      f"from {p}cum c join {p}tot t on c.model = t.model"),
        (f"{p}f1c", f"select *, 2.0 * precision * recall / (precision + recall + 1e-10) as f1 from {p}curve"),
        (f"{p}best", f"select model, threshold, f1, precision, recall from (select *, row_number() over "
                     f"(partition by model order by f1 desc, threshold asc) as rn from {p}f1c) where rn = 1"),
    ]


def _metrics_sql(pred="pred", label="label"):
    tp = f"sum(case when {pred} = 1 and {label} = 1 then 1 else 0 end)"
    fp = f"sum(case when {pred} = 1 and {label} = 0 then 1 else 0 end)"
    fn = f"sum(case when {pred} = 0 and {label} = 1 then 1 else 0 end)"
    return (f"cast({tp} as bigint) as tp, cast({fp} as bigint) as fp, cast({fn} as bigint) as fn, "
            f"count(*) as n")


def _ratios_sql():
    def r(a, b):
        return f"case when {b} = 0 then 0.0 else cast({a} as double) / ({b}) end"
    return (f"{r('n - fp - fn', 'n')} as accuracy, {r('tp', 'tp + fp')} as precision, "
            f"{r('tp', 'tp + fn')} as recall, {r('2 * tp', '2 * tp + fp + fn')} as f1")


def scored(spark, sf_dir):
    return fixtures.scored(spark, sf_dir)


def scored_split(spark, sf_dir):
    return stratified_split(scored(spark, sf_dir), "label", "id")


def scores_wide(spark, sf_dir):
    s = scored_split(spark, sf_dir)
    return s.select("id", "label", "part", F.col("prob").alias("prob_a"), model_b().alias("prob_b"),
                    model_c().alias("prob_c"))


def scores_long(spark, sf_dir):
    w = scores_wide(spark, sf_dir)
    return w.select("id", "label", "part", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"prob_{m}").alias("prob")) for m in "abc"])).alias("x")
    ).select("id", "label", "part", "x.model", "x.prob")


# ------------------------------------------------------------------ splits

@register("b1_stratified_split", with_fx("select id, label, part from split", "fx3", extra=SCORE_CTES[:1]))
def b1_stratified_split(spark, sf_dir):
    return scored_split(spark, sf_dir).select("id", "label", "part")


@register("b2_three_way_split", with_fx(
    "select id, label, case when rk <= (cn * 1 + 4) // 5 then 'test' when rk <= (cn * 2 + 4) // 5 "
    "then 'calibration' else 'train' end as part from (" + _rank_sql("fx3") + ")", "fx3"))
def b2_three_way_split(spark, sf_dir):
    s = stratified_split(scored(spark, sf_dir), "label", "id", fracs=(0.2, 0.2),
                         names=("test", "calibration", "train"))
    return s.select("id", "label", "part")


@register("b3_fold_ids", with_fx(
    "select id, label, cast((rk - 1) % 5 as integer) as fold from (" + _rank_sql("fx3") + ")", "fx3"))
def b3_fold_ids(spark, sf_dir):
    return fold_ids(scored(spark, sf_dir), "label", "id", k=5).select("id", "label", "fold")


@register("b6_class_weights", with_fx(
    "select id, label, cast(count(*) over () as double) / (2 * count(*) over (partition by label)) as weight "
    "from fx3", "fx3"))
def b6_class_weights(spark, sf_dir):
    return class_weights(scored(spark, sf_dir), "label").select("id", "label", "weight")


# ------------------------------------------------------------------ curves and thresholds

ALL_A = ("alla", "select 'a' as model, prob, label from fx3")


@register("v1_pr_curve", with_fx(
    "select threshold, tp, fp, precision, recall, f1 from f1c", "fx3", extra=[ALL_A] + _curve_ctes("alla")[:5]))
def v1_pr_curve(spark, sf_dir):
    return ev.pr_curve(scored(spark, sf_dir))


@register("v2_best_threshold", with_fx(
    "select threshold, f1, precision, recall from best", "fx3", extra=[ALL_A] + _curve_ctes("alla")))
def v2_best_threshold(spark, sf_dir):
    return ev.best_threshold(scored(spark, sf_dir))


TRAIN_A = ("train_a", "select 'a' as model, prob, label from split where part = 'train'")


@register("v3_apply_threshold", with_fx(
    "select id, label, prob, cast(prob >= (select threshold from best) as integer) as pred "
    "from split where part = 'test'", "fx3", extra=SCORE_CTES[:1] + [TRAIN_A] + _curve_ctes("train_a")))
def v3_apply_threshold(spark, sf_dir):
    s = scored_split(spark, sf_dir)
    thr = ev.best_threshold(s.filter(F.col("part") == "train")).select("threshold")
    test = s.filter(F.col("part") == "test").crossJoin(F.broadcast(thr))  # one row
    return ev.apply_threshold(test, F.col("threshold")).select("id", "label", "prob", "pred")


@register("v4_evaluate", with_fx(
    "select " + _ratios_sql() + " from (select " + _metrics_sql() + " from (select label, "
    "cast(prob >= (select threshold from best) as integer) as pred from split where part = 'test'))",
    "fx3", extra=SCORE_CTES[:1] + [TRAIN_A] + _curve_ctes("train_a")))
def v4_evaluate(spark, sf_dir):
    return ev.evaluate(v3_apply_threshold(spark, sf_dir))


LONG_TRAIN = ("ltrain", "select model, prob, label from long where part = 'train'")
PRED_CTE = ("preds", "select l.model, l.part, l.label, l.prob, cast(l.prob >= b.threshold as integer) as pred "
                     "from long l join best b on l.model = b.model")


def scored_preds(spark, sf_dir):
    long = scores_long(spark, sf_dir)
    thr = ev.best_threshold(long.filter(F.col("part") == "train"), by=["model"]).select("model", "threshold")
    j = long.join(F.broadcast(thr), "model")  # one row per model
    return j.withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("int"))


@register("v5_overfit_table", with_fx(
    "select model, train_acc, test_acc, train_acc - test_acc as acc_gap, train_f1, test_f1, "
    "train_f1 - test_f1 as f1_gap, case when train_f1 - test_f1 > 0.1 then 'high' when train_f1 - test_f1 < 0.05 "
    "then 'healthy' else 'moderate' end as verdict from (select model, "
    "max(case when part = 'train' then accuracy end) as train_acc, max(case when part = 'test' then accuracy end) "
    "as test_acc, max(case when part = 'train' then f1 end) as train_f1, "
    "max(case when part = 'test' then f1 end) as test_f1 from (select model, part, " + _ratios_sql()
    + " from (select model, part, " + _metrics_sql() + " from preds group by model, part)) group by model)",
    "fx3", extra=SCORE_CTES + [LONG_TRAIN] + _curve_ctes("ltrain") + [PRED_CTE]))
def v5_overfit_table(spark, sf_dir):
    return ev.overfit_table(scored_preds(spark, sf_dir)).withColumn("verdict", ev.gap_verdict())


V6_SQL = ("select model, threshold, " + _ratios_sql() + ", brier from (select l.model, b.threshold, "
          + _metrics_sql("cast(l.prob >= b.threshold as integer)", "l.label")
          + ", round(avg((l.prob - l.label) * (l.prob - l.label)), 9) as brier from long l join best b "
          "on l.model = b.model where l.part = 'test' group by l.model, b.threshold)")
V6_CTES = SCORE_CTES + [LONG_TRAIN] + _curve_ctes("ltrain")


@register("v6_compare_models", with_fx(V6_SQL, "fx3", extra=V6_CTES))
def v6_compare_models(spark, sf_dir):
    out = ev.compare_models(scores_long(spark, sf_dir))
    return out.withColumn("brier", F.round("brier", 9))


@register("v7_target_gap", with_fx(
    "select model, accuracy, baseline, accuracy - 0.95 as gap_to_target, accuracy - baseline as gap_to_baseline "
    "from v6 cross join (select greatest(avg(cast(label as double)), 1.0 - avg(cast(label as double))) "
    "as baseline from split where part = 'test')", "fx3", extra=V6_CTES + [("v6", V6_SQL)]))
def v7_target_gap(spark, sf_dir):
    m = v6_compare_models(spark, sf_dir).select("model", "accuracy")
    labels = scored_split(spark, sf_dir).filter(F.col("part") == "test")
    return ev.target_gap(m, labels)


# ------------------------------------------------------------------ calibration checks

@register("k4_reliability", with_fx(
    "select bin, round(avg(prob), 9) as mean_predicted, round(avg(cast(label as double)), 9) as observed_rate, "
    "count(*) as count from (select prob, label, case " + " ".join(
        f"when prob <= {e!r} then {i}" for i, e in enumerate(cal.bin_edges())) + " else 9 end as bin from fx3) "
    "group by bin", "fx3"))
def k4_reliability(spark, sf_dir):
    return cal.reliability(scored(spark, sf_dir))


@register("k5_brier", with_fx(
    "select model, round(avg((prob - label) * (prob - label)), 9) as brier from long group by model",
    "fx3", extra=SCORE_CTES))
def k5_brier(spark, sf_dir):
    return cal.brier(scores_long(spark, sf_dir), by=["model"])


def _half_metrics_sql(m):
    return ("select " + _ratios_sql() + " from (select " + _metrics_sql() + " from (select label, "
            f"cast(prob_{m} >= 0.5 as integer) as pred from wide where part = 'test'))")


@register("k6_metric_delta", with_fx(
    "select metric, before, after, after - before as delta from (" + " union all ".join(
        f"select '{k}' as metric, b.{k} as before, a.{k} as after from bm b cross join am a"
        for k in ("accuracy", "precision", "recall", "f1")) + ")",
    "fx3", extra=SCORE_CTES[:2] + [("bm", _half_metrics_sql("a")), ("am", _half_metrics_sql("b"))]))
def k6_metric_delta(spark, sf_dir):
    w = scores_wide(spark, sf_dir).filter(F.col("part") == "test")
    before = ev.evaluate(ev.apply_threshold(w, 0.5, "prob_a"))
    after = ev.evaluate(ev.apply_threshold(w, 0.5, "prob_b"))
    return cal.metric_delta(before, after, ["accuracy", "precision", "recall", "f1"])


# ------------------------------------------------------------------ votes

@register("e2_soft_vote", with_fx(
    "select id, label, (prob_a + prob_b + prob_c) / 3.0 as soft_prob from wide", "fx3", extra=SCORE_CTES[:2]))
def e2_soft_vote(spark, sf_dir):
    return ens.soft_vote(scores_wide(spark, sf_dir), ["prob_a", "prob_b", "prob_c"]).select(
        "id", "label", "soft_prob")


HALF_PREDS = ", ".join(f"cast(prob_{m} >= 0.5 as integer) as pred_{m}" for m in "abc")


@register("e3_hard_vote", with_fx(
    "select id, label, cast((pred_a + pred_b + pred_c) * 2 > 3 as integer) as hard_pred from "
    f"(select id, label, {HALF_PREDS} from wide)", "fx3", extra=SCORE_CTES[:2]))
def e3_hard_vote(spark, sf_dir):
    w = scores_wide(spark, sf_dir)
    w = w.select("id", "label", *[(F.col(f"prob_{m}") >= 0.5).cast("int").alias(f"pred_{m}") for m in "abc"])
    return ens.hard_vote(w, ["pred_a", "pred_b", "pred_c"]).select("id", "label", "hard_pred")


@register("e4_weighted_vote", with_fx(
    "select id, label, round(nw_a * prob_a + nw_b * prob_b + nw_c * prob_c, 9) as weighted_prob from wide "
    "cross join (select w_a / (w_a + w_b + w_c) as nw_a, w_b / (w_a + w_b + w_c) as nw_b, "
    "w_c / (w_a + w_b + w_c) as nw_c from (select max(case when model = 'a' then f1 end) as w_a, "
    "max(case when model = 'b' then f1 end) as w_b, max(case when model = 'c' then f1 end) as w_c from best))",
    "fx3", extra=SCORE_CTES + [LONG_TRAIN] + _curve_ctes("ltrain")))
def e4_weighted_vote(spark, sf_dir):
    long = scores_long(spark, sf_dir)
    best = ev.best_threshold(long.filter(F.col("part") == "train"), by=["model"])
    weights = best.groupBy().pivot("model", ["a", "b", "c"]).agg(F.first("f1")).select(
        *[F.col(m).alias(f"prob_{m}") for m in "abc"])
    out = ens.weighted_vote(scores_wide(spark, sf_dir), ["prob_a", "prob_b", "prob_c"], weights)
    return out.select("id", "label", F.round("weighted_prob", 9).alias("weighted_prob"))


CAND_SQL = ("select c.model, c.ord, " + _ratios_sql() + " from (select model, ord, " + _metrics_sql()
            + " from (select label, 'a' as model, 0 as ord, cast(prob_a >= 0.5 as integer) as pred from wide "
            "where part = 'test' union all select label, 'b', 1, cast(prob_b >= 0.5 as integer) from wide "
            "where part = 'test' union all select label, 'c', 2, cast(prob_c >= 0.5 as integer) from wide "
            "where part = 'test' union all select label, 'soft', 3, cast((prob_a + prob_b + prob_c) / 3.0 >= 0.5 "
            "as integer) from wide where part = 'test' union all select label, 'hard', 4, "
            "cast((cast(prob_a >= 0.5 as integer) + cast(prob_b >= 0.5 as integer) + cast(prob_c >= 0.5 as integer))"
            " * 2 > 3 as integer) from wide where part = 'test') group by model, ord) c")


@register("e6_pick_best", with_fx(
    "select model, accuracy from (" + CAND_SQL + ") order by accuracy desc, ord asc limit 1",
    "fx3", extra=SCORE_CTES[:2]))
def e6_pick_best(spark, sf_dir):
    w = scores_wide(spark, sf_dir).filter(F.col("part") == "test")
    w = ens.soft_vote(w, ["prob_a", "prob_b", "prob_c"])
    w = w.select("label", *[(F.col(f"prob_{m}") >= 0.5).cast("int").alias(m) for m in "abc"],
                 (F.col("soft_prob") >= 0.5).cast("int").alias("soft"))
    w = ens.hard_vote(w, ["a", "b", "c"], out="hard")
    names = ["a", "b", "c", "soft", "hard"]
    long = w.select("label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("order"), F.col(m).alias("pred"))
        for i, m in enumerate(names)])).alias("x")).select("label", "x.*")
    metrics = ev.evaluate(long, by=["model", "order"])
    return ens.pick_best(metrics, by="accuracy")


@register("s6_compare_runs", with_fx(
    "select 'dataset_1' as \"Dataset\", * from (" + _half_metrics_sql("a") + ") union all "
    "select 'dataset_2', * from (" + _half_metrics_sql("b") + ")", "fx3", extra=SCORE_CTES[:2]))
def s6_compare_runs(spark, sf_dir):
    w = scores_wide(spark, sf_dir).filter(F.col("part") == "test")
    m1 = ev.evaluate(ev.apply_threshold(w, 0.5, "prob_a"))
    m2 = ev.evaluate(ev.apply_threshold(w, 0.5, "prob_b"))
    return compare_runs(("dataset_1", m1), ("dataset_2", m2))
