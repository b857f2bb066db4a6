"""Registered queries on the monthly-usage fixture (FX2): C4-C6, P1-P5, F8-F17, I2."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.functions.columns import col
from churnkit.operators import cohort, features
from churnkit.operators.clean import drop_period, fill_zero
from churnkit.operators.profile import null_counts
from churnkit.operators.usage import prepare_usage, usage_model_frame
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.sources import fixtures

FX2_COLS = (["total_rech_amt_6", "total_rech_amt_7", "total_rech_amt_8", "total_rech_amt_9"]
            + [f"{n}_{m}" for n in ("total_ic_mou", "total_og_mou", "vol_2g_mb") for m in (6, 7, 8, 9)]
            + ["total_rech_data_6", "av_rech_amt_data_6", "total_rech_data_7", "av_rech_amt_data_7"]
            + [f"vol_3g_mb_{m}" for m in (6, 7, 8, 9)] + ["fb_user_6", "fb_user_7", "fb_user_8"])
KEPT = [c for c in FX2_COLS if not c.endswith("_9")]
BASES = features.common_metrics(KEPT)


def _spend_sql(m):
    return (f"(coalesce(total_rech_amt_{m}, 0) + coalesce(total_rech_data_{m}, 0)"
            f" * coalesce(av_rech_amt_data_{m}, 0))")


SPEND_CTE = f"select *, ({_spend_sql(6)} + {_spend_sql(7)}) / 2 as av_amt_data_6_7 from fx2"
COHORT_CTE = ("select * from spend where av_amt_data_6_7 >= "
              "(select quantile_cont(av_amt_data_6_7, 0.7) from spend)")
LABEL_CTE = ("select *, case when coalesce(total_ic_mou_9, 0) + coalesce(total_og_mou_9, 0) = 0 "
             "and coalesce(vol_2g_mb_9, 0) + coalesce(vol_3g_mb_9, 0) = 0 then 1 else 0 end as \"Churn\" "
             "from cohort")
PREP_CTE = ("select customer_id, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in KEPT)
            + ", av_amt_data_6_7, \"Churn\" from labeled")
PREPARED = [("spend", SPEND_CTE), ("cohort", COHORT_CTE), ("labeled", LABEL_CTE), ("prepared", PREP_CTE)]


def _mean_sql(cols):
    return "((" + " + ".join(cols) + f") / {float(len(cols))})"


def _std_sql(cols):
    m = _mean_sql(cols)
    ss = " + ".join(f"(({c}) - {m}) * (({c}) - {m})" for c in cols)
    return f"sqrt(({ss}) / {float(len(cols) - 1)})"


def _clip_sql(e):
    # null stays null (pandas clip keeps NaN); DuckDB's least/greatest would skip it
    return f"case when ({e}) is null then null else greatest(-1.0, least(1.0, {e})) end"


def _drop_sql(m):
    return _clip_sql(f"({m}_7 - {m}_8) / nullif({m}_7 + 1, 0)")


RECH = ["total_rech_amt_6", "total_rech_amt_7", "total_rech_amt_8"]
CHANGE_SQL = (
    f"{_drop_sql('total_ic_mou')} as \"CallUsageDrop_7to8\", "
    f"{_drop_sql('vol_2g_mb')} as \"DataUsageDrop_7to8\", "
    f"{_std_sql(RECH)} / nullif({_mean_sql(RECH)} + 1, 0) as \"RechargeConsistency\", "
    "case when total_ic_mou_8 = 0 and vol_2g_mb_8 = 0 then 1 else 0 end as \"WentQuiet\"")


@register("c4_fill_zero", with_fx(
    "select customer_id, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in FX2_COLS) + " from fx2", "fx2"))
def c4_fill_zero(spark, sf_dir):
    return fill_zero(fixtures.usage_wide(spark, sf_dir))


@register("c6_drop_period", with_fx(
    "select customer_id, " + ", ".join(KEPT) + " from fx2", "fx2"))
def c6_drop_period(spark, sf_dir):
    return drop_period(fixtures.usage_wide(spark, sf_dir), 9)


@register("p1_avg_spend", with_fx(
    f"select customer_id, ({_spend_sql(6)} + {_spend_sql(7)}) / 2 as av_amt_data_6_7 from fx2", "fx2"))
def p1_avg_spend(spark, sf_dir):
    return cohort.avg_spend(fixtures.usage_wide(spark, sf_dir)).select("customer_id", "av_amt_data_6_7")


@register("p2_top_quantile", with_fx(
    "select customer_id, av_amt_data_6_7 from cohort", "fx2", extra=PREPARED[:2]))
def p2_top_quantile(spark, sf_dir):
    u = cohort.avg_spend(fixtures.usage_wide(spark, sf_dir))
    return cohort.top_quantile(u, "av_amt_data_6_7", 0.7).select("customer_id", "av_amt_data_6_7")


@register("p2_quantile_value", with_fx(
    "select round(quantile_cont(av_amt_data_6_7, 0.7), 4) as threshold_70 from spend", "fx2",
    extra=PREPARED[:1]))
def p2_quantile_value(spark, sf_dir):
    u = cohort.avg_spend(fixtures.usage_wide(spark, sf_dir))
    return cohort.quantile_threshold(u, "av_amt_data_6_7", 0.7).select(
        F.round("quantile", 4).alias("threshold_70"))


@register("p3_usage_label", with_fx(
    "select customer_id, \"Churn\" from labeled", "fx2", extra=PREPARED[:3]))
def p3_usage_label(spark, sf_dir):
    u = cohort.high_value_cohort(fixtures.usage_wide(spark, sf_dir))
    return u.select("customer_id", "Churn")


@register("p4_value_share", with_fx(
    "select \"Churn\", count(*) as count, count(*) * 100.0 / sum(count(*)) over () as percent "
    "from labeled group by \"Churn\"", "fx2", extra=PREPARED[:3]))
def p4_value_share(spark, sf_dir):
    u = cohort.high_value_cohort(fixtures.usage_wide(spark, sf_dir))
    return cohort.value_share(u, "Churn")


@register("p5_rate", with_fx(
    "select avg(cast(\"Churn\" as double)) as rate, count(*) as rows from labeled", "fx2",
    extra=PREPARED[:3]))
def p5_rate(spark, sf_dir):
    return cohort.rate(cohort.high_value_cohort(fixtures.usage_wide(spark, sf_dir)), "Churn")


@register("c5_prepare_usage", with_fx("select * from prepared", "fx2", extra=PREPARED))
def c5_prepare_usage(spark, sf_dir):
    return prepare_usage(fixtures.usage_wide(spark, sf_dir))


def _behaviour_sql(stats=("trend", "avg", "std"), names="base"):
    out, i = [], 0
    for b in BASES:
        cols = [f"{b}_{m}" for m in (6, 7, 8)]
        for s in stats:
            e = {"trend": f"{b}_8 - {b}_6", "avg": _mean_sql(cols), "std": _std_sql(cols)}[s]
            name = f"{b}_{s}" if names == "base" else f"feature_{i}"
            out.append(f"{e} as {name}")
            i += 1
    return ", ".join(out)


@register("f8_common_metrics", with_fx(
    " union all ".join(
        f"select '{b}' as metric, count(*) filter (where {b}_6 is not null and {b}_7 is not null "
        f"and {b}_8 is not null) as rows_with_all_months from prepared" for b in BASES),
    "fx2", extra=PREPARED))
def f8_common_metrics(spark, sf_dir):
    """F8: metrics present for months 6-8, with how many rows carry all three."""
    prepared = prepare_usage(fixtures.usage_wide(spark, sf_dir))
    names = features.common_metrics(prepared.columns)
    counts = prepared.agg(*[F.count(F.when(col(f"{b}_6").isNotNull() & col(f"{b}_7").isNotNull()
                                           & col(f"{b}_8").isNotNull(), 1)).alias(b) for b in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("metric"),
                                                      col(b).alias("rows_with_all_months"))
                                             for b in names])).alias("m")).select("m.*")


def _trend(stats, names="base"):
    def fn(spark, sf_dir):
        prepared = prepare_usage(fixtures.usage_wide(spark, sf_dir))
        out = features.behaviour_features(prepared, stats=stats, names=names)
        return out.select("customer_id", *out.columns[len(prepared.columns):])
    return fn


register("f9_trend", with_fx(f"select customer_id, {_behaviour_sql(('trend',))} from prepared",
                             "fx2", extra=PREPARED))(_trend(("trend",)))
register("f10_mean", with_fx(f"select customer_id, {_behaviour_sql(('avg',))} from prepared",
                             "fx2", extra=PREPARED))(_trend(("avg",)))
register("f11_row_std", with_fx(f"select customer_id, {_behaviour_sql(('std',))} from prepared",
                                "fx2", extra=PREPARED))(_trend(("std",)))
register("f17_trend_avg_generated", with_fx(
    f"select customer_id, {_behaviour_sql(('trend', 'avg'), 'generated')} from prepared",
    "fx2", extra=PREPARED))(_trend(("trend", "avg"), "generated"))


@register("f12_f14_usage_change", with_fx(
    f"select customer_id, {CHANGE_SQL} from prepared", "fx2", extra=PREPARED))
def f12_f14_usage_change(spark, sf_dir):
    out = usage_model_frame(fixtures.usage_wide(spark, sf_dir))
    return out.select("customer_id", "CallUsageDrop_7to8", "DataUsageDrop_7to8",
                      "RechargeConsistency", "WentQuiet")


@register("f12_f17_usage_model_frame", with_fx(
    f"select *, {_behaviour_sql()} from (select *, {CHANGE_SQL} from prepared)", "fx2", extra=PREPARED))
def f12_f17_usage_model_frame(spark, sf_dir):
    return usage_model_frame(fixtures.usage_wide(spark, sf_dir))


def _sum_sql(cols):
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ")"


_TOT_COLS = features.matching_columns(KEPT + ["av_amt_data_6_7", "Churn"], ("og_mou", "ic_mou"))
_DATA_COLS = features.matching_columns(KEPT + ["av_amt_data_6_7", "Churn"], ("vol_2g_mb", "vol_3g_mb"))
_MOU_COLS = features.matching_columns(KEPT + ["av_amt_data_6_7", "Churn"], ("mou",))
_RECH_COLS = features.matching_columns(KEPT + ["av_amt_data_6_7", "Churn"], ("rech",), ignore_case=True)


@register("f15_f16_usage_totals", with_fx(
    f"select customer_id, {_sum_sql(_TOT_COLS)} as total_calls_6_8, {_sum_sql(_DATA_COLS)} as total_data_6_8, "
    f"{_sum_sql(_MOU_COLS)} as total_usage_6_8, {_sum_sql(_RECH_COLS)} as total_rech_6_8, "
    f"{_std_sql(_RECH_COLS)} as rech_consistency from prepared", "fx2", extra=PREPARED))
def f15_f16_usage_totals(spark, sf_dir):
    out = features.usage_totals(prepare_usage(fixtures.usage_wide(spark, sf_dir)))
    return out.select("customer_id", "total_calls_6_8", "total_data_6_8", "total_usage_6_8",
                      "total_rech_6_8", "rech_consistency")


@register("i2_null_counts", with_fx(
    "select * from (" + " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from fx2"
        for c in ["customer_id"] + FX2_COLS) + ") where null_count > 0", "fx2"))
def i2_null_counts(spark, sf_dir):
    return null_counts(fixtures.usage_wide(spark, sf_dir), only_with_nulls=True)


@register("slice_went_quiet_churn", with_fx(
    f"select \"WentQuiet\", count(*) as customers, cast(sum(\"Churn\") as bigint) as churned, "
    f"round(avg(cast(\"Churn\" as double)), 6) as churn_rate "
    f"from (select \"Churn\", {CHANGE_SQL} from prepared) group by \"WentQuiet\"", "fx2", extra=PREPARED))
def slice_went_quiet_churn(spark, sf_dir):
    """Step-1 slice: usage -> high-value cohort -> label -> features -> churn by WentQuiet."""
    frame = usage_model_frame(fixtures.usage_wide(spark, sf_dir))
    return frame.groupBy("WentQuiet").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("Churn").alias("churned"),
        F.round(F.avg(col("Churn").cast("double")), 6).alias("churn_rate"))


PIVOT_METRICS = ["total_rech_amt", "total_ic_mou", "total_og_mou", "vol_2g_mb"]


@register("s2_pivot_usage", with_fx(
    "select customer_id, " + ", ".join(f"{m}_{mo}" for m in PIVOT_METRICS for mo in (6, 7, 8, 9)) + " from fx2",
    "fx2"))
def s2_pivot_usage(spark, sf_dir):
    """S2 long -> wide: one (customer, metric, month, value) row per order and metric,
    pivoted to one column per metric and month."""
    from churnkit.sources.accounts import pivot_usage
    from churnkit.sources.tables import load

    o = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    year = F.year("o_orderdate")
    month = F.when(year == 1998, 6).when(year == 1999, 7).when(year == 2000, 8).when(year == 2001, 9)
    long = o.select(F.col("o_custkey").alias("customer_id"), month.alias("month"), F.explode(F.array(
        F.struct(F.lit("total_rech_amt").alias("metric"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")),
        F.struct(F.lit("total_ic_mou").alias("metric"),
                 F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("decimal(18,2)").alias("v")),
        F.struct(F.lit("total_og_mou").alias("metric"),
                 F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).cast("decimal(18,2)").alias("v")),
        F.struct(F.lit("vol_2g_mb").alias("metric"),
                 F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).cast("decimal(18,2)").alias("v")),
    )).alias("x")).filter(F.col("month").isNotNull()).select("customer_id", "month", "x.metric", "x.v")
    wide = pivot_usage(long, "customer_id", "metric", "month", "v", PIVOT_METRICS)
    wide = wide.select("customer_id", *[F.col(f"{m}_{mo}").cast("double").alias(f"{m}_{mo}")
                                        for m in PIVOT_METRICS for mo in (6, 7, 8, 9)])
    c = load(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "customer_id")
    return c.join(wide, "customer_id", "left")
