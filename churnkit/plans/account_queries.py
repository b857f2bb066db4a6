"""Registered queries on the account snapshot (FX1): C1-C3, C7, C8, C10, C11, F1-F7, P5, I1, I3."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.functions.columns import clip, col
from churnkit.operators import accounts as acc_ops
from churnkit.operators.clean import align_columns, clean_accounts, scale_with_stats, scaler_stats, to_numbers
from churnkit.operators.cohort import rate
from churnkit.operators.profile import profile, target_candidates
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.sources import fixtures

# Vocabulary the fixture produces (sorted, first dropped; tenure groups in bin order).
SQL_VOCAB = {
    "MultipleLines": ["No phone service", "Yes"],
    "InternetService": ["Fiber optic", "No"],
    **{c: ["No internet service", "Yes"] for c in
       ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]},
    "Contract": ["One year", "Two year"],
    "PaymentMethod": ["Credit card (automatic)", "Electronic check", "Mailed check"],
    "TenureGroup": ["7-12mo", "13-24mo", "25-48mo", "49-72mo"],
}
ADDONS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]


def q(name):
    return '"' + name + '"'


def _yn(c):
    return f"case when {q(c)} = 'Yes' then 1 when {q(c)} = 'No' then 0 end as {q(c)}"


CLEAN_SQL = ("select \"customerID\", case when gender = 'Male' then 1 when gender = 'Female' then 0 end as gender, "
             "\"SeniorCitizen\", " + _yn("Partner") + ", " + _yn("Dependents") + ", tenure, " + _yn("PhoneService")
             + ", " + ", ".join(q(c) for c in ["MultipleLines", "InternetService"] + ADDONS + ["Contract"])
             + ", " + _yn("PaperlessBilling") + ", \"PaymentMethod\", \"MonthlyCharges\", "
             "coalesce(try_cast(\"TotalCharges\" as double), 0) as \"TotalCharges\", " + _yn("Churn") + " from acc")
TENURE_SQL = ("case when tenure > -1 and tenure <= 6 then '0-6mo' when tenure > 6 and tenure <= 12 then '7-12mo' "
              "when tenure > 12 and tenure <= 24 then '13-24mo' when tenure > 24 and tenure <= 48 then '25-48mo' "
              "when tenure > 48 and tenure <= 72 then '49-72mo' end")
COMBO_SQL = "cast(\"Contract\" = 'Month-to-month' and \"PaymentMethod\" = 'Electronic check' as integer)"
SERVICES_SQL = "(" + " + ".join(f"case when {q(c)} = 'Yes' then 1 else 0 end" for c in ADDONS) + ")"
AVG_SQL = "\"TotalCharges\" / nullif(tenure + 1, 0)"
FEAT_SQL = (f"select *, {AVG_SQL} as \"AvgMonthlySpend\", \"MonthlyCharges\" - {AVG_SQL} as \"ChargeIncrease\", "
            f"{SERVICES_SQL} as \"NumServices\", {TENURE_SQL} as \"TenureGroup\", {COMBO_SQL} as \"HighRiskCombo\", "
            "cast(tenure <= 3 as integer) as \"IsNewCustomer\" from clean")
SAVG_SQL = "\"TotalCharges\" / nullif(case when tenure = 0 then 1 else tenure end, 0)"
SERVING_SQL = (f"select *, {SAVG_SQL} as \"AvgMonthlySpend\", cast(\"MonthlyCharges\" > {SAVG_SQL} as integer) "
               f"as \"ChargeIncrease\", (coalesce(\"PhoneService\", 0) + {SERVICES_SQL}) as \"NumServices\", "
               f"cast(tenure < 6 as integer) as \"IsNewCustomer\", {COMBO_SQL} as \"HighRiskCombo\" from clean")
BASE_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
             "PaperlessBilling", "MonthlyCharges", "TotalCharges", "Churn"]
TRAIN_EXTRA = ["AvgMonthlySpend", "ChargeIncrease", "NumServices", "HighRiskCombo", "IsNewCustomer"]


def _dummy_sql(vocab):
    return ", ".join(f"case when {q(c)} = '{v}' then 1 else 0 end as {q(c + '_' + v)}"
                     for c, vs in vocab.items() for v in vs)


ENC_SQL = ("select " + ", ".join(q(c) for c in BASE_COLS + TRAIN_EXTRA) + ", " + _dummy_sql(SQL_VOCAB)
           + " from feat")
ACC_CTES = [("clean", CLEAN_SQL), ("feat", FEAT_SQL), ("enc", ENC_SQL)]
TRAIN_FEATURES = [c for c in BASE_COLS + TRAIN_EXTRA if c not in ("customerID", "Churn")] + [
    f"{c}_{v}" for c, vs in SQL_VOCAB.items() for v in vs]


def accounts(spark, sf_dir):
    return fixtures.accounts(spark, sf_dir)


@register("c1_to_number", with_fx(
    "select \"customerID\", coalesce(try_cast(\"TotalCharges\" as double), 0) as \"TotalCharges\" from acc", "acc"))
def c1_to_number(spark, sf_dir):
    return to_numbers(accounts(spark, sf_dir), ["TotalCharges"]).select("customerID", "TotalCharges")


@register("c2_c3_encode_values", with_fx(
    "select \"customerID\", gender, \"SeniorCitizen\", \"Partner\", \"Dependents\", \"PhoneService\", "
    "\"PaperlessBilling\", \"Churn\" from clean", "acc", extra=ACC_CTES[:1]))
def c2_c3_encode_values(spark, sf_dir):
    return clean_accounts(accounts(spark, sf_dir)).select(
        "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService",
        "PaperlessBilling", "Churn")


@register("f1_f6_snapshot_features", with_fx(
    "select \"customerID\", \"AvgMonthlySpend\", \"ChargeIncrease\", \"NumServices\", \"TenureGroup\", "
    "\"HighRiskCombo\", \"IsNewCustomer\" from feat", "acc", extra=ACC_CTES[:2]))
def f1_f6_snapshot_features(spark, sf_dir):
    return acc_ops.featurize_accounts(accounts(spark, sf_dir)).select(
        "customerID", "AvgMonthlySpend", "ChargeIncrease", "NumServices", "TenureGroup",
        "HighRiskCombo", "IsNewCustomer")


@register("f7_serving_features", with_fx(
    "select \"customerID\", \"AvgMonthlySpend\", \"ChargeIncrease\", \"NumServices\", \"IsNewCustomer\", "
    "\"HighRiskCombo\" from serving", "acc", extra=[ACC_CTES[0], ("serving", SERVING_SQL)]))
def f7_serving_features(spark, sf_dir):
    return acc_ops.featurize_accounts(accounts(spark, sf_dir), "serving").select(
        "customerID", "AvgMonthlySpend", "ChargeIncrease", "NumServices", "IsNewCustomer", "HighRiskCombo")


@register("c7_one_hot", with_fx("select * from enc", "acc", extra=ACC_CTES))
def c7_one_hot(spark, sf_dir):
    encoded, _ = acc_ops.encode_accounts(accounts(spark, sf_dir))
    return encoded


SERVING_ENC_SQL = ("select \"customerID\", " + ", ".join(
    (f"cast({q(c)} as double) as {q(c)}" if c in BASE_COLS + TRAIN_EXTRA else f"cast(0.0 as double) as {q(c)}")
    if not any(c == f"{k}_{v}" for k, vs in SQL_VOCAB.items() if k != "TenureGroup" for v in vs)
    else f"cast(case when {q(c.split('_', 1)[0])} = '{c.split('_', 1)[1]}' then 1 else 0 end as double) as {q(c)}"
    for c in TRAIN_FEATURES) + " from serving")


@register("c8_align_columns", with_fx(
    "select * from aligned", "acc",
    extra=[ACC_CTES[0], ("serving", SERVING_SQL), ("aligned", SERVING_ENC_SQL)]))
def c8_align_columns(spark, sf_dir):
    """Serving rows encoded with the training vocabulary, aligned to the training columns."""
    acc = accounts(spark, sf_dir)
    train, vocab = acc_ops.encode_accounts(acc)
    columns = acc_ops.feature_columns(train)
    serving, _ = acc_ops.encode_accounts(acc, vocab=vocab, variant="serving")
    return align_columns(serving, columns, keep=("customerID",))


@register("c10_clip", with_fx(
    "select \"customerID\", greatest(0, least(72, tenure)) as tenure_clipped, "
    "case when \"ChargeIncrease\" is null then null else greatest(-1.0, least(1.0, \"ChargeIncrease\" / 100000.0)) "
    "end as charge_increase_clipped from feat",
    "acc", extra=ACC_CTES[:2]))
def c10_clip(spark, sf_dir):
    f = acc_ops.featurize_accounts(accounts(spark, sf_dir))
    return f.select("customerID", clip("tenure", 0, 72).alias("tenure_clipped"),
                    clip(col("ChargeIncrease") / F.lit(100000.0), -1.0, 1.0).alias("charge_increase_clipped"))


SCALE = acc_ops.SCALE_COLUMNS


@register("c11_scaler_accounts", with_fx(
    "select \"customerID\", " + ", ".join(
        f"round((cast({q(c)} as double) - avg(cast({q(c)} as double)) over ()) / "
        f"coalesce(nullif(stddev_pop(cast({q(c)} as double)) over (), 0), 1.0), 9) as {q(c)}" for c in SCALE)
    + " from feat", "acc", extra=ACC_CTES[:2]))
def c11_scaler_accounts(spark, sf_dir):
    f = acc_ops.featurize_accounts(accounts(spark, sf_dir))
    scaled = scale_with_stats(f, scaler_stats(f, SCALE), SCALE)
    return scaled.select("customerID", *[F.round(col(c), 9).alias(c) for c in SCALE])


@register("c11_scaler_stats", with_fx(
    "select " + ", ".join(
        f"round(avg(cast({q(c)} as double)), 6) as {q('mean_' + c)}, "
        f"round(coalesce(nullif(stddev_pop(cast({q(c)} as double)), 0), 1.0), 6) as {q('scale_' + c)}"
        for c in SCALE) + " from feat", "acc", extra=ACC_CTES[:2]))
def c11_scaler_stats(spark, sf_dir):
    st = scaler_stats(acc_ops.featurize_accounts(accounts(spark, sf_dir)), SCALE)
    return st.select(*[F.round(c, 6).alias(c) for c in st.columns])


@register("p5_rate_accounts", with_fx(
    "select avg(cast(\"Churn\" as double)) as rate, count(*) as rows from clean", "acc", extra=ACC_CTES[:1]))
def p5_rate_accounts(spark, sf_dir):
    return rate(clean_accounts(accounts(spark, sf_dir)), "Churn")


_FX1_TYPES = [("customerID", "bigint"), ("gender", "string"), ("SeniorCitizen", "int"), ("Partner", "string"),
              ("Dependents", "string"), ("tenure", "int"), ("PhoneService", "string"),
              ("MultipleLines", "string"), ("InternetService", "string"), ("OnlineSecurity", "string"),
              ("OnlineBackup", "string"), ("DeviceProtection", "string"), ("TechSupport", "string"),
              ("StreamingTV", "string"), ("StreamingMovies", "string"), ("Contract", "string"),
              ("PaperlessBilling", "string"), ("PaymentMethod", "string"), ("MonthlyCharges", "double"),
              ("TotalCharges", "string"), ("Churn", "string")]


@register("i1_profile", with_fx(
    "select (select count(*) from acc) as rows, 21 as columns, t.position, t.column_name, t.data_type "
    "from (values " + ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(_FX1_TYPES))
    + ") t(position, column_name, data_type)", "acc"))
def i1_profile(spark, sf_dir):
    return profile(accounts(spark, sf_dir))


@register("i3_target_candidates", with_fx(
    "select 'Churn' as column_name, v as value, cast(row_number() over (order by v) as integer) as value_rank "
    "from (select distinct \"Churn\" as v from acc) where v is not null", "acc"))
def i3_target_candidates(spark, sf_dir):
    return target_candidates(accounts(spark, sf_dir))



@register("s1_csv_roundtrip", with_fx(
    "select \"customerID\", \"TotalCharges\", tenure, \"MonthlyCharges\", \"SeniorCitizen\", \"Contract\", "
    "\"PaymentMethod\", \"Churn\" from clean", "acc", extra=ACC_CTES[:1]))
def s1_csv_roundtrip(spark, sf_dir):
    """S1 + S3: the snapshot written as CSV, read back leniently, rejects split off, cleaned."""
    from churnkit.session import scratch_path
    from churnkit.sources.accounts import read_accounts, split_rejects

    path = scratch_path(spark, "accounts-csv")
    accounts(spark, sf_dir).write.option("header", True).csv(path)
    good, _ = split_rejects(read_accounts(spark, path, with_label=True))
    cleaned = clean_accounts(good.withColumn("customerID", F.col("customerID").cast("long")))
    return cleaned.select("customerID", "TotalCharges", "tenure", "MonthlyCharges", "SeniorCitizen", "Contract",
                          "PaymentMethod", "Churn")
