"""Input shapes of the churn operators, derived from the driver tables.

FX1 account snapshot, FX2 monthly usage (wide), FX3 scored rows, FX4
prediction / queue rows.  The derivations follow ``FIXTURES.md`` section 2 and
are written as DataFrame plans that stay partial-aggregated and skew-safe:

* per-customer figures are one hash aggregate (map-side combine), so a
  customer owning a third of all orders costs one combined row per mapper;
* "latest order" facts use ``row_number() <= 2``, which Spark plans as a
  partial ``WindowGroupLimit`` before the shuffle (at most two rows per key
  and mapper leave the map side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit.sources.tables import load

# Fixed values of the fixture definition (FIXTURES.md 2.1, 2.2, 2.4).
TENURE_ORIGIN_YEAR = 2001
TENURE_ORIGIN_MONTH = 8
CHURN_CUTOFF = "2001-03-01 00:00:00"
PERIOD_YEARS = {1998: 6, 1999: 7, 2000: 8, 2001: 9}
AS_OF = "2001-08-01 00:00:00"

# Reference column names of the account snapshot, in file order, with the
# snake-case names the fixture SQL uses.
ACCOUNT_COLUMNS = [
    ("customer_id", "customerID"), ("gender", "gender"),
    ("senior_citizen", "SeniorCitizen"), ("partner", "Partner"),
    ("dependents", "Dependents"), ("tenure", "tenure"),
    ("phone_service", "PhoneService"), ("multiple_lines", "MultipleLines"),
    ("internet_service", "InternetService"), ("online_security", "OnlineSecurity"),
    ("online_backup", "OnlineBackup"), ("device_protection", "DeviceProtection"),
    ("tech_support", "TechSupport"), ("streaming_tv", "StreamingTV"),
    ("streaming_movies", "StreamingMovies"), ("contract", "Contract"),
    ("paperless_billing", "PaperlessBilling"), ("payment_method", "PaymentMethod"),
    ("monthly_charges", "MonthlyCharges"), ("total_charges_raw", "TotalCharges"),
    ("churn", "Churn"),
]


def _eq(column: str, value: str) -> str:
    return f"{column} = '{value}'"


def _orders(spark, sf_dir, *cols):
    return load(spark, sf_dir, "orders", *cols)


def accounts_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1 with the fixture's snake-case column names.

    Expressions are passed as SQL text (one JVM call each) rather than built
    node by node from Python.
    """
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus",
                "o_totalprice", "o_orderdate", "o_orderpriority")
    prios = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    per_cust = o.groupBy("o_custkey").agg(
        F.expr("min(o_orderdate) as first_date"), F.expr("max(o_orderdate) as last_date"),
        F.expr("sum(cast(o_totalprice as decimal(18,2))) as total_dec"),
        *[F.expr(f"max(case when {_eq('o_orderpriority', p)} then 1 else 0 end) as s{i}")
          for i, p in enumerate(prios, 1)])
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last_two = (o.withColumn("rn", F.row_number().over(latest)).filter("rn <= 2")
                .groupBy("o_custkey").agg(
                    F.expr("max(case when rn = 1 then o_totalprice end) as monthly_charges"),
                    F.expr("max(case when rn = 1 then o_orderpriority end) as last_priority"),
                    F.expr("max(case when o_orderstatus = 'P' then 1 else 0 end) as s6")))
    g = per_cust.join(last_two, "o_custkey").selectExpr(
        "o_custkey",
        f"cast(({TENURE_ORIGIN_YEAR} - year(first_date)) * 12 + ({TENURE_ORIGIN_MONTH} - month(first_date)) as int)"
        " as tenure",
        "total_dec", "monthly_charges", "last_priority", "s1", "s2", "s3", "s4", "s5", "s6",
        f"case when last_date < cast('{CHURN_CUTOFF}' as timestamp_ntz) then 'Yes' else 'No' end as churn")
    c = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    def addon(flag):
        return (f"case when c_nationkey % 5 = 0 then 'No internet service' when {flag} = 1 then 'Yes' "
                "else 'No' end")

    return c.join(g, c.c_custkey == g.o_custkey, "left").selectExpr(
        "c_custkey as customer_id",
        "case when c_custkey % 97 = 0 then 'Other' when c_custkey % 2 = 0 then 'Male' else 'Female' end as gender",
        "case when c_custkey % 7 = 0 then 1 else 0 end as senior_citizen",
        "case when c_custkey % 3 = 0 then 'Yes' else 'No' end as partner",
        "case when c_custkey % 4 = 0 then 'Yes' else 'No' end as dependents",
        "case when c_custkey % 10 = 0 then 'No' else 'Yes' end as phone_service",
        "case when c_custkey % 10 = 0 then 'No phone service' when c_custkey % 3 = 1 then 'Yes' else 'No' end"
        " as multiple_lines",
        "case when c_nationkey % 5 = 0 then 'No' when c_nationkey % 5 <= 2 then 'Fiber optic' else 'DSL' end"
        " as internet_service",
        "case when c_acctbal >= 5000 then 'Yes' else 'No' end as paperless_billing",
        "coalesce(tenure, 0) as tenure",
        "monthly_charges",
        "case when c_custkey % 50 = 0 then ' ' else cast(cast(total_dec as decimal(18,2)) as string) end"
        " as total_charges_raw",
        "case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'Month-to-month' "
        "when c_mktsegment in ('MACHINERY', 'FURNITURE') then 'One year' else 'Two year' end as contract",
        "case when last_priority in ('1-URGENT', '2-HIGH') then 'Electronic check' "
        "when last_priority = '3-MEDIUM' then 'Mailed check' "
        "when last_priority = '4-NOT SPECIFIED' then 'Bank transfer (automatic)' "
        "else 'Credit card (automatic)' end as payment_method",
        f"{addon('s1')} as online_security", f"{addon('s2')} as online_backup",
        f"{addon('s3')} as tech_support", f"{addon('s4')} as device_protection",
        f"{addon('s5')} as streaming_tv", f"{addon('s6')} as streaming_movies",
        "coalesce(churn, 'Yes') as churn")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1 under the account-snapshot column names of the reference."""
    return accounts_snake(spark, sf_dir).selectExpr(*[f"{s} as `{r}`" for s, r in ACCOUNT_COLUMNS])


def usage_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: one row per subscriber, one column per metric and month 6..9."""
    o = _orders(spark, sf_dir, "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    ph = " ".join(f"when {y} then {m}" for y, m in PERIOD_YEARS.items())
    p = o.selectExpr("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                     f"case year(o_orderdate) {ph} end as ph")

    def count_if(m, cond, zero_when_present=True):
        zero = f" when ph = {m} then 0" if zero_when_present else ""
        return f"cast(sum(case when ph = {m} and {cond} then 1{zero} end) as double)"

    aggs = []
    for m in (6, 7):
        aggs.append(f"{count_if(m, _eq('o_orderpriority', '1-URGENT'), False)} as total_rech_data_{m}")
        aggs.append(f"max(case when ph = {m} and o_orderpriority = '1-URGENT' then o_totalprice end)"
                    f" as av_rech_amt_data_{m}")
    for m in (6, 7, 8, 9):
        aggs.append(f"{count_if(m, _eq('o_orderpriority', '5-LOW'))} as vol_3g_mb_{m}")
    for m in (6, 7, 8):
        aggs.append(f"max(case when ph = {m} and o_orderpriority = '2-HIGH' then 1.0D end) as fb_user_{m}")
    for m in (6, 7, 8, 9):
        aggs.append(f"cast(sum(case when ph = {m} then cast(o_totalprice as decimal(18,2)) end) as double)"
                    f" as total_rech_amt_{m}")
    for name, st in (("total_ic_mou", "F"), ("total_og_mou", "O"), ("vol_2g_mb", "P")):
        for m in (6, 7, 8, 9):
            aggs.append(f"{count_if(m, _eq('o_orderstatus', st))} as {name}_{m}")
    w = p.groupBy("o_custkey").agg(*[F.expr(a) for a in aggs])
    c = load(spark, sf_dir, "customer", "c_custkey")
    order = (["total_rech_amt_6", "total_rech_amt_7", "total_rech_amt_8", "total_rech_amt_9"]
             + [f"{n}_{m}" for n in ("total_ic_mou", "total_og_mou", "vol_2g_mb") for m in (6, 7, 8, 9)]
             + ["total_rech_data_6", "av_rech_amt_data_6", "total_rech_data_7", "av_rech_amt_data_7"]
             + [f"vol_3g_mb_{m}" for m in (6, 7, 8, 9)] + ["fb_user_6", "fb_user_7", "fb_user_8"])
    return c.join(w, c.c_custkey == w.o_custkey, "left").selectExpr("c_custkey as customer_id", *order)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: binary label and a tied score per order."""
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderstatus")
    is_f = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(is_f, 1).otherwise(0).alias("label"),
        (((F.col("o_orderkey") * 7919 + 104729) % 701 + F.when(is_f, 300).otherwise(0))
         .cast("double") / 1000).alias("prob"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: one batch per order year, with queue status and timestamps."""
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return o.select(
        F.concat(F.lit("batch_"), F.year("o_orderdate").cast("string")).alias("batch_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("ts"),
        (((F.col("o_orderkey") * 7919 + 104729) % 1001).cast("double") / 1000).alias("churn_probability"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "contacted")
         .otherwise("resolved").alias("status"))
