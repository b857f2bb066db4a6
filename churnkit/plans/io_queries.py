"""Registered queries on readers, sinks, stored tables and streams: S3-S5, S8, C9, W1, ST1, ST3."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from churnkit.operators import explain as ex
from churnkit.operators.accounts import encode_accounts
from churnkit.operators.clean import as_vector
from churnkit.operators.counterfactual import scenarios
from churnkit.plans.account_queries import ACC_CTES
from churnkit.plans.explain_queries import BUNDLE_VOCAB, SCEN_VALUES
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.session import scratch_path
from churnkit.sources import fixtures
from churnkit.sources.accounts import ensure_id, read_accounts, read_usage, sequential_index, split_rejects
from churnkit.sources.sinks import write_predictions, write_report
from churnkit.sources.tables import load
from churnkit.streaming.stream import stream_dedupe, stream_scores


def _upload(spark, sf_dir):
    acc = fixtures.accounts(spark, sf_dir).drop("Churn")
    return acc.select(*[F.col(c).cast("string").alias(c) for c in acc.columns])


@register("s3_rejects", with_fx(
    "select cast(\"customerID\" as varchar) as \"customerID\", cast(\"customerID\" as bigint) % 10 = 0 as rejected from clean", "acc", extra=ACC_CTES[:1]))
def s3_rejects(spark, sf_dir):
    """Snapshot lines of which every tenth is two fields short: accepted and rejected rows."""
    rows = _upload(spark, sf_dir)
    cells = [F.coalesce(F.col(c), F.lit("")) for c in rows.columns]
    line = F.when(F.col("customerID").cast("long") % 10 == 0, F.concat_ws(",", *cells[:-2])).otherwise(F.concat_ws(",", *cells))
    path = scratch_path(spark, "broken-csv")
    header = ",".join(rows.columns)

    def headed(batches):  # each task's lines become a file, which starts with the header
        for i, b in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=b.schema)
            yield b

    rows.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)
    good, bad = split_rejects(read_accounts(spark, path))
    return good.select("customerID", F.lit(False).alias("rejected")).unionByName(bad.select("customerID", F.lit(True).alias("rejected")))


@register("s4_row_ids", "select 'row_' || (row_number() over (order by o_orderkey) - 1) as \"customerID\", o_orderkey from orders")
def s4_row_ids(spark, sf_dir):
    """A table without ids in several files of different size: rows are numbered file by file."""
    path = scratch_path(spark, "no-ids")
    load(spark, sf_dir, "orders", "o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(path)
    return ensure_id(spark.read.schema("o_orderkey long").csv(path))


USAGE_METRICS = ["total_rech_amt", "total_ic_mou", "total_og_mou", "vol_2g_mb"]
USAGE_COLUMNS = [f"{m}_{month}" for m in USAGE_METRICS for month in (6, 7, 8, 9)]


@register("s2_mixed_headers", with_fx(
    "select cast(customer_id as varchar) as customer_id, " + ", ".join(
        c if not c.endswith("_9") else f"case when customer_id % 3 <> 2 then {c} end as {c}" for c in USAGE_COLUMNS) + " from fx2", "fx2"))
def s2_mixed_headers(spark, sf_dir):
    """Usage files of three headers: two column orders, and one that lacks the last month."""
    wide = fixtures.usage_wide(spark, sf_dir)
    root = scratch_path(spark, "usage-csv")
    for part, names in enumerate((USAGE_COLUMNS, USAGE_COLUMNS[::-1], [c for c in USAGE_COLUMNS[3:] + USAGE_COLUMNS[:3] if not c.endswith("_9")])):
        order = [*names, "customer_id"] if part else ["customer_id", *names]
        wide.filter(F.col("customer_id") % 3 == part).select(*order).write.option("header", True).csv(f"{root}/part{part}")
    return read_usage(spark, f"{root}/*").select("customer_id", *USAGE_COLUMNS)


@register("s5_report", """select row_number() over (order by p desc, c_custkey) - 1 as position, c_custkey, p as churn_probability, 'a, b' as factors
from (select c_custkey, (c_custkey * 37 % 1000) / 1000.0::double as p from customer)""")
def s5_report(spark, sf_dir):
    """The risk report written as CSV and read back in file order."""
    rows = load(spark, sf_dir, "customer", "c_custkey").select(
        "c_custkey", (F.col("c_custkey") * 37 % 1000 / F.lit(1000.0)).alias("churn_probability"),
        F.array(F.lit("a"), F.lit("b")).alias("factors"))
    path = scratch_path(spark, "report")
    write_report(rows, path)
    back = spark.read.schema("c_custkey long, churn_probability double, factors string").option("header", True).csv(path)
    return sequential_index(back, "position").select("position", "c_custkey", "churn_probability", "factors")


@register("s8_prediction_table", """select date_trunc('month', o_orderdate)::date as ds, count(*) as rows, min(o_orderkey) as first_id, max(o_orderkey) as last_id
from orders group by 1""")
def s8_prediction_table(spark, sf_dir):
    """Two appends to a table partitioned by date (here by month), read back by partition."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.trunc("o_orderdate", "month").alias("ds"))
    root = scratch_path(spark, "store")
    for half in (0, 1):
        write_predictions(rows.filter(F.col("id") % 2 == half), root, "predictions")
    return spark.read.parquet(f"{root}/predictions").groupBy("ds").agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("c9_as_vector", "select vec_id, 64 as n, cast(embedding[1] as double) as first_value, cast(embedding[64] as double) as last_value from embeddings")
def c9_as_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cols = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    v = as_vector(wide, cols).select("vec_id", vector_to_array("features").alias("a"))
    return v.select("vec_id", F.size("a").alias("n"), F.col("a")[0].alias("first_value"), F.col("a")[63].alias("last_value"))


@register("w1_scenarios", with_fx(
    f"""select "customerID", factor, col as "column", ord as "order", label, tval as text_value, cast(nval as double) as num_value
from clean, (values {SCEN_VALUES}) s(factor, col, ord, label, tval, nval)""", "acc", extra=ACC_CTES[:1]))
def w1_scenarios(spark, sf_dir):
    """The what-if table: every scenario of every account."""
    return fixtures.accounts(spark, sf_dir).select("customerID").crossJoin(F.broadcast(scenarios(spark)))  # 28 rows


def _scorer(df):
    enc, _ = encode_accounts(df, vocab=BUNDLE_VOCAB)
    scored = ex.linear_contributions(enc, ex.fixture_linear_score())
    return scored.select("customerID", "churn_probability", ex.top_factors(F.col("contribs"), 3).alias("top_factors"))


@register("st1_stream_scores", with_fx("""
select 'predictions' as "table", date '2024-03-01' as ds, count(*) as rows, count(*) as ids, true as consistent from clean
union all select 'metadata', date '2024-03-01', 1, 1, true
union all select 'rejects', null, 0, 0, true""", "acc", extra=ACC_CTES[:1]))
def st1_stream_scores(spark, sf_dir):
    """All accounts through the upload stream: rows and distinct ids of its tables; levels follow the
    probabilities, and the metadata's totals the predictions."""
    root = scratch_path(spark, "stream")
    _upload(spark, sf_dir).write.option("header", True).csv(f"{root}/in")
    stream_scores(spark, f"{root}/in", f"{root}/out", f"{root}/progress", _scorer, 0.5,
                  as_of=dt.datetime(2024, 3, 1, 12)).awaitTermination()
    preds = spark.read.parquet(f"{root}/out/predictions")
    p = F.col("churn_probability")
    level = F.when(p > 0.6, "High").when(p > 0.5, "Medium").otherwise("Low")
    meta = spark.read.parquet(f"{root}/out/metadata")
    totals = preds.agg(F.count(F.lit(1)).alias("n"))
    a = preds.groupBy("ds").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("risk_level") == level).alias("consistent"))
    b = meta.crossJoin(F.broadcast(totals)).groupBy("ds").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("ids"), F.bool_and(F.col("total_customers") == F.col("n")).alias("consistent"))
    # no row was rejected, so the table has no file yet
    c = spark.read.schema("customerID string, epoch int").parquet(f"{root}/out/rejects").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(None).cast("date").alias("ds"), "rows", F.col("rows").alias("ids"), F.lit(True).alias("consistent"))
    out = None
    for name, t in (("predictions", a), ("metadata", b), ("rejects", c)):
        t = t.select(F.lit(name).alias("table"), "ds", "rows", "ids", "consistent")
        out = t if out is None else out.unionByName(t)
    return out


@register("st3_first_entries", "select user_id as customer_id, count(*) > 0 as seen from events group by 1")
def st3_first_entries(spark, sf_dir):
    """Queue entries of all users as a stream, repeats within the watermark dropped: one row per user."""
    root = scratch_path(spark, "entries")
    e = load(spark, sf_dir, "events", "user_id", "ts").select(F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    e.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    (stream_dedupe(stream, delay="36500 days").writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").select("customer_id", F.lit(True).alias("seen"))
