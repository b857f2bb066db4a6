"""Streaming: stream equals batch, replays add nothing, lateness is bounded, de-duplication."""

import datetime
import os

from pyspark.sql import functions as F

from churnkit.operators import explain as ex
from churnkit.operators.accounts import encode_accounts
from churnkit.plans.explain_queries import BUNDLE_VOCAB
from churnkit.sources import fixtures
from churnkit.sources.accounts import read_accounts, split_rejects
from churnkit.streaming.stream import score_batch, stream_counts, stream_dedupe, stream_scores, window_counts, \
    risk_events

SF = "/root/testdata/sf0.001"


def scorer(df):
    enc, _ = encode_accounts(df, vocab=BUNDLE_VOCAB)
    s = ex.linear_contributions(enc, ex.fixture_linear_score())
    return s.select("customerID", "churn_probability",
                    ex.top_factors(F.col("contribs"), 3).alias("top_factors"))


def _write_uploads(spark, d):
    acc = fixtures.accounts(spark, SF).drop("Churn").withColumn("customerID", F.col("customerID").cast("string"))
    a, b = acc.filter(F.col("customerID").cast("long") % 2 == 0), acc.filter(F.col("customerID").cast("long") % 2 == 1)
    a.coalesce(1).write.option("header", True).csv(os.path.join(d, "in", "a"))
    b.coalesce(1).write.option("header", True).csv(os.path.join(d, "in", "b"))
    # one malformed upload line: a field short, like a broken export
    bad = os.path.join(d, "in", "c")
    os.makedirs(bad)
    header = ",".join(acc.columns)
    with open(os.path.join(bad, "part-bad.csv"), "w") as fh:
        fh.write(header + "\n")
        fh.write("BAD1,Male,0,Yes,No,5,Yes,No,No,No,No,No,No,No,Month-to-month,Yes,Electronic check,70.5\n")
    return acc


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    d = str(tmp_path)
    acc = _write_uploads(spark, d)
    import glob
    import shutil
    flat = os.path.join(d, "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(glob.glob(os.path.join(d, "in", "*", "*.csv")))):
        shutil.copy(f, os.path.join(flat, f"upload_{i}.csv"))
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    q = stream_scores(spark, flat, out, ck, scorer, threshold=0.5)
    q.awaitTermination(300)
    preds = spark.read.parquet(os.path.join(out, "predictions"))
    rejects = spark.read.parquet(os.path.join(out, "rejects"))
    assert preds.count() == acc.count()
    assert rejects.count() == 1
    batch = scorer(split_rejects(read_accounts(spark, flat))[0])
    got = {r["customer_id"]: r["churn_probability"] for r in preds.collect()}
    want = {r["customerID"]: r["churn_probability"] for r in batch.collect()}
    assert got == want
    # same checkpoint again: nothing new is read, nothing is written twice
    q2 = stream_scores(spark, flat, out, ck, scorer, threshold=0.5)
    q2.awaitTermination(300)
    assert spark.read.parquet(os.path.join(out, "predictions")).count() == acc.count()


def test_an_upload_without_valid_rows_leaves_a_metadata_row(spark, tmp_path):
    d = str(tmp_path)
    _write_uploads(spark, d)
    os.makedirs(f"{d}/only")
    os.link(f"{d}/in/c/part-bad.csv", f"{d}/only/x.csv")
    stream_scores(spark, f"{d}/only", f"{d}/out", f"{d}/ck", scorer).awaitTermination(300)
    (meta,) = spark.read.parquet(f"{d}/out/metadata").collect()
    assert meta["total_customers"] == 0 and meta["batch_id"] == "stream_0" and meta["timestamp"] is not None
    assert spark.read.parquet(f"{d}/out/rejects").count() == 1


def test_epoch_replay_overwrites_its_partition(spark, tmp_path):
    from churnkit.streaming.stream import _write_epoch

    acc = fixtures.accounts(spark, SF).drop("Churn").select([F.col(c).cast("string") for c in
                                                             fixtures.accounts(spark, SF).drop("Churn").columns])
    preds, _ = score_batch(acc.withColumn("_corrupt_record", F.lit(None).cast("string")), scorer, 0.5, "stream_7",
                           datetime.datetime(2024, 3, 1))
    path = str(tmp_path / "preds")
    _write_epoch(preds, path, 7)
    _write_epoch(preds, path, 7)  # replayed epoch
    assert spark.read.parquet(path).count() == acc.count()


def _event_stream(spark, tmp_path, frames):
    src = str(tmp_path / "events")
    for i, f in enumerate(frames):
        f.write.mode("append").parquet(os.path.join(src, f"batch={i}"))
    return src


def test_window_counts_bounded_lateness(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "user_id")
    early = ev.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    late = ev.filter(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))  # re-sent old rows
    src = str(tmp_path / "ev")
    early.write.parquet(os.path.join(src, "f1"))
    schema = early.schema
    sink = str(tmp_path / "sink")
    ck = str(tmp_path / "ck")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        q = (stream_counts(s, delay="1 day").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", ck).trigger(availableNow=True).start(sink))
        q.awaitTermination(300)

    run()
    late.write.parquet(os.path.join(src, "f2"))
    run()
    got = {r["window_start"]: r["events"] for r in spark.read.parquet(sink).collect()}
    static = {r["window_start"]: r["events"] for r in window_counts(risk_events(early), "1 day").collect()}
    # emitted windows are closed ones, and the late copies of early days were dropped
    assert got and all(got[k] == static[k] for k in got)


def test_dedupe_within_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00"),
            (2, "2024-01-01 03:00:00"), (3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "customer_id int, timestamp string").withColumn(
        "timestamp", F.to_timestamp("timestamp"))
    src = str(tmp_path / "q")
    df.write.parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    sink, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = stream_dedupe(s, delay="1 day").writeStream.format("parquet").option("checkpointLocation", ck) \
        .trigger(availableNow=True).start(sink)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert sorted(r["customer_id"] for r in out.collect()) == [1, 2, 3]
