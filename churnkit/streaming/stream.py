"""Structured Streaming.

ST1 scores every uploaded snapshot file once.  Each micro-batch is written
with dynamic partition overwrite into partitions keyed by the epoch, so a
replayed epoch (after a failure between the write and the checkpoint
commit) replaces its own output instead of appending a second copy.
ST2 counts risk per 1-day tumbling and 7-day sliding window with a
watermark that bounds lateness and state.  ST3 drops repeated queue entries
of a customer within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit.operators import store
from churnkit.sources.accounts import CORRUPT, account_schema, split_rejects, type_accounts

Scorer = Callable[[DataFrame], DataFrame]


def _write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    keys = [c for c in ("ds",) if c in df.columns] + ["epoch"]
    (df.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def score_batch(batch: DataFrame, scorer: Scorer, threshold: float, batch_id: str,
                as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """One upload: (scored rows with level, rejected rows).  Ids are unique over uploads and over an
    account's repeats within one."""
    good, bad = split_rejects(type_accounts(batch))
    scored = scorer(good)
    again = F.row_number().over(Window.partitionBy("customerID").orderBy("churn_probability"))
    at = F.lit(as_of).cast("timestamp")
    preds = scored.select(F.lit(batch_id).alias("batch_id"), F.col("customerID").alias("customer_id"),
                          F.concat_ws("_", F.lit(batch_id), "customerID", again.cast("string")).alias("id"),
                          at.alias("timestamp"), F.to_date(at).alias("ds"), F.col("churn_probability"),
                          store.risk_level("churn_probability", threshold).alias("risk_level"),
                          *[c for c in ("top_factors", "recommended_action") if c in scored.columns])
    return preds, bad


def stream_scores(spark: SparkSession, in_dir: str, out_root: str, checkpoint: str, scorer: Scorer,
                  threshold: float = 0.5, available_now: bool = True, as_of: datetime | None = None):
    """ST1: score each new CSV file of ``in_dir`` exactly once into ``out_root``.

    All rows of a micro-batch carry one time: ``as_of`` or, by default, the
    time its latest file was uploaded, which a replay finds again.  The scored
    rows are written first; queue and metadata come from what was written, so
    the scorer runs once.  A batch without a valid row leaves a metadata row of
    zeros.
    """
    src = (spark.readStream.schema(account_schema()).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(in_dir)
           .select("*", F.col("_metadata.file_modification_time").alias("_uploaded")))
    root = out_root.rstrip("/")

    def each(batch: DataFrame, epoch_id: int) -> None:
        batch_id = f"stream_{epoch_id}"
        when = as_of or batch.agg(F.max("_uploaded")).first()[0]
        preds, bad = score_batch(batch.drop("_uploaded"), scorer, threshold, batch_id, when)
        _write_epoch(preds, f"{root}/predictions", epoch_id)
        _write_epoch(bad, f"{root}/rejects", epoch_id)
        written = spark.read.schema(preds.withColumn("epoch", F.lit(epoch_id)).schema).parquet(f"{root}/predictions").filter(
            F.col("epoch") == epoch_id).drop("epoch")
        _write_epoch(store.queue_rows(written), f"{root}/queue", epoch_id)
        this = spark.range(1).select(F.lit(batch_id).alias("batch_id"))
        meta = store.batch_summary(written, this)
        at = F.lit(when).cast("timestamp")
        meta = meta.withColumn("timestamp", F.coalesce(F.col("timestamp"), at) if "timestamp" in meta.columns else at)
        _write_epoch(meta.withColumn("ds", F.to_date("timestamp")), f"{root}/metadata", epoch_id)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def risk_events(df: DataFrame, ts: str = "ts", high: F.Column | None = None) -> DataFrame:
    """Event time as TIMESTAMP (watermarks need it) and a 0/1 high-risk flag."""
    flag = high if high is not None else (F.col("event_type") == "error")
    return df.select("*", F.col(ts).cast("timestamp").alias("event_time"), flag.cast("int").alias("high_risk"))


def window_counts(events: DataFrame, duration: str = "1 day", slide: str | None = None) -> DataFrame:
    """ST2 aggregate (works on a static or a streaming frame)."""
    w = F.window("event_time", duration, slide) if slide else F.window("event_time", duration)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"),
                                            F.sum("high_risk").alias("high_risk_events")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events", "high_risk_events")


def stream_counts(stream: DataFrame, delay: str = "1 day", duration: str = "1 day",
                  slide: str | None = None) -> DataFrame:
    """ST2: windowed counts with late rows accepted up to ``delay`` (append mode emits
    a window once the watermark passes its end)."""
    return window_counts(risk_events(stream).withWatermark("event_time", delay), duration, slide)


def stream_panes(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day", available_now: bool = True):
    """ST2 as a stream of one-day panes: the state is a row a day within ``delay``; rows later than that are dropped.

    Every micro-batch writes the panes that it changed, under its epoch; a
    replayed epoch replaces its own.  Read them with :func:`panes`.
    """
    counts = stream_counts(stream, delay)

    def each(batch: DataFrame, epoch_id: int) -> None:
        _write_epoch(batch, out, epoch_id)

    w = counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


PANE = "window_start timestamp_ntz, window_end timestamp_ntz, events bigint, high_risk_events bigint"


def panes(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every written pane."""
    rows = spark.read.schema(PANE + ", epoch bigint").parquet(path)
    last = F.max(F.struct("epoch", "window_end", "events", "high_risk_events")).alias("p")
    return rows.groupBy("window_start").agg(last).select("window_start", "p.window_end", "p.events", "p.high_risk_events")


def windows_of_panes(daily: DataFrame, days: int = 7) -> DataFrame:
    """Sliding windows of ``days`` days, one starting each day, added up from one-day panes: a pane counts in ``days`` windows."""
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    spread = daily.withColumn("_back", back).select(
        (F.col("window_start") - F.make_dt_interval(days=F.col("_back"))).alias("window_start"), "events", "high_risk_events")
    return spread.groupBy("window_start").agg(F.sum("events").alias("events"), F.sum("high_risk_events").alias("high_risk_events")).select(
        "window_start", (F.col("window_start") + F.make_dt_interval(days=F.lit(days))).alias("window_end"), "events", "high_risk_events")


def stream_dedupe(stream: DataFrame, key: str = "customer_id", ts: str = "timestamp",
                  delay: str = "1 day") -> DataFrame:
    """ST3: first queue entry per customer within the watermark delay."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark([key]))
