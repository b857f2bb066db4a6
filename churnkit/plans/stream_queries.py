"""Window counts over ``events`` (ST2): as one aggregate, and as a stream of panes in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.plans.registry import register
from churnkit.session import scratch_path
from churnkit.sources.tables import load
from churnkit.streaming.stream import panes, risk_events, stream_panes, window_counts, windows_of_panes

SLICES = 4
DAILY_SQL = """
select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
       count(*) as events, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as high_risk_events
from events group by 1, 2
"""
WEEKLY_SQL = """
select window_start, window_start + interval 7 day as window_end, cast(count(*) as bigint) as events,
       cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as high_risk_events
from (select event_type, date_trunc('day', ts) - to_days(cast(k as integer)) as window_start
      from events, range(7) t(k))
group by window_start
"""


@register("st2_daily_risk_counts", DAILY_SQL)
def st2_daily_risk_counts(spark, sf_dir):
    return window_counts(risk_events(load(spark, sf_dir, "events", "ts", "event_type")), "1 day")


@register("st2_weekly_sliding_counts", WEEKLY_SQL)
def st2_weekly_sliding_counts(spark, sf_dir):
    return window_counts(risk_events(load(spark, sf_dir, "events", "ts", "event_type")), "7 days", "1 day")


def _streamed(spark, sf_dir):
    """All events through the stream, slice of time by slice of time, one file set a micro-batch."""
    e = load(spark, sf_dir, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, "event-stream")
    ends = e.agg(F.unix_seconds(F.min("ts")).alias("a"), F.unix_seconds(F.max("ts")).alias("b")).first()
    width = ((ends["b"] or 0) - (ends["a"] or 0)) // SLICES + 1
    at = F.floor((F.unix_seconds("ts") - F.lit(ends["a"] or 0)) / width)
    for i in range(SLICES):
        e.filter(at == i).write.parquet(f"{root}/in/slice{i}")
        stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{root}/in/*")
        stream_panes(stream, f"{root}/panes", f"{root}/progress").awaitTermination()  # goes on where the last run ended
    return panes(spark, f"{root}/panes")


@register("st2_stream_daily", DAILY_SQL)
def st2_stream_daily(spark, sf_dir):
    return _streamed(spark, sf_dir)


@register("st2_stream_weekly", WEEKLY_SQL)
def st2_stream_weekly(spark, sf_dir):
    """The weekly windows added up from the stream's one-day panes."""
    return windows_of_panes(_streamed(spark, sf_dir))
