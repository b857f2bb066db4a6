"""Prediction tables and the follow-up queue.

The reference keeps four mutable SQLite tables.  Here every table is an
append-only Parquet dataset partitioned by day; queue status changes are an
append-only update log that is folded in at read time (or compacted into a
new snapshot), so readers never see a file rewritten under them and a replay
of the same inputs gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.columns import col, qi, sql_lit
from churnkit.operators.joins import salted_join

HIGH_CUTOFF = 0.6  # probability above which a customer is High risk
HIGH, MEDIUM, LOW = "High", "Medium", "Low"
PENDING, CONTACTED, RESOLVED = "pending", "contacted", "resolved"
STATUSES = (PENDING, CONTACTED, RESOLVED)


def risk_level(prob, threshold) -> F.Column:
    """> 0.6 High, > threshold Medium, else Low."""
    if isinstance(prob, str) and not isinstance(threshold, F.Column):
        return F.expr(f"case when {qi(prob)} > {HIGH_CUTOFF}D then '{HIGH}' when {qi(prob)} > "
                      f"{sql_lit(float(threshold))} then '{MEDIUM}' else '{LOW}' end")
    p = col(prob) if isinstance(prob, str) else prob
    t = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    return F.when(p > HIGH_CUTOFF, HIGH).when(p > t, MEDIUM).otherwise(LOW)


def with_risk_level(df: DataFrame, threshold, prob: str = "churn_probability", out: str = "risk_level") -> DataFrame:
    return df.withColumn(out, risk_level(prob, threshold))


def level_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """High / Medium / Low counts of a batch in one aggregate."""
    lv = col(level)
    return df.agg(F.count_if(lv == HIGH).alias("high_risk"), F.count_if(lv == MEDIUM).alias("medium_risk"),
                  F.count_if(lv == LOW).alias("low_risk"))


def queue_rows(preds: DataFrame, ts: str = "timestamp", level: str = "risk_level") -> DataFrame:
    """Q1/Q2: the High rows of a prediction frame as new pending queue entries."""
    high = preds.filter(f"{qi(level)} = '{HIGH}'")
    keep = [c for c in preds.columns if c not in ("status", "follow_up_notes", "last_updated", "batch_id")]
    return high.selectExpr(*[qi(c) for c in keep], f"'{PENDING}' as status",
                           "cast(null as string) as follow_up_notes", f"{qi(ts)} as last_updated")


def batch_summary(preds: DataFrame, batches: DataFrame | None = None, batch: str = "batch_id",
                  prob: str = "churn_probability", level: str = "risk_level", ts: str = "timestamp") -> DataFrame:
    """Q3: per batch total, High, Medium, other (= Low), mean probability.

    ``batches`` (one column ``batch_id``) lists every uploaded batch; a batch
    with no rows gets zeros, as the reference writes for an empty upload.
    """
    lv = col(level)
    summary = preds.groupBy(col(batch).alias("batch_id")).agg(
        F.max(col(ts)).alias("timestamp"),
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(lv == HIGH).alias("high_risk_count"),
        F.count_if(lv == MEDIUM).alias("medium_risk_count"),
        F.count_if((lv != HIGH) & (lv != MEDIUM)).alias("low_risk_count"),
        F.avg(col(prob)).alias("avg_churn_probability"))
    if batches is None:
        return summary
    return batches.select(col(batch).alias("batch_id")).distinct().join(summary, "batch_id", "left").select(
        "batch_id", "timestamp",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
          ("total_customers", "high_risk_count", "medium_risk_count", "low_risk_count")],
        F.coalesce(F.col("avg_churn_probability"), F.lit(0.0)).alias("avg_churn_probability"))


def recent(df: DataFrame, n: int = 100, ts: str = "timestamp", tiebreak: str = "id") -> DataFrame:
    """Q4: the latest n rows (ties by id descending); planned as a top-k."""
    return df.orderBy(col(ts).desc(), col(tiebreak).desc()).limit(n)


def batch_rows(df: DataFrame, batch_id: str | None, n: int = 100, ts: str = "timestamp",
               tiebreak: str = "id") -> DataFrame:
    """Q5: every row of one batch (the limit does not apply), else the latest n."""
    if batch_id:
        return df.filter(col("batch_id") == batch_id).orderBy(col(ts).desc(), col(tiebreak).desc())
    return recent(df, n, ts, tiebreak)


def recent_batches(meta: DataFrame, n: int = 50) -> DataFrame:
    """Q6: latest n batch metadata rows."""
    return meta.orderBy(F.col("timestamp").desc(), F.col("batch_id").desc()).limit(n)


def queue(df: DataFrame, status: str | None = PENDING, n: int = 100,
          columns: list[str] | None = None) -> DataFrame:
    """Q7: queue by status (falsy -> all), probability then time descending, top n."""
    q = df.filter(F.col("status") == status) if status else df
    q = q.orderBy(F.col("churn_probability").desc(), F.col("timestamp").desc(), F.col("id").desc()).limit(n)
    return q.select(*columns) if columns else q


def apply_updates(queue_df: DataFrame, updates: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Q8: fold an append-only status log into the queue.

    ``updates``: customer_id, status, follow_up_notes, ts, update_id.  An
    update applies to every queue row of its customer that existed at update
    time (row timestamp <= update ts).  Per customer only two facts are needed
    -- the latest update and the latest one with a non-empty note -- so the
    fold is one partial aggregate (a hot customer costs one row per mapper)
    and one join, salted for customers holding a large share of the queue;
    no pairs of updates and rows are formed.
    """
    return apply_facts(queue_df, update_facts(updates, customer), customer)


def update_facts(updates: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Per customer (``_cust``) the last update ``u`` and the last one with a note ``n``, as structs that hold all that
    orders them: the facts of two logs put together are the larger ones of each customer's."""
    # a total order: duplicate log rows (same ts and id) tie-break on their content
    order = F.struct(F.col("ts"), F.col("update_id"), F.col("status"), F.col("follow_up_notes"))
    noted = F.when(F.length(F.coalesce(F.col("follow_up_notes"), F.lit(""))) > 0, order)
    return updates.groupBy(col(customer).alias("_cust")).agg(F.max(order).alias("u"), F.max(noted).alias("n"))


def merge_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("_cust").agg(F.max("u").alias("u"), F.max("n").alias("n"))


def apply_facts(queue_df: DataFrame, facts: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Q8: the queue with the facts of its update log folded in."""
    latest = facts.select("_cust", F.col("u.ts").alias("u_ts"), F.col("u.status").alias("u_status"),
                          F.col("n.ts").alias("n_ts"), F.col("n.follow_up_notes").alias("n_notes"))
    # a customer holding a large share of the queue is spread over several tasks
    j = salted_join(queue_df, latest, customer, "_cust", "left")
    applies = "(u_ts is not null and u_ts >= `timestamp`)"
    note_applies = "(n_ts is not null and n_ts >= `timestamp`)"
    out = []
    for c in queue_df.columns:
        if c == "status":
            out.append(f"case when {applies} then u_status else status end as status")
        elif c == "follow_up_notes":
            out.append(f"case when {note_applies} then n_notes else follow_up_notes end as follow_up_notes")
        elif c == "last_updated":
            out.append(f"case when {applies} then u_ts else last_updated end as last_updated")
        else:
            out.append(qi(c))
    return j.selectExpr(*out)


def retain(df: DataFrame, as_of: str, days: int, ts: str = "timestamp",
           queue_table: bool = False) -> DataFrame:
    """Q9: what survives ``clear_old_data(days)`` at ``as_of``.

    Predictions and metadata older than the cutoff go; queue rows go only when
    resolved and last updated before the cutoff.  On day-partitioned tables
    the filter prunes whole partitions (see :func:`compact_retention`).
    """
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    if queue_table:
        return df.filter(~((F.col("status") == RESOLVED) & (F.col("last_updated") < cutoff)))
    return df.filter(col(ts) >= cutoff)


def dedupe_queue(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Q10: newest queue row per customer.

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before
    the shuffle, so a customer with many rows sends one row per mapper.
    """
    w = Window.partitionBy(col(customer)).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def dashboard(single: DataFrame, batch: DataFrame, queue_df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """H1: six counts as one row: one aggregate per table, one-row cross joins."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    s = single.agg(F.count(F.lit(1)).alias("total_single_predictions"))
    b = batch.agg(F.count(F.lit(1)).alias("total_batch_predictions"))
    st = F.col("status")
    q = queue_df.agg(F.count_if(st == PENDING).alias("pending_risks"),
                     F.count_if(st == CONTACTED).alias("contacted_risks"),
                     F.count_if(st == RESOLVED).alias("resolved_risks"),
                     F.count_if((st == PENDING) & (F.col("timestamp") >= since)).alias("recent_high_risk_7days"))
    return s.crossJoin(b).crossJoin(q)


def latest_batch_rows(preds: DataFrame, meta: DataFrame) -> DataFrame:
    """H2: detail rows of the most recent batch in the history."""
    latest = meta.agg(F.max_by("batch_id", F.struct("timestamp", "batch_id")).alias("_latest"))
    return preds.join(F.broadcast(latest), F.col("batch_id") == F.col("_latest")).drop("_latest")


def compact_retention(spark, src: str, dst: str, as_of: str, days: int, queue_table: bool = False,
                      date_col: str = "ds") -> str:
    """Q9 on stored tables: write the surviving rows to a new snapshot folder.

    Partitions entirely older than the cutoff are never read (the filter on
    the partition column prunes them); the source is left untouched, so
    readers of the old snapshot are safe.  Returns ``dst``, the new pointer.
    """
    df = spark.read.parquet(src)
    cutoff_day = F.to_date(F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
    if not queue_table and date_col in df.columns:
        df = df.filter(F.col(date_col) >= cutoff_day)  # partition pruning
    kept = retain(df, as_of, days, queue_table=queue_table)
    kept.write.mode("errorifexists").partitionBy(date_col).parquet(dst)
    return dst
