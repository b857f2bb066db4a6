"""Registered queries on the prediction fixture (FX4): X2, X14, Q1-Q10, H1-H2."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.operators import store
from churnkit.operators.committed import CommittedStore
from churnkit.operators.facts import UpdateFacts
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.session import scratch_path
from churnkit.sources import fixtures
from churnkit.sources.tables import load

AS_OF = fixtures.AS_OF
THRESHOLD = 0.35       # decision threshold of the fixture batches
RETAIN_DAYS = 365
RECENT_DAYS = 7

BP_SQL = ("select batch_id, customer_id, id, ts as \"timestamp\", churn_probability, case when churn_probability "
          f"> 0.6 then 'High' when churn_probability > {THRESHOLD} then 'Medium' else 'Low' end as risk_level, "
          "status from fx4")
QUEUE_SQL = ("select id, customer_id, \"timestamp\", churn_probability, risk_level, status, "
             "cast(null as varchar) as follow_up_notes, \"timestamp\" as last_updated from bp where risk_level = 'High'")
SINGLE_SQL = ("select id, customer_id, \"timestamp\", churn_probability, risk_level from (select *, row_number() "
              "over (partition by customer_id order by \"timestamp\" desc, id desc) as rn from bp) where rn = 1")
UPD_SQL = ("select o_custkey as customer_id, l_shipdate as ts, case l_returnflag when 'R' then 'resolved' "
           "when 'A' then 'contacted' else 'pending' end as status, case when l_linenumber = 1 then "
           "'shipped order ' || cast(l_orderkey as varchar) else '' end as follow_up_notes, "
           "l_orderkey * 10 + l_linenumber as update_id from lineitem join orders on l_orderkey = o_orderkey")
APPLIED_SQL = (
    "select q.id, q.customer_id, q.\"timestamp\", q.churn_probability, q.risk_level, "
    "case when lu.u_ts is not null and lu.u_ts >= q.\"timestamp\" then lu.u_status else q.status end as status, "
    "case when ln.n_ts is not null and ln.n_ts >= q.\"timestamp\" then ln.n_notes else q.follow_up_notes end "
    "as follow_up_notes, case when lu.u_ts is not null and lu.u_ts >= q.\"timestamp\" then lu.u_ts "
    "else q.last_updated end as last_updated from queue q "
    "left join (select customer_id as c, ts as u_ts, status as u_status from (select *, row_number() over "
    "(partition by customer_id order by ts desc, update_id desc, status desc, follow_up_notes desc) as rn from upd) where rn = 1) lu "
    "on q.customer_id = lu.c left join (select customer_id as c, ts as n_ts, follow_up_notes as n_notes from "
    "(select *, row_number() over (partition by customer_id order by ts desc, update_id desc, status desc, follow_up_notes desc) as rn from upd "
    "where length(coalesce(follow_up_notes, '')) > 0) where rn = 1) ln on q.customer_id = ln.c")
META_SQL = ("select batch_id, max(\"timestamp\") as \"timestamp\", count(*) as total_customers, "
            "count(*) filter (where risk_level = 'High') as high_risk_count, "
            "count(*) filter (where risk_level = 'Medium') as medium_risk_count, "
            "count(*) filter (where risk_level <> 'High' and risk_level <> 'Medium') as low_risk_count, "
            "avg(churn_probability) as avg_churn_probability from bp group by batch_id")
CTES = [("bp", BP_SQL), ("queue", QUEUE_SQL), ("single", SINGLE_SQL), ("upd", UPD_SQL),
        ("applied", APPLIED_SQL), ("meta", META_SQL)]
CUTOFF_SQL = f"timestamp '{AS_OF}' - interval {RETAIN_DAYS} day"


def batch_predictions(spark, sf_dir):
    p = fixtures.predictions(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    return store.with_risk_level(p, THRESHOLD)


def queue_state(spark, sf_dir):
    """High rows of every batch, carrying the fixture's current status."""
    bp = batch_predictions(spark, sf_dir)
    return bp.filter(F.col("risk_level") == store.HIGH).select(
        "id", "customer_id", "timestamp", "churn_probability", "risk_level", "status",
        F.lit(None).cast("string").alias("follow_up_notes"), F.col("timestamp").alias("last_updated"))


def single_predictions(spark, sf_dir):
    bp = batch_predictions(spark, sf_dir)
    latest = store.dedupe_queue(bp)
    return latest.select("id", "customer_id", "timestamp", "churn_probability", "risk_level")


def updates_log(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "contacted")
         .otherwise("pending").alias("status"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("shipped order "), F.col("l_orderkey").cast("string")))
         .otherwise("").alias("follow_up_notes"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("update_id"))


def applied_queue(spark, sf_dir):
    return store.apply_updates(queue_state(spark, sf_dir), updates_log(spark, sf_dir))


def batch_meta(spark, sf_dir):
    return store.batch_summary(batch_predictions(spark, sf_dir))


@register("x2_risk_level", with_fx("select id, churn_probability, risk_level from bp", "fx4", extra=CTES[:1]))
def x2_risk_level(spark, sf_dir):
    return batch_predictions(spark, sf_dir).select("id", "churn_probability", "risk_level")


@register("x14_level_counts", with_fx(
    "select count(*) filter (where risk_level = 'High') as high_risk, count(*) filter (where risk_level = "
    "'Medium') as medium_risk, count(*) filter (where risk_level = 'Low') as low_risk from bp", "fx4", extra=CTES[:1]))
def x14_level_counts(spark, sf_dir):
    return store.level_counts(batch_predictions(spark, sf_dir))


@register("q1_record_single", with_fx(
    "select id, customer_id, \"timestamp\", churn_probability, risk_level, 'pending' as status, "
    "cast(null as varchar) as follow_up_notes, \"timestamp\" as last_updated from single where risk_level = 'High'",
    "fx4", extra=CTES[:3]))
def q1_record_single(spark, sf_dir):
    return store.queue_rows(single_predictions(spark, sf_dir))


@register("q2_record_batch", with_fx(
    "select customer_id, id, \"timestamp\", churn_probability, risk_level, 'pending' as status, "
    "cast(null as varchar) as follow_up_notes, \"timestamp\" as last_updated from bp where risk_level = 'High'",
    "fx4", extra=CTES[:1]))
def q2_record_batch(spark, sf_dir):
    bp = batch_predictions(spark, sf_dir).drop("status")
    return store.queue_rows(bp)


@register("q3_batch_summary", with_fx(
    "select batch_id, \"timestamp\", total_customers, high_risk_count, medium_risk_count, low_risk_count, "
    "round(avg_churn_probability, 9) as avg_churn_probability from meta", "fx4", extra=CTES))
def q3_batch_summary(spark, sf_dir):
    m = batch_meta(spark, sf_dir)
    return m.withColumn("avg_churn_probability", F.round("avg_churn_probability", 9))


@register("q4_recent", with_fx(
    "select * from single order by \"timestamp\" desc, id desc limit 100", "fx4", extra=CTES[:3]))
def q4_recent(spark, sf_dir):
    return store.recent(single_predictions(spark, sf_dir), 100)


@register("q5_batch_rows", with_fx(
    "select * from bp where batch_id = 'batch_2000' order by \"timestamp\" desc, id desc", "fx4", extra=CTES[:1]))
def q5_batch_rows(spark, sf_dir):
    return store.batch_rows(batch_predictions(spark, sf_dir), "batch_2000")


@register("q6_recent_batches", with_fx(
    "select batch_id, \"timestamp\", total_customers, high_risk_count, medium_risk_count, low_risk_count, "
    "round(avg_churn_probability, 9) as avg_churn_probability from meta order by \"timestamp\" desc, "
    "batch_id desc limit 5", "fx4", extra=CTES))
def q6_recent_batches(spark, sf_dir):
    m = store.recent_batches(batch_meta(spark, sf_dir), 5)
    return m.withColumn("avg_churn_probability", F.round("avg_churn_probability", 9))


@register("q7_queue", with_fx(
    "select id, customer_id, \"timestamp\", churn_probability, risk_level, status from queue "
    "where status = 'pending' order by churn_probability desc, \"timestamp\" desc, id desc limit 100",
    "fx4", extra=CTES[:2]))
def q7_queue(spark, sf_dir):
    return store.queue(queue_state(spark, sf_dir), "pending", 100,
                       ["id", "customer_id", "timestamp", "churn_probability", "risk_level", "status"])


@register("q7_queue_all", with_fx(
    "select id, customer_id, \"timestamp\", churn_probability, risk_level, status from queue "
    "order by churn_probability desc, \"timestamp\" desc, id desc limit 100", "fx4", extra=CTES[:2]))
def q7_queue_all(spark, sf_dir):
    return store.queue(queue_state(spark, sf_dir), None, 100,
                       ["id", "customer_id", "timestamp", "churn_probability", "risk_level", "status"])


@register("q8_apply_updates", with_fx("select * from applied", "fx4", extra=CTES))
def q8_apply_updates(spark, sf_dir):
    return applied_queue(spark, sf_dir)


@register("q8_incremental", with_fx("select * from applied", "fx4", extra=CTES))
def q8_incremental(spark, sf_dir):
    """The log folded into the kept facts in three parts, one after another, then the facts into the queue."""
    facts = UpdateFacts(spark, scratch_path(spark, "facts"))
    log = updates_log(spark, sf_dir)
    for part in range(3):
        facts.fold(log.filter(F.pmod(F.col("update_id"), F.lit(3)) == part), f"part{part}")
    return store.apply_facts(queue_state(spark, sf_dir), facts.facts())


@register("q9_retain_predictions", with_fx(
    f"select id, batch_id from bp where \"timestamp\" >= {CUTOFF_SQL}", "fx4", extra=CTES[:1]))
def q9_retain_predictions(spark, sf_dir):
    return store.retain(batch_predictions(spark, sf_dir), AS_OF, RETAIN_DAYS).select("id", "batch_id")


@register("q9_retain_queue", with_fx(
    f"select id, status, last_updated from applied where not (status = 'resolved' and last_updated < {CUTOFF_SQL})",
    "fx4", extra=CTES))
def q9_retain_queue(spark, sf_dir):
    kept = store.retain(applied_queue(spark, sf_dir), AS_OF, RETAIN_DAYS, queue_table=True)
    return kept.select("id", "status", "last_updated")


@register("q10_dedupe_queue", with_fx(
    "select id, customer_id, \"timestamp\", churn_probability, status from (select *, row_number() over "
    "(partition by customer_id order by \"timestamp\" desc, id desc) as rn from queue) where rn = 1",
    "fx4", extra=CTES[:2]))
def q10_dedupe_queue(spark, sf_dir):
    return store.dedupe_queue(queue_state(spark, sf_dir)).select(
        "id", "customer_id", "timestamp", "churn_probability", "status")


@register("h1_dashboard", with_fx(
    "select (select count(*) from single) as total_single_predictions, (select count(*) from bp) as "
    "total_batch_predictions, count(*) filter (where status = 'pending') as pending_risks, count(*) filter "
    "(where status = 'contacted') as contacted_risks, count(*) filter (where status = 'resolved') as resolved_risks, "
    f"count(*) filter (where status = 'pending' and \"timestamp\" >= timestamp '{AS_OF}' - interval {RECENT_DAYS} day)"
    " as recent_high_risk_7days from applied", "fx4", extra=CTES))
def h1_dashboard(spark, sf_dir):
    return store.dashboard(single_predictions(spark, sf_dir), batch_predictions(spark, sf_dir),
                           applied_queue(spark, sf_dir), AS_OF, RECENT_DAYS)


@register("h2_batch_history", with_fx(
    "select batch_id, customer_id, id, \"timestamp\", churn_probability, risk_level, status from bp where batch_id = "
    "(select batch_id from meta order by \"timestamp\" desc, batch_id desc limit 1)", "fx4", extra=CTES))
def h2_batch_history(spark, sf_dir):
    return store.latest_batch_rows(batch_predictions(spark, sf_dir), batch_meta(spark, sf_dir))


# ------------------------------------------------------------------ the store with commits

STORE_PREDS = ("cast(customer_id as varchar) as customer_id, \"timestamp\", churn_probability, risk_level, "
               "'order ' || cast(id as varchar) || ', ' || status as top_factors, lower(risk_level) as recommended_action")
STORE_CTES = CTES + [
    ("st_single", f"select {STORE_PREDS} from single".replace("|| status", "|| 'latest'")),
    ("st_batch", f"select batch_id, {STORE_PREDS} from bp"),
]


def _store_sql(keep_rows: str = "true", keep_queue: str = "true") -> str:
    cols = "customer_id, \"timestamp\", churn_probability, risk_level, top_factors, recommended_action"
    none = "cast(null as varchar) as {}"
    return " union all ".join([
        f"select 'single_predictions' as \"table\", {none.format('batch_id')}, {cols}, {none.format('status')}, "
        f"cast(null as bigint) as total, cast(null as bigint) as high, cast(null as bigint) as medium, cast(null as bigint) as low "
        f"from st_single where {keep_rows}",
        f"select 'batch_predictions', batch_id, {cols}, null, null, null, null, null from st_batch where {keep_rows}",
        f"select 'batch_metadata', batch_id, null, \"timestamp\", round(avg_churn_probability, 9), null, null, null, null, "
        f"total_customers, high_risk_count, medium_risk_count, low_risk_count from meta where {keep_rows}",
        f"select 'risk_queue', null, {cols}, 'pending', null, null, null, null from (select * exclude (batch_id) from st_batch union all "
        f"select * from st_single) q left join lastu on lastu.c = q.customer_id where risk_level = 'High' and {keep_queue}"])


def _recorded(spark, sf_dir):
    """All batches and the single predictions recorded, one batch cut off before its commit."""
    out = CommittedStore.create(spark, scratch_path(spark, "store"))

    def rows(df, more):
        return df.select(F.col("customer_id").cast("string").alias("customer_id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                         "churn_probability", "risk_level",
                         F.array(F.concat(F.lit("order "), F.col("id").cast("string")), more).alias("top_factors"),
                         F.lower("risk_level").alias("recommended_action"))

    bp = batch_predictions(spark, sf_dir)
    batches = sorted(r["batch_id"] for r in bp.select("batch_id").distinct().collect())  # one per year
    out.stage_batch(rows(bp.filter(F.col("batch_id") == batches[0]), F.lit("lost")), batches[0], AS_OF)  # cut off: made again below
    for b in batches:
        out.record_batch(rows(bp.filter(F.col("batch_id") == b), F.col("status")), b, AS_OF)
    single = rows(single_predictions(spark, sf_dir), F.lit("latest"))
    out.record_single(single.withColumn("input_features", F.struct("customer_id")), "latest", AS_OF)
    out.stage_batch(rows(bp, F.lit("lost")), "never", AS_OF)
    return out


def _all_tables(st):
    def part(table, df, **more):
        names = {"batch_id": "string", "customer_id": "string", "timestamp": "timestamp_ntz", "churn_probability": "double",
                 "risk_level": "string", "top_factors": "string", "recommended_action": "string", "status": "string",
                 "total": "bigint", "high": "bigint", "medium": "bigint", "low": "bigint"}
        have = {n: F.col(more.get(n, n)) if more.get(n, n) in df.columns else F.lit(None) for n in names}
        return df.select(F.lit(table).alias("table"), *[c.cast(names[n]).alias(n) for n, c in have.items()])

    meta = st.read("batch_metadata").withColumn("avg_churn_probability", F.round("avg_churn_probability", 9))
    return (part("single_predictions", st.read("single_predictions"))
            .unionAll(part("batch_predictions", st.read("batch_predictions")))
            .unionAll(part("batch_metadata", meta, churn_probability="avg_churn_probability", total="total_customers",
                           high="high_risk_count", medium="medium_risk_count", low="low_risk_count"))
            .unionAll(part("risk_queue", st.read("risk_queue"))))


LASTU = ("lastu", "select cast(customer_id as varchar) as c, ts as u_ts, status as u_status from (select *, row_number() over "
         "(partition by customer_id order by ts desc, update_id desc, status desc, follow_up_notes desc) as rn from upd) where rn = 1")


@register("s8_committed_store", with_fx(_store_sql(), "fx4", extra=STORE_CTES + [LASTU]))
def s8_committed_store(spark, sf_dir):
    """Every committed row of the four tables; two writes that were cut off leave nothing."""
    return _all_tables(_recorded(spark, sf_dir))


@register("q9_clear_store", with_fx(_store_sql(
    f"\"timestamp\" >= {CUTOFF_SQL}",
    f"not (coalesce(u_ts >= \"timestamp\", false) and u_status = 'resolved' and u_ts < {CUTOFF_SQL})"), "fx4", extra=STORE_CTES + [LASTU]))
def q9_clear_store(spark, sf_dir):
    """The stored tables after old rows are cleared: queue rows go by their status with the update log folded in."""
    st = _recorded(spark, sf_dir)
    log = updates_log(spark, sf_dir).withColumn("customer_id", F.col("customer_id").cast("string"))
    st.clear_old(AS_OF, RETAIN_DAYS, "yearly", log)
    return _all_tables(st)
