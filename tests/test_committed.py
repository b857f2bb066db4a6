"""The store with commits: whole writes or none, typed rows, clean-up and compaction."""

import pytest
from pyspark.sql import functions as F

from churnkit.operators import store
from churnkit.operators.committed import SCHEMAS, CommittedStore, Staged

AT = "2024-03-01 12:00:00"
ROWS = "customer_id string, churn_probability double, risk_level string, top_factors array<string>, recommended_action string"


@pytest.fixture()
def st(spark, tmp_dir):
    return CommittedStore.create(spark, f"{tmp_dir}/store")


def batch(spark, *probs, **more):
    rows = [(f"c{i}", p, "High" if p > 0.6 else "Medium" if p > 0.3 else "Low", ["a", "b"], "call") for i, p in enumerate(probs)]
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def counts(st):
    return {t: st.read(t).count() for t in SCHEMAS}


def test_a_new_store_is_empty(st):
    assert counts(st) == dict.fromkeys(SCHEMAS, 0)
    for t, ddl in SCHEMAS.items():
        assert st.read(t).schema.simpleString() == st.spark.createDataFrame([], ddl).schema.simpleString()
    with pytest.raises(Exception):
        CommittedStore.create(st.spark, st.root)


def test_batches_and_singles(spark, st):
    st.record_batch(batch(spark, 0.9, 0.5, 0.1), "b1", AT)
    st.record_batch(batch(spark), "b2", AT)
    st.record_single(batch(spark, 0.7, 0.2, input_features="{}"), "s1", AT)
    assert counts(st) == {"single_predictions": 2, "batch_predictions": 3, "batch_metadata": 2, "risk_queue": 2}
    meta = {r["batch_id"]: r for r in st.read("batch_metadata").collect()}
    assert [meta["b1"][c] for c in ("total_customers", "high_risk_count", "medium_risk_count", "low_risk_count")] == [3, 1, 1, 1]
    assert meta["b2"]["total_customers"] == 0 and meta["b2"]["avg_churn_probability"] == 0 and str(meta["b2"]["timestamp"]) == AT
    q = st.queue().collect()
    assert {r["status"] for r in q} == {"pending"} and {r["top_factors"] for r in q} == {"a, b"}
    assert all(str(r["timestamp"]) == AT == str(r["last_updated"]) for r in q) and len({r["id"] for r in q}) == 2


def test_a_write_counts_with_its_commit_only(spark, st):
    staged = st.stage_batch(batch(spark, 0.9, 0.8), "b1", AT)
    assert st._stored("batch_predictions").count() == 2 and counts(st) == dict.fromkeys(SCHEMAS, 0)
    again = st.stage_batch(batch(spark, 0.9, 0.8), "b1", AT)
    again.commit()
    assert counts(st) == {"single_predictions": 0, "batch_predictions": 2, "batch_metadata": 1, "risk_queue": 2}
    with pytest.raises(Exception):
        staged.commit()  # another write of this batch came first
    with pytest.raises(ValueError):
        st.record_batch(batch(spark, 0.1), "b1", AT)
    assert counts(st)["batch_predictions"] == 2


def test_ids_do_not_depend_on_the_attempt(spark, st):
    st.stage_batch(batch(spark, 0.9, 0.8), "b1", AT)
    st.stage_batch(batch(spark, 0.9, 0.8), "b1", AT)
    per = st._stored("batch_predictions").groupBy("id").count().collect()
    assert len(per) == 2 and all(r["count"] == 2 for r in per)


@pytest.mark.parametrize("change, message", [
    (lambda d: d.drop("customer_id"), "no column customer_id"), (lambda d: d.withColumn("extra", F.lit(1)), "unknown column extra"),
    (lambda d: d.withColumn("churn_probability", F.lit("x")), "churn_probability is string")])
def test_wrong_columns_are_refused(spark, st, change, message):
    with pytest.raises(ValueError, match=message):
        st.record_batch(change(batch(spark, 0.9)), "b1", AT)


@pytest.mark.parametrize("column, value", [("customer_id", None), ("churn_probability", 1.5), ("churn_probability", None), ("risk_level", "high")])
def test_bad_values_fail_the_write(spark, st, column, value):
    kind = "double" if column == "churn_probability" else "string"
    with pytest.raises(Exception, match="bad value"):
        st.record_batch(batch(spark, 0.9).withColumn(column, F.lit(value).cast(kind)), "b1", AT)
    assert counts(st) == dict.fromkeys(SCHEMAS, 0)


def test_clearing_old_rows(spark, st):
    def at(day):
        return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")

    st.record_batch(batch(spark, 0.9, 0.2).withColumn("timestamp", at("2023-01-01")), "old", AT)
    st.record_batch(batch(spark, 0.9).withColumn("timestamp", at("2024-02-20")), "new", AT)
    mixed = batch(spark, 0.8, 0.95).withColumn("timestamp", F.when(F.col("customer_id") == "c0", at("2023-06-01")).otherwise(at("2024-02-25")))
    st.record_batch(mixed, "mixed", AT)
    updates = spark.createDataFrame([("c0", "resolved", "done", "2023-07-01 00:00:00", 1)],
                                    "customer_id string, status string, follow_up_notes string, ts string, update_id int"
                                    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    untouched = {r["commit"] for r in st.keys().collect()}
    key = st.clear_old(AT, 90, "spring", updates)
    left = {(r["batch_id"], r["customer_id"]) for r in st.read("batch_predictions").collect()}
    assert left == {("new", "c0"), ("mixed", "c1")}
    assert {r["batch_id"] for r in st.read("batch_metadata").collect()} == {"new", "mixed"}
    # resolved long ago: the two old rows of c0; the row of 2024 came after the update and stays pending
    q = sorted((str(r["timestamp"])[:10], r["customer_id"], r["status"]) for r in st.read("risk_queue").collect())
    assert q == [("2024-02-20", "c0", "pending"), ("2024-02-25", "c1", "pending")]
    now = {r["commit"] for r in st.keys().collect()}
    assert key in now and len(now & untouched) == 1  # the batch without an old row was not written again
    assert st.clear_old(AT, 90, "again", updates) is None


def test_compaction_keeps_every_row(spark, st):
    for i in range(3):
        st.record_batch(batch(spark, 0.9, 0.1), f"b{i}", AT)
    before = {t: sorted(map(str, st.read(t).collect())) for t in SCHEMAS}
    key = st.compact(AT, "one")
    assert [r["commit"] for r in st.keys().collect()] == [key]
    assert {t: sorted(map(str, st.read(t).collect())) for t in SCHEMAS} == before
    assert st.compact(AT, "two") is None
    st.record_batch(batch(spark, 0.7), "b3", AT)
    assert st.read("batch_predictions").count() == 7


def test_queue_takes_status_updates(spark, st):
    st.record_batch(batch(spark, 0.9), "b", AT)
    log = spark.createDataFrame([("c0", "contacted", "", "2024-03-02 00:00:00", 1)],
                                "customer_id string, status string, follow_up_notes string, ts string, update_id int"
                                ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r["status"] for r in st.queue(log).collect()] == [store.CONTACTED]


def test_a_lost_clean_up_changes_nothing(spark, st, monkeypatch):
    st.record_batch(batch(spark, 0.9).withColumn("timestamp", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")), "old", AT)
    monkeypatch.setattr(Staged, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        st.clear_old(AT, 30, "x")
    assert st.read("batch_predictions").count() == 1
