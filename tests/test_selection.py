"""Splits by distributed selection, facts folded part by part, and streams of panes."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from churnkit.operators import split as sp, store
from churnkit.operators.facts import UpdateFacts
from churnkit.streaming.stream import panes, risk_events, stream_panes, window_counts, windows_of_panes


def ranked_parts(df, ends, names):
    """The parts by ranks."""
    r = sp.class_rank(df, "y", "id")
    part = F.lit(names[-1])
    for end, name in zip(ends[::-1], names[-2::-1]):
        part = F.when(F.col("_rank") <= sp.ceil_frac(F.col("_class_n"), end), name).otherwise(part)
    return sorted((x["id"], x["p"]) for x in r.select("id", part.alias("p")).collect())


@pytest.mark.parametrize("looked_at", [0, 3, 4096])
def test_cuts_equal_ranks(spark, monkeypatch, looked_at):
    monkeypatch.setattr(sp.select_hashes, "__defaults__", (42, looked_at))
    monkeypatch.setattr(sp, "SLICE_HEX_DIGITS", 1)
    df = spark.range(700).select(F.col("id"), F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 11 == 0, None).otherwise(0).alias("y"))
    for fracs, names in (((0.2,), ("test", "train")), ((0.2, 0.2), ("test", "cal", "train")), ((0.0, 1.0), ("a", "b", "c"))):
        got = sorted((r["id"], r["part"]) for r in sp.stratified_split(df, "y", "id", fracs, names).collect())
        ends = [sum((Fraction(str(f)) for f in fracs[:i + 1]), Fraction(0)) for i in range(len(fracs))]
        assert got == ranked_parts(df, ends, names)


def test_rows_of_one_id_stay_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("id"), F.lit(1).alias("y"))
    got = sp.stratified_split(df, "y", "id", (0.5,), ("a", "b")).groupBy("id").agg(F.count_distinct("part").alias("n"), F.first("part").alias("p"), F.count("*").alias("rows")).collect()
    assert all(r["n"] == 1 for r in got)
    assert sum(r["rows"] for r in got if r["p"] == "a") >= 450


def test_many_classes_go_by_ranks(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 40).alias("y"))
    few = sorted(map(tuple, sp.stratified_split(df, "y", "id").collect()))
    monkeypatch.setattr(sp, "MAX_CLASSES", 0)
    assert sp.select_hashes(df, "y", "id", [Fraction(1, 5)]) is None
    assert sorted(map(tuple, sp.stratified_split(df, "y", "id").collect())) == few


def test_no_row_moves_for_a_split(spark, tmp_dir):
    spark.range(500).selectExpr("id", "id % 2 as y", "id * 2 as feature").write.parquet(f"{tmp_dir}/t")
    plan = sp.stratified_split(spark.read.parquet(f"{tmp_dir}/t"), "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") and "Window" not in plan


def test_split_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, y int")
    assert sp.stratified_split(df, "y", "id").collect() == []


LOG = "customer_id bigint, status string, follow_up_notes string, ts timestamp_ntz, update_id bigint"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def facts_rows(df):
    return sorted(map(repr, df.select("_cust", "u", "n").collect()))


def test_parts_folded_one_after_another_equal_one_fold(spark, tmp_dir, monkeypatch):
    rows = [(i % 23, ["pending", "contacted", "resolved"][i % 3], "" if i % 4 else f"note {i}", f"2024-01-{1 + i * 7 % 28:02d} 00:00:00", i)
            for i in range(300)] + [(None, "resolved", None, "2024-01-05 00:00:00", 900)]
    log = log_of(spark, rows)
    kept = UpdateFacts(spark, tmp_dir, buckets=8)
    assert kept.facts().count() == 0
    for part in range(3):
        kept.fold(log.filter(F.col("update_id") % 3 == part), f"part{part}")
    assert facts_rows(kept.facts()) == facts_rows(store.update_facts(log))
    kept.fold(log.limit(0), "nothing")
    kept.fold(log, "part1")  # folded already
    assert facts_rows(kept.facts()) == facts_rows(store.update_facts(log))

    # a part of one customer: earlier parts are not read, other buckets not written again
    before = dict(kept._versions())
    new = log_of(spark, [(3, "resolved", "late", "2025-01-01 00:00:00", 1000)])
    kept.fold(new, "late")
    after = kept._versions()
    assert sum(before[b] != after[b] for b in before) == 1
    assert facts_rows(kept.facts()) == facts_rows(store.update_facts(log.unionAll(new)))


def test_a_fold_that_is_cut_off_changes_nothing(spark, tmp_dir, monkeypatch):
    log = log_of(spark, [(1, "resolved", "x", "2024-01-01 00:00:00", 1), (2, "pending", "", "2024-01-01 00:00:00", 2)])
    kept = UpdateFacts(spark, tmp_dir, buckets=4)
    kept.fold(log, "a")
    before = facts_rows(kept.facts())
    real = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, schema=None: (_ for _ in ()).throw(RuntimeError("lost"))
                        if isinstance(schema, str) and schema.startswith("fold") else real(rows, schema))
    with pytest.raises(RuntimeError):
        kept.fold(log.withColumn("update_id", F.lit(9).cast("bigint")), "b")
    monkeypatch.undo()
    assert facts_rows(kept.facts()) == before


def events(spark, rows):
    return spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_panes_bound_late_rows_and_add_up_to_weeks(spark, tmp_dir):
    kind = ["error", "view", "click"]
    first = [(f"2024-01-{d:02d} 0{h}:00:00", kind[(d + h) % 3]) for d in range(1, 11) for h in range(4)]
    second = [(f"2024-01-{d:02d} 05:00:00", "error") for d in range(9, 25)] + [("2024-01-02 06:00:00", "error")]  # the last one is too late
    static = None
    for i, rows in enumerate((first, second)):
        events(spark, rows).write.parquet(f"{tmp_dir}/in/s{i}")
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_dir}/in/*")
        stream_panes(stream, f"{tmp_dir}/panes", f"{tmp_dir}/progress", "2 days").awaitTermination()
    static = risk_events(events(spark, first + second[:-1]))
    daily = panes(spark, f"{tmp_dir}/panes")
    cols = ["window_start", "window_end", "events", "high_risk_events"]
    assert sorted(map(repr, daily.select(cols).collect())) == sorted(map(repr, window_counts(static, "1 day").select(cols).collect()))
    weekly = windows_of_panes(daily).select(cols).collect()
    assert sorted(map(repr, weekly)) == sorted(map(repr, window_counts(static, "7 days", "1 day").select(cols).collect()))
