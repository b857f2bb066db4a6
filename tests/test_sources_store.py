"""Sources and sinks (S1-S5, S7, S8) and stored-table operators (Q1, Q2, Q8, Q9)."""

from pyspark.sql import functions as F

from churnkit.operators import store
from churnkit.sources import fixtures
from churnkit.sources.accounts import ensure_id, read_accounts, read_usage, split_rejects
from churnkit.sources.sinks import report_frame, write_predictions, write_report

SF = "/root/testdata/sf0.001"
HEADER = ("customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,InternetService,"
          "OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,StreamingMovies,Contract,"
          "PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges")
GOOD = ["C001,Female,0,Yes,No,1,No,No phone service,DSL,No,Yes,No,No,No,No,Month-to-month,Yes,Electronic check,29.85,29.85",
        "C002,Male,Yes,No,No,34,Yes,No,DSL,Yes,No,Yes,No,No,No,One year,No,Mailed check,56.95, ",
        "C003,Male,0,No,No,2,Yes,No,DSL,Yes,Yes,No,No,No,No,Month-to-month,Yes,Mailed check,53.85,108.15"]
SHORT = "C004,Female,0,No,No,45,No,No phone service,No,Yes,No,Yes,No,No,One year,No,Bank transfer (automatic),42.3,1840.75"


def _csv(tmp_path, lines, header=HEADER):
    d = tmp_path / "upload"
    d.mkdir()
    (d / "batch.csv").write_text(header + "\n" + "\n".join(lines) + "\n")
    return str(d)


def test_read_accounts_rejects_short_rows(spark, tmp_path):
    df = read_accounts(spark, _csv(tmp_path, GOOD + [SHORT]))
    good, bad = split_rejects(df)
    assert sorted(r["customerID"] for r in good.select("customerID").collect()) == ["C001", "C002", "C003"]
    assert [r["customerID"] for r in bad.select("customerID", "_corrupt_record").collect()] == ["C004"]
    row = good.filter("customerID = 'C002'").first()
    assert row["SeniorCitizen"] == 1 and row["tenure"] == 34 and row["MonthlyCharges"] == 56.95


def test_ensure_id_numbers_rows_in_input_order(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("x"))
    out = ensure_id(df).collect()
    assert [r["customerID"] for r in out] == [f"row_{i}" for i in range(1000)]
    assert [r["x"] for r in out] == [i * 3 for i in range(1000)]
    keep = ensure_id(spark.createDataFrame([(5, 1)], "customerID int, x int")).first()
    assert keep["customerID"] == "5"


def test_row_ids_follow_file_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n2\n3\n")
    (tmp_path / "b.csv").write_text("\n".join(str(i) for i in range(4, 2004)) + "\n")
    got = {r["x"]: r["customerID"] for r in ensure_id(spark.read.schema("x int").csv(str(tmp_path))).collect()}
    assert got == {i: f"row_{i - 1}" for i in range(1, 2004)}


def test_read_usage_types_from_header(spark, tmp_path):
    d = tmp_path / "usage"
    d.mkdir()
    (d / "u.csv").write_text("mobile_number,circle_id,total_rech_amt_6,date_of_last_rech_6,total_ic_mou_9\n"
                             "7000,109,120.5,6/21/2014,\n")
    df = read_usage(spark, str(d))
    types = dict(df.dtypes)
    assert types["total_rech_amt_6"] == "double" and types["date_of_last_rech_6"] == "string"
    assert types["total_ic_mou_9"] == "double" and df.first()["total_ic_mou_9"] is None


def test_report_is_ordered_and_flat(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.2, ["x", "y"]), ("b", 0.9, ["z"]), ("c", 0.5, [])],
                               "customer_id string, churn_probability double, top_factors array<string>")
    rows = report_frame(df).collect()
    assert [r["customer_id"] for r in rows] == ["b", "c", "a"]
    assert rows[2]["top_factors"] == "x, y"
    path = str(tmp_path / "report")
    write_report(df, path)
    back = spark.read.option("header", True).csv(path).collect()
    assert sorted(r["customer_id"] for r in back) == ["a", "b", "c"]


def test_prediction_tables_append_and_retention(spark, tmp_path):
    p = fixtures.predictions(spark, SF).withColumnRenamed("ts", "timestamp")
    p = store.with_risk_level(p, 0.35)
    root = str(tmp_path / "tables")
    write_predictions(p.drop("status"), root, "batch_predictions")
    write_predictions(store.queue_rows(p.drop("status")), root, "risk_queue")
    bp = spark.read.parquet(f"{root}/batch_predictions")
    q = spark.read.parquet(f"{root}/risk_queue")
    assert bp.count() == p.count()
    assert q.count() == p.filter(F.col("risk_level") == "High").count()
    assert set(r[0] for r in q.select("status").distinct().collect()) == {"pending"}
    dst = store.compact_retention(spark, f"{root}/batch_predictions", str(tmp_path / "bp_v2"),
                                  fixtures.AS_OF, 365)
    kept = spark.read.parquet(dst)
    want = store.retain(bp, fixtures.AS_OF, 365)
    assert kept.count() == want.count() and bp.count() == p.count()  # source untouched


def test_apply_updates_replay_and_time_order(spark):
    q = spark.createDataFrame([(1, "c1", "2024-01-01 00:00:00", "pending"), (2, "c1", "2024-01-05 00:00:00", "pending"),
                               (3, "c2", "2024-01-01 00:00:00", "pending")],
                              "id int, customer_id string, timestamp string, status string")
    q = q.withColumn("timestamp", F.to_timestamp("timestamp")).withColumn(
        "follow_up_notes", F.lit(None).cast("string")).withColumn("last_updated", F.col("timestamp"))
    u = spark.createDataFrame([("c1", "2024-01-03 00:00:00", "contacted", "called", 1),
                               ("c1", "2024-01-04 00:00:00", "resolved", "", 2)],
                              "customer_id string, ts string, status string, follow_up_notes string, update_id int")
    u = u.withColumn("ts", F.to_timestamp("ts"))
    once = {r["id"]: (r["status"], r["follow_up_notes"]) for r in store.apply_updates(q, u).collect()}
    # row 2 was queued after both updates, so they do not touch it; an empty note keeps the last note
    assert once == {1: ("resolved", "called"), 2: ("pending", None), 3: ("pending", None)}
    twice = {r["id"]: (r["status"], r["follow_up_notes"]) for r in store.apply_updates(q, u.unionByName(u)).collect()}
    assert twice == once


def test_bundle_roundtrip(spark, tmp_path):
    from churnkit.operators import models as ml
    from churnkit.sources.bundle import load_bundle, save_bundle

    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)],
                               "id int, a double, b double, label int")
    m = ml.fit(df, ["a", "b"], ml.boosted(n_estimators=5, max_depth=2), "label")
    path = str(tmp_path / "bundle")
    save_bundle(spark, path, {"model": m}, {"columns": ["a", "b"], "threshold": 0.4})
    models, doc = load_bundle(spark, path)
    assert doc["threshold"] == 0.4 and doc["columns"] == ["a", "b"]
    p1 = [r["prob"] for r in ml.predict_proba(m, df, ["a", "b"]).orderBy("id").collect()]
    p2 = [r["prob"] for r in ml.predict_proba(models["model"], df, ["a", "b"]).orderBy("id").collect()]
    assert p1 == p2
