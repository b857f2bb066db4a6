"""Frames that learners pass over: forests in parts, partitions by rows, inputs worked out once."""

import pytest
from pyspark.sql import functions as F

from churnkit import session
from churnkit.operators import models as ml
from churnkit.plans import ml_queries as q

SF = "/root/testdata/sf0.001"
FEATS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i % 150, int(i * 7 % 10 < 3 + (i % 5)), float(i * 37 % 11), float(i % 5)) for i in range(200)],
                                 "id int, label int, a double, b double")


def test_a_forest_in_parts_has_all_trees_and_their_mean(rows, monkeypatch):
    est = ml.forest(n_estimators=7, max_depth=4, min_samples_leaf=2, random_state=3)
    models, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    a, b = ml.forest_proba(rows, FEATS, est, [rows, rows.filter("id < 20")], "label", keep=["id", "label"], nodes=64)
    trees = [m.stages[-1].getNumTrees for m in models]
    assert trees == [2, 2, 2, 1] and a.columns == ["id", "label", "prob"] and b.count() == rows.filter("id < 20").count()
    assert len({m.stages[-1].toDebugString.split("\n", 1)[1] for m in models}) == 4
    # repeated ids keep their rows
    got = sorted((r["id"], r["label"], round(r["prob"], 12)) for r in a.collect())
    sums = {}
    for n, m in zip(trees, models):
        for r in ml.predict_proba(m, rows, FEATS).collect():
            sums.setdefault((r["id"], r["label"], r["a"], r["b"]), []).append(n * r["prob"])
    copies = {tuple(r[:4]): r["n"] for r in rows.groupBy("id", "label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = sorted((k[0], k[1], round(sum(v) / copies[k] / 7, 12)) for k, v in sums.items() for _ in range(copies[k]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_a_forest_that_fits_is_one_model(rows):
    est = ml.forest(n_estimators=5, max_depth=3, random_state=3)
    whole = ml.predict_proba(ml.fit(rows, FEATS, est), rows, FEATS, keep=["id"]).collect()
    assert sorted(ml.forest_proba(rows, FEATS, est, [rows], keep=["id"])[0].collect()) == sorted(whole)


def test_partitions_follow_the_rows(spark):
    out = session.reliable_for_passes(spark.range(0, 1000, 1, 97))
    assert out.rdd.getNumPartitions() == min(97, spark.sparkContext.defaultParallelism) and out.count() == 1000


def test_frames_are_worked_out_once(spark, monkeypatch):
    calls, split = [], q.stratified_split

    def watched(df, *more, **kw):
        calls.append(df)
        return split(df, *more, **kw)

    monkeypatch.setattr(q, "stratified_split", watched)
    monkeypatch.setattr(q.ml, "mlp", lambda n, **kw: ml.logistic(C=None))
    assert q.m4_mlp(spark, SF).count() > 0 and len(calls) == 1
    q.m7_select_top_features(spark, SF)
    # the split reads stored rows, not the plan that made them
    assert len(calls) == 2 and all("Scan parquet" not in df._jdf.queryExecution().toString() for df in calls)
