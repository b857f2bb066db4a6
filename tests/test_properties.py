"""Properties of SURVEY 5: splits, running sums, quantiles, kNN / SMOTE, stacking,
calibration, leakage, and plan shape."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnkit.operators.balance import knn, smote
from churnkit.operators.calibration import platt_fit
from churnkit.operators.evaluate import pr_curve
from churnkit.operators.ordered import exact_quantile, running_totals
from churnkit.operators.split import fold_ids, stratified_split
from churnkit.sources import fixtures
from churnkit.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_folds_disjoint_stratified_and_partition_independent(spark):
    s = fixtures.scored(spark, SF)
    f1 = {r["id"]: r["fold"] for r in fold_ids(s, "label", "id", 5).collect()}
    f2 = {r["id"]: r["fold"] for r in fold_ids(s.repartition(7), "label", "id", 5).collect()}
    assert f1 == f2 and len(f1) == s.count()
    sizes = fold_ids(s, "label", "id", 5).groupBy("label", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_label.values())
    parts = stratified_split(s, "label", "id").groupBy("label", "part").count().collect()
    n = {r["label"]: 0 for r in parts}
    for r in parts:
        n[r["label"]] += r["count"]
    for r in parts:
        if r["part"] == "test":
            assert r["count"] == -(-n[r["label"]] // 5)


def test_running_totals_match_a_single_window(spark):
    rng = random.Random(3)
    keys = sorted({rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-3, 6) for _ in range(2000)})
    df = spark.createDataFrame([(k, rng.randint(1, 5)) for k in keys], "k double, n long")
    want = df.withColumn("cum", F.sum("n").over(Window.orderBy("k"))).orderBy("k").collect()
    for kw in ({}, {"buckets": 16}):
        got = running_totals(df, "k", ["n"], **kw).orderBy("k").collect()
        assert [r["cum_n"] for r in got] == [r["cum"] for r in want]


def test_exact_quantile_matches_linear_interpolation(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.lognormal(3, 2, size=3001), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.0, 0.3, 0.7, 1.0):
        got = exact_quantile(df, "v", q).first()["quantile"]
        assert abs(got - float(np.quantile(vals, q))) < 1e-9 * max(1.0, abs(got))


def test_pr_curve_recall_is_monotone(spark):
    c = pr_curve(fixtures.scored(spark, SF)).orderBy("threshold").collect()
    rec = [r["recall"] for r in c]
    assert all(a >= b for a, b in zip(rec, rec[1:])) and rec[0] == 1.0


def _emb(spark):
    e = load(spark, SF, "embeddings").filter(F.col("label") == 0)
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _check_knn(spark, X, ids, k, **kw):
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in zip(ids, X)], "pid string, v array<double>")
    got = {(r["pid"], r["rank"]): r["nbr_id"] for r in knn(df, "pid", "v", k=k, **kw).collect()}
    for i in range(len(ids)):
        d = np.zeros(len(ids))
        for c in range(X.shape[1]):
            d += (X[:, c] - X[i, c]) ** 2
        order = sorted((float(np.sqrt(d[j])), ids[j]) for j in range(len(ids)) if j != i)[:k]
        assert [got.get((ids[i], r)) for r in range(1, len(order) + 1)] == [b for _, b in order]
    assert len(got) == sum(min(k, len(ids) - 1) for _ in ids)


def test_knn_is_exact_in_any_number_of_blocks(spark):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 9))] + [[[40.0, 40.0], [-30.0, 2.0], [9.0, -50.0]]])
    ids = [f"p{i:03d}" for i in range(len(X))]
    _check_knn(spark, X, ids, 5)
    _check_knn(spark, X, ids, 5, block_rows=8, max_pivots=6)  # outliers reach into other cells
    _check_knn(spark, X, ids, 5, block_rows=1000, max_pivots=1)
    _check_knn(spark, X[:4], ids[:4], 5)


def test_knn_with_a_third_of_rows_identical(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(150, 4))
    X[:50] = X[0]                      # a group of copies holding a third of the rows
    X[60:63] = X[70]                   # and a smaller one
    ids = [f"p{i:03d}" for i in range(150)]
    _check_knn(spark, X, ids, 5)
    _check_knn(spark, X, ids, 5, block_rows=16)


def test_smote_of_indicators_gives_values_between_them(spark):
    df = spark.createDataFrame([(i, i % 2, (i // 2) % 2, 1 if i < 8 else 0) for i in range(60)], "id int, a int, b int, y int")
    out = smote(df, "y", "id", ["a", "b"], k=5)
    assert dict(out.dtypes)["a"] == "double"
    syn = [r["a"] for r in out.filter("is_synthetic").collect()]
    assert len(syn) == 44 and any(0 < v < 1 for v in syn)
    as_double = smote(df.selectExpr("id", "double(a) as a", "double(b) as b", "y"), "y", "id", ["a", "b"], k=5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, as_double.collect()))


def test_smote_refuses_a_single_minority_row(spark):
    df = spark.createDataFrame([(i, 1.0 * i, 1 if i == 0 else 0) for i in range(9)], "id int, a double, y int")
    with pytest.raises(ValueError):
        smote(df, "y", "id", ["a"])


def test_learner_names_and_limits():
    from churnkit.operators import models as ml

    assert ml.forest(n_estimators=7, min_samples_split=10).getMinInstancesPerNode() == 5
    assert ml.boosted(num_leaves=31).getMaxDepth() == 5
    for bad in (lambda: ml.boosted(reg_alpha=0.1), lambda: ml.forest(max_depth=None), lambda: ml.forest(max_depth=31),
                lambda: ml.logistic(C=0.5)):
        with pytest.raises(ValueError):
            bad()


def test_smote_parity_and_segments(spark):
    df = spark.createDataFrame([(i, float(i % 10), float((i * 7) % 13), 1 if i % 4 == 0 else 0)
                                for i in range(200)], "id int, a double, b double, y int")
    out = smote(df, "y", "id", ["a", "b"], k=3)
    counts = {(r["y"], r["is_synthetic"]): r["count"] for r in out.groupBy("y", "is_synthetic").count().collect()}
    assert counts[(1, False)] + counts[(1, True)] == counts[(0, False)]
    mino = {str(r["id"]): (r["a"], r["b"]) for r in df.filter("y = 1").collect()}
    pts = np.array(list(mino.values()))
    for r in out.filter("is_synthetic").collect():
        base = np.array(mino[r["id"].split("_syn")[0]])
        p = np.array([r["a"], r["b"]])
        # on a segment from the base row towards another minority row
        ok = False
        for q in pts:
            d = q - base
            if np.allclose(d, 0):
                continue
            t = np.dot(p - base, d) / np.dot(d, d)
            if -1e-9 <= t <= 1 + 1e-9 and np.allclose(base + t * d, p, atol=1e-9):
                ok = True
                break
        assert ok or np.allclose(p, base)


def test_balancing_stays_inside_training_folds(spark):
    df = spark.createDataFrame([(i, float(i % 10), float((i * 7) % 13), 1 if i % 4 == 0 else 0)
                                for i in range(200)], "id int, a double, b double, y int")
    folds = fold_ids(df, "y", "id", 3)
    for f in range(3):
        train = smote(folds.filter(F.col("fold") != f).drop("fold"), "y", "id", ["a", "b"], k=3)
        valid = folds.filter(F.col("fold") == f).withColumn("id", F.col("id").cast("string"))
        assert valid.join(train.filter("is_synthetic"), "id").count() == 0
        assert train.filter(~F.col("is_synthetic")).join(valid, "id").count() == 0


def platt_reference(scores: list[float], labels: list[int], iters: int = 100) -> tuple[float, float]:
    """Newton fit on the smoothed targets; what platt_fit is held against."""
    n_pos = sum(labels)
    n_neg = len(labels) - n_pos
    tp, tn = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
    t = [tp if y == 1 else tn for y in labels]
    a, b = 0.0, math.log((n_neg + 1.0) / (n_pos + 1.0))
    for _ in range(iters):
        ga = gb = haa = hab = hbb = 0.0
        for s, ti in zip(scores, t):
            z = a * s + b
            p = 1.0 / (1.0 + math.exp(z)) if z > -700 else 1.0
            d = ti - p
            ga += d * s
            gb += d
            w = p * (1 - p)
            haa += w * s * s
            hab += w * s
            hbb += w
        det = haa * hbb - hab * hab
        if det == 0:
            break
        da = (hbb * ga - hab * gb) / det
        db = (haa * gb - hab * ga) / det
        a -= da
        b -= db
        if abs(da) < 1e-12 and abs(db) < 1e-12:
            break
    return a, b


def test_platt_matches_newton_reference(spark):
    rng = random.Random(5)
    rows = [(rng.random(), 1 if rng.random() < 0.3 else 0) for _ in range(500)]
    rows = [(s, 1 if (y or rng.random() < s * 0.5) else 0) for s, y in rows]
    df = spark.createDataFrame(rows, "s double, y int")
    a, b = platt_fit(df, "s", "y")
    ra, rb = platt_reference([r[0] for r in rows], [r[1] for r in rows])
    assert abs(a - ra) < 1e-5 and abs(b - rb) < 1e-5


def test_stack_is_out_of_fold(spark):
    from churnkit.operators import models as ml
    from churnkit.operators.stack import fit_stack

    df = spark.createDataFrame([(i, float(i % 10), float((i * 7) % 13), 1 if (i % 10) > 6 else 0)
                                for i in range(300)], "id int, a double, b double, label int")
    model, oof = fit_stack(df, ["a", "b"], {"gbt": ml.boosted(n_estimators=5, max_depth=2)}, "label", "id", k=3)
    rows = oof.collect()
    assert len(rows) == 300 and len({r["id"] for r in rows}) == 300
    assert {r["fold"] for r in rows} == {0, 1, 2}
    assert model.transform(df).count() == 300


def test_features_ignore_the_label_month(spark):
    """Leakage: scrambling every month-9 column changes only the label."""
    from churnkit.operators.usage import usage_model_frame

    u = fixtures.usage_wide(spark, SF)
    nine = [c for c in u.columns if c.endswith("_9")]
    scrambled = u.select(*[(F.col(c) * 3 + 1).alias(c) if c in nine else F.col(c) for c in u.columns])
    a = usage_model_frame(u).drop("Churn")
    b = usage_model_frame(scrambled).drop("Churn")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", ["v1_pr_curve", "p2_top_quantile", "x11_reason_text", "q8_apply_updates",
                                  "w3_best_change", "c7_one_hot", "f12_f17_usage_model_frame"])
def test_plans_have_no_python_udf(spark, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan


@pytest.mark.parametrize("name", ["q10_dedupe_queue", "c1_to_number", "i3_target_candidates"])
def test_latest_per_key_is_limited_before_the_shuffle(spark, name):
    """Top-n per key plans a partial WindowGroupLimit on the map side, so a hot key
    sends at most n rows per mapper."""
    import __spark_entry__ as e

    plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
