"""TreeSHAP: additivity against the model's margin, and brute-force Shapley values."""

import itertools
import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnkit.operators import models as ml
from churnkit.operators.treeshap import batch_output, extract_trees, shap_values, tree_contributions, tree_output


def _data(spark, n=400):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(n, 3))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + rng.normal(scale=0.5, size=n)) > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def _cond_expectation(tree, x, subset, node=0):
    if tree.left[node] < 0:
        return tree.value[node] * tree.weight
    f = tree.feature[node]
    if f in subset:
        nxt = tree.left[node] if x[f] <= tree.threshold[node] else tree.right[node]
        return _cond_expectation(tree, x, subset, nxt)
    l, r = tree.left[node], tree.right[node]
    c = tree.cover[node]
    return (tree.cover[l] / c) * _cond_expectation(tree, x, subset, l) + \
        (tree.cover[r] / c) * _cond_expectation(tree, x, subset, r)


def _brute(trees, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(len(others) + 1):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                with_i = sum(_cond_expectation(t, x, set(s) | {i}) for t in trees)
                without = sum(_cond_expectation(t, x, set(s)) for t in trees)
                phi[i] += w * (with_i - without)
    return phi


def test_gbt_additivity_and_brute_force(spark):
    df = _data(spark)
    feats = ["a", "b", "c"]
    m = ml.fit(df, feats, ml.boosted(n_estimators=8, max_depth=3), "label")
    trees = extract_trees(spark, m)
    X = np.array([[r["a"], r["b"], r["c"]] for r in df.limit(25).collect()])
    phi, base = shap_values(trees, X)
    for r in range(len(X)):
        assert abs(phi[r].sum() + base - tree_output(trees, X[r])) < 1e-9
        assert np.allclose(phi[r], _brute(trees, X[r], 3), atol=1e-9)
    assert np.allclose(batch_output(trees, X), [tree_output(trees, x) for x in X], atol=0, rtol=0)
    # the tree walk reproduces MLlib's margin: rawPrediction = [-F, F]
    raw = m.transform(ml.prepare(df.limit(25), feats, "label")).select(
        vector_to_array("rawPrediction")[1].alias("f")).collect()
    for r, row in enumerate(raw):
        assert abs(tree_output(trees, X[r]) - row["f"]) < 1e-9


def test_forest_additivity_in_probability_space(spark):
    df = _data(spark)
    feats = ["a", "b", "c"]
    m = ml.fit(df, feats, ml.forest(n_estimators=5, max_depth=3), "label")
    out = tree_contributions(df, m, feats, "id")
    rows = out.select("base_value", "model_output",
                      F.aggregate("contribs", F.lit(0.0), lambda a, x: a + x["contribution"]).alias("s")).collect()
    assert len(rows) == 400
    for r in rows:
        assert abs(r["s"] + r["base_value"] - r["model_output"]) < 1e-9
    prob = ml.predict_proba(m, df, feats, keep=["id"]).orderBy("id").collect()
    mo = out.orderBy("id").collect()
    for p, q in zip(prob[:50], mo[:50]):
        assert abs(p["prob"] - q["model_output"]) < 1e-9


def test_deep_forest_adds_up_and_equals_one_pass_a_leaf(spark):
    """Features met again and again on a path; the reference here multiplies out every leaf's game."""
    from math import comb

    from churnkit.operators import models as ml
    from churnkit.operators.treeshap import expected_value

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(0, 0.3, 400) > 0).astype(int)
    feats = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(400)],
                               "id int, label int, " + ", ".join(f"{c} double" for c in feats))
    m = ml.fit(df, feats, ml.forest(n_estimators=6, max_depth=12, random_state=3), "label")
    trees = extract_trees(spark, m)
    X = np.vstack([x[:30], np.full((1, 4), np.nan)])
    phi, base = shap_values(trees, X)
    assert np.allclose(phi.sum(1) + base, batch_output(trees, X), atol=1e-10)

    def leaves(tree, node=0, conds=()):
        if tree.left[node] < 0:
            yield node, conds
            return
        f, cut = tree.feature[node], tree.threshold[node]
        for child, low in ((tree.left[node], True), (tree.right[node], False)):
            yield from leaves(tree, child, (*conds, (f, cut, low, tree.cover[child] / tree.cover[node])))

    want = np.zeros_like(phi)
    for tree in trees:
        for node, conds in leaves(tree):
            used = sorted({c[0] for c in conds})
            for r, row in enumerate(X):
                one, part = {f: 1.0 for f in used}, {f: 1.0 for f in used}
                for f, cut, low, share in conds:
                    one[f] *= float((row[f] <= cut) == low)
                    part[f] *= share
                for f in used:
                    poly = np.array([1.0])  # by the number of known features
                    for g in used:
                        if g != f:
                            poly = np.append(poly * part[g], 0.0) + np.append(0.0, poly * one[g])
                    n = len(used)
                    size = sum(c / (n * comb(n - 1, s)) for s, c in enumerate(poly))
                    want[r, f] += tree.value[node] * tree.weight * (one[f] - part[f]) * size
    assert np.allclose(phi, want, atol=1e-10)
    assert abs(base - sum(expected_value(t) * t.weight for t in trees)) < 1e-12
