"""Learners, importance and feature selection on MLlib.

A model here is an MLlib ``PipelineModel`` (assembler + classifier); inputs
stay scalar columns until the assembler, and the positive-class probability
comes out as the ``prob`` column (``vector_to_array(probability)[1]``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit.functions.columns import col
from churnkit.session import reliable, scratch_path

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
NODES_AT_ONCE = 1_200_000


def forest(**params) -> RandomForestClassifier:
    """M1: random forest; sklearn-style names accepted (n_estimators, max_depth,
    min_samples_leaf, max_features)."""
    p = _translate(params, {"n_estimators": "numTrees", "max_depth": "maxDepth",
                            "min_samples_leaf": "minInstancesPerNode", "min_samples_split": "minInstancesPerNode",
                            "max_features": "featureSubsetStrategy", "random_state": "seed"})
    p.setdefault("seed", 42)
    if p.get("maxDepth", 1) is None or int(p.get("maxDepth", 1)) > 30:
        raise ValueError("max_depth must be 30 or less (MLlib's limit)")
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, **p)


def boosted(**params) -> GBTClassifier:
    """M2: gradient-boosted trees in the role of the boosting libraries
    (n_estimators, max_depth, learning_rate, subsample, colsample)."""
    p = _translate(params, {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
                            "subsample": "subsamplingRate", "min_child_samples": "minInstancesPerNode",
                            "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain",
                            "min_split_gain": "minInfoGain", "num_leaves": "maxDepth",
                            "colsample_bytree": "featureSubsetStrategy", "random_state": "seed"})
    if isinstance(p.get("featureSubsetStrategy"), float):
        p["featureSubsetStrategy"] = str(p["featureSubsetStrategy"])
    p.setdefault("seed", 42)
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, **p)


def logistic(C: float | None = 1.0, n_rows: int | None = None, max_iter: int = 1000) -> LogisticRegression:
    """M3: L2 logistic regression; sklearn's C maps to regParam = 1 / (C n).  C=None: no penalty."""
    if C is not None and not n_rows:
        raise ValueError("C needs n_rows, the number of training rows")
    reg = 0.0 if C is None else 1.0 / (C * n_rows)
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=reg, elasticNetParam=0.0,
                              standardization=False, maxIter=max_iter)


def mlp(n_features: int, hidden=(64, 32), max_iter: int = 200, block_size: int = 128, seed: int = 42) -> MultilayerPerceptronClassifier:
    """M4: feed-forward network (sigmoid hidden layers, softmax output)."""
    return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL,
                                          layers=[n_features, *hidden, 2], maxIter=max_iter,
                                          blockSize=block_size, seed=seed)


def _translate(params: dict, names: dict) -> dict:
    """MLlib parameters of the usual names of tree learners.

    A split needs ``min_samples_split`` rows above it, so half of them in each
    child stand in for it; ``num_leaves`` becomes the depth that holds them.
    Of two names for one parameter the stricter value counts.  Other names
    have no counterpart in MLlib and are refused.
    """
    known = set(names) | set(names.values()) | {"maxBins", "impurity", "minInfoGain"}
    if unknown := sorted(set(params) - known):
        raise ValueError(f"no MLlib counterpart for {', '.join(unknown)}")
    out = {}
    for k, v in params.items():
        if k == "min_samples_split":
            v = max(1, int(v) // 2)
        elif k == "min_child_weight":
            v = max(1, int(v))
        elif k == "num_leaves":
            v = max(1, int(v) - 1).bit_length()
        to = names.get(k, k)
        if to in out and v is not None and out[to] is not None and not isinstance(v, str):
            v = min(out[to], v) if to == "maxDepth" else max(out[to], v)
        out[to] = v
    return out


def make_pipeline(features: list[str], estimator, label: str = "label") -> Pipeline:
    """Assembler + estimator; the label column is cast to double first."""
    est = estimator.copy()
    est.setLabelCol(LABEL)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="keep"), est])


def prepare(df: DataFrame, features: list[str], label: str | None = "label") -> DataFrame:
    """Double features with nulls as 0 and a double ``label`` column."""
    cols = [F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    lab = [col(label).cast("double").alias(LABEL)] if label and label in df.columns else []
    rest = [col(c) for c in df.columns if c not in features and not (lab and c == LABEL)]
    return df.select(*rest, *cols, *lab)


def fit(df: DataFrame, features: list[str], estimator, label: str = "label",
        weight: str | None = None) -> PipelineModel:
    est = estimator.copy()
    if weight and est.hasParam("weightCol"):
        est = est.copy({est.getParam("weightCol"): weight})
    return make_pipeline(features, est, label).fit(prepare(df, features, label))


def predict_proba(model: PipelineModel, df: DataFrame, features: list[str], out: str = "prob",
                  keep: list[str] | None = None) -> DataFrame:
    """Positive-class probability as a double column; input columns kept."""
    scored = model.transform(prepare(df, features, None))
    p = vector_to_array(F.col("probability"))[1]
    keep = keep if keep is not None else [c for c in df.columns]
    return scored.select(*[col(c) for c in keep], p.alias(out))


def forest_proba(train: DataFrame, features: list[str], estimator: RandomForestClassifier, frames: list[DataFrame],
                 label: str = "label", keep: list[str] | None = None, out: str = "prob",
                 nodes: int = NODES_AT_ONCE, id_col: str | None = None) -> list[DataFrame]:
    """M1 fitted and applied to ``frames``: ``fit`` and ``predict_proba`` for forests that the driver cannot hold.

    With ``id_col``, which spreads equal rows, the trees grow and score inside tasks (``grown``) where a task can hold the rows.
    Otherwise MLlib grows them: trees are independent, so the forest grows in parts of as many trees as
    can have ``nodes`` nodes together.  Each part scores every row and goes; a
    row's probability is the mean over all trees, as MLlib's is.
    """
    if id_col is not None:
        from churnkit.operators.grown import forest_scores

        keep = keep if keep is not None else list(frames[0].columns)
        return [f.drop("n_trees").withColumnRenamed("prob", out) for f in forest_scores(train, features, estimator, frames, label, id_col, keep)]
    total = estimator.getNumTrees()
    # a split leaves at least this many rows on either side
    a_tree = min(2 << estimator.getMaxDepth(), 2 * train.count() // estimator.getMinInstancesPerNode())
    at_once = max(1, min(total, nodes // max(1, a_tree)))
    if at_once == total:
        m = fit(train, features, estimator, label)
        return [predict_proba(m, f, features, out, keep) for f in frames]
    rows = [reliable(f.withColumn("_row", F.monotonically_increasing_id())) for f in frames]
    sums: list[list[DataFrame]] = [[] for _ in frames]
    for first in range(0, total, at_once):
        n = min(at_once, total - first)
        part = estimator.copy({estimator.numTrees: n, estimator.seed: estimator.getSeed() + 1_000_003 * first})
        m = fit(train, features, part, label)
        for f, got in zip(rows, sums):
            got.append(reliable(predict_proba(m, f, features, "_p", ["_row"]).withColumn("_p", F.col("_p") * n)))
    scored = []
    for f, r, got in zip(frames, rows, sums):
        mean = reduce(DataFrame.unionAll, got).groupBy("_row").agg((F.sum("_p") / total).alias(out))
        scored.append(r.select("_row", *[col(c) for c in keep or f.columns]).join(mean, "_row").drop("_row"))
    return scored


def importance(model: PipelineModel, features: list[str], top: int | None = None):
    """M6: feature importances ranked descending (ties by name), as a small DataFrame."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    if top is not None:
        rows = rows[:top]
    return [(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)]


def importance_frame(sparkSession, model: PipelineModel, features: list[str], top: int | None = None) -> DataFrame:
    """M6 as a DataFrame (rank, feature, importance): one row per feature, not per data row."""
    return sparkSession.createDataFrame(importance(model, features, top), "rank int, feature string, importance double")


def node_importance(model: PipelineModel, features: list[str]) -> list[float]:
    """M6 worked out again from the saved node table: each split's gain times the rows it splits, summed by
    feature (for a forest after scaling each tree to 1) and scaled to 1.  Features by their order in ``features``."""
    spark = SparkSession.active()
    clf = model.stages[-1]
    path = scratch_path(spark, "importance-nodes")
    clf.write().overwrite().save(path)
    stats = F.col("nodeData.impurityStats")
    rows = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if "Forest" in type(clf).__name__ else F.element_at(stats, 1)
    splits = spark.read.parquet(f"{path}/data").where("nodeData.leftChild >= 0").select(
        "treeID", F.col("nodeData.split.featureIndex").alias("f"), (F.col("nodeData.gain") * rows).alias("g"))
    got = splits.groupBy("treeID", "f").agg(F.sum("g").alias("g"))
    if "Forest" in type(clf).__name__:
        got = got.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("treeID")))
    out = [0.0] * len(features)
    for r in got.groupBy("f").agg(F.sum("g").alias("g")).collect():  # one row per feature
        out[r["f"]] = r["g"]
    total = sum(out)
    return [v / total if total else 0.0 for v in out]


def select_top_features(df: DataFrame, features: list[str], n: int, label: str = "label",
                        estimator=None) -> list[str]:
    """M7: quick boosted fit on the given (training) rows, keep the top n by importance."""
    est = estimator or boosted(n_estimators=20, max_depth=4, random_state=42)
    m = fit(df, features, est, label)
    return [f for _, f, _ in importance(m, features, n)]


@dataclass
class Candidate:
    name: str
    estimator: object
    params: dict = field(default_factory=dict)


def best_of(train: DataFrame, valid: DataFrame, features: list[str], candidates: list[Candidate],
            label: str = "label", threshold: float = 0.5) -> tuple[str, PipelineModel, DataFrame]:
    """M5: fit each configuration, keep the best validation accuracy (first on ties).

    Returns (name, model, metrics frame with one row per candidate).
    """
    from churnkit.operators.evaluate import evaluate

    spark = train.sparkSession
    results = []
    best = None
    for order, cand in enumerate(candidates):
        m = fit(train, features, cand.estimator, label)
        scored = predict_proba(m, valid, features, keep=[label])
        met = evaluate(scored.withColumn("pred", (F.col("prob") >= threshold).cast("int")), "pred", label).first()
        results.append((cand.name, order, float(met["accuracy"]), float(met["f1"])))
        if best is None or met["accuracy"] > best[2]:
            best = (cand.name, m, met["accuracy"])
    frame = spark.createDataFrame(results, "model string, order int, accuracy double, f1 double")
    return best[0], best[1], frame
