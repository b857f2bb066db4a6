"""Tree contributions: path-dependent TreeSHAP over whole tables.

The fitted forest / boosted model is written with MLlib's own writer; its
node table (one row per tree node, a size bounded by the model, not the
data) is read back, turned into flat arrays per tree and broadcast.  Scoring
runs over Arrow batches, and each tree is descended once for all rows of a
batch together.

A leaf's game is a product over the features of its path: q where a feature is
known (1 over the cover shares it follows, or 0) and 1 where it is not, times
the leaf's value and cover share.  The Shapley value of feature i is the
integral over t from 0 to 1 of (q_i - 1) times the product of the other
features' t q + 1 - t.  A node's summary is the sum of these products over its
leaves, kept at the Gauss-Legendre points that integrate polynomials of the
tree's depth exactly; dividing it by one feature's factor takes that feature
out.  So every edge is visited once, whatever hangs below it.

For boosted trees everything is on the margin F (MLlib: rawPrediction =
[-F, F], probability = 1 / (1 + exp(-2F))).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.session import scratch_path

ROWS_AT_ONCE = 2048


@dataclass
class TreeArrays:
    left: np.ndarray       # child index or -1 for a leaf
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray      # node output (margin contribution before the tree weight)
    cover: np.ndarray      # training rows reaching the node
    weight: float


def extract_trees(spark, model, kind: str | None = None) -> list[TreeArrays]:
    """Node arrays of every tree of a RandomForest / GBT classification model.

    For a forest the node value is the positive-class probability of the
    leaf (averaged with weight 1/n); for boosted trees the regression output
    with the tree weight.
    """
    clf = model.stages[-1] if isinstance(model, PipelineModel) else model
    kind = kind or ("gbt" if "GBT" in type(clf).__name__ else "forest")
    path = scratch_path(spark, "trees")
    clf.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.rawCount",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).toArrow()  # bounded by the model size
    nodes = nodes.sort_by([("treeID", "ascending"), ("id", "ascending")])
    left, right, feature = (nodes[c].to_numpy().astype(np.int64) for c in ("leftChild", "rightChild", "featureIndex"))
    value, cover = nodes["prediction"].to_numpy(), nodes["rawCount"].to_numpy().astype(float)
    cut = nodes["cut"].fill_null(0.0).to_numpy()
    if kind == "gbt":
        weights = list(clf.treeWeights)
    else:
        weights = [1.0 / clf.getNumTrees] * clf.getNumTrees
        stats = np.array(nodes["impurityStats"].combine_chunks().flatten()).reshape(len(value), -1)
        total = stats.sum(1)
        if stats.shape[1] > 1:
            value = np.where(total > 0, stats[:, 1] / np.maximum(total, 1e-300), value)
    starts = np.flatnonzero(nodes["id"].to_numpy() == 0)
    return [TreeArrays(left[a:b], right[a:b], feature[a:b], cut[a:b], value[a:b], cover[a:b], float(w))
            for a, b, w in zip(starts, [*starts[1:], len(value)], weights)]


def expected_value(tree: TreeArrays) -> float:
    """Cover-weighted mean leaf value (the base value of the tree)."""
    leaves = tree.left < 0
    return float((tree.value[leaves] * tree.cover[leaves]).sum() / tree.cover[0])


def _depth(tree: TreeArrays) -> int:
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := level[tree.left[level] >= 0]):
        depth, level = depth + 1, np.concatenate([tree.left[level], tree.right[level]])
    return depth


def _add_tree(tree: TreeArrays, X: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's Shapley values of the rows of ``X`` (rows x features) to ``phi`` (features x rows)."""
    # n points are exact up to degree 2 n - 1; taking one feature out of a path leaves a degree below the depth
    points, weights = np.polynomial.legendre.leggauss(max(1, (_depth(tree) + 1) // 2))
    t, weights = (points[:, None] + 1) / 2, weights / 2
    columns = X.T

    def descend(node, product, share, known):
        """The node's summary (points x rows), from the product of its path's factors."""
        if tree.left[node] < 0:
            return product * (tree.value[node] * tree.weight * share)
        f = int(tree.feature[node])
        low = columns[f] <= tree.threshold[node]
        before = known.get(f)
        total = 0.0
        for child, met in ((tree.left[node], low), (tree.right[node], ~low)):
            part = tree.cover[child] / tree.cover[node]
            q = np.where(met, 1.0 if before is None else before[0], 0.0) / part
            factor = t * (q - 1) + 1
            below = product * factor if before is None else product * (factor / before[1])
            summary = descend(int(child), below, share * part, known | {f: (q, factor)})
            phi[f] += (q - 1) * (weights @ (summary / factor))
            if before is not None:  # these leaves' last condition on the feature lies here, not above
                phi[f] -= (before[0] - 1) * (weights @ (summary / before[1]))
            total = total + summary
        return total

    if tree.left[0] >= 0:
        descend(0, np.ones((len(weights), len(X))), 1.0, {})


def shap_values(trees: list[TreeArrays], X: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features contributions, base value) for a batch."""
    phi = np.zeros(X.shape[::-1], dtype=float)
    for s in range(0, len(X), ROWS_AT_ONCE):
        for tree in trees:
            _add_tree(tree, X[s:s + ROWS_AT_ONCE], phi[:, s:s + ROWS_AT_ONCE])
    base = sum(expected_value(t) * t.weight for t in trees)
    return phi.T, base


def tree_output(trees: list[TreeArrays], x: np.ndarray) -> float:
    """Model output for one row (margin for boosted trees, mean probability for forests)."""
    total = 0.0
    for t in trees:
        node = 0
        while t.left[node] >= 0:
            node = t.left[node] if x[t.feature[node]] <= t.threshold[node] else t.right[node]
        total += t.value[node] * t.weight
    return total


def batch_output(trees: list[TreeArrays], X: np.ndarray) -> np.ndarray:
    """Model output for every row of a batch: each tree walked for all rows at once."""
    total = np.zeros(X.shape[0])
    rows = np.arange(X.shape[0])
    for t in trees:
        node = np.zeros(X.shape[0], dtype=np.int64)
        inner = t.left[node] >= 0
        while inner.any():
            go_left = X[rows, np.maximum(t.feature[node], 0)] <= t.threshold[node]
            nxt = np.where(go_left, t.left[node], t.right[node])
            node = np.where(inner, nxt, node)
            inner = t.left[node] >= 0
        total += t.value[node] * t.weight
    return total


def tree_contributions(df: DataFrame, model, features: list[str], id_col: str,
                       out: str = "contribs") -> DataFrame:
    """Per row ``contribs`` (feature, value, contribution), ``base_value`` and
    ``model_output``; work is spread over Arrow batches of the input partitions."""
    spark = df.sparkSession
    trees = extract_trees(spark, model)
    bc = spark.sparkContext.broadcast(trees)  # bounded by the model size
    names = list(features)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (f"{id_col} {id_type}, {out} array<struct<feature:string,value:double,contribution:double>>, "
              "base_value double, model_output double")

    def run(batches):
        ts = bc.value
        for b in batches:
            X = np.column_stack([b.column(i + 1).to_numpy() for i in range(len(names))]) if names else np.zeros((b.num_rows, 0))
            phi, base = shap_values(ts, X)
            label = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), len(X))))
            cells = pa.StructArray.from_arrays([label, pa.array(X.ravel()), pa.array(phi.ravel())], ["feature", "value", "contribution"])
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(X) + 1) * len(names)).astype(np.int32)), cells)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.full(len(X), base)), pa.array(batch_output(ts, X))],
                                             [id_col, out, "base_value", "model_output"])

    cols = [F.col(id_col)] + [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in names]
    return df.select(*cols).mapInArrow(run, schema)
