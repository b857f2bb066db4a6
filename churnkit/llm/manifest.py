"""Merkle manifest of a dataset: leaf hashes, proofs and a check of tampered rows.

Rows are leaves of one hash tree per value of a column (the language); the
roots of these trees are the leaves of one more tree.  A tree's nodes are cut
into superblocks of ``fanout ** levels`` consecutive ones:

1. upward, each superblock is reduced to one node of the next stage, until
   every tree is a single node;
2. downward, the nodes of a stage are cogrouped with the proof of the
   superblock that they make up, which gives each node its own proof;
3. at the bottom, leaves and the outer nodes that their superblock needs meet
   in one cogroup: local reduction, joining the two halves of the proof and
   folding it happen there together.

A stage is ``fanout ** levels`` times smaller than the one below.  A task
holds one superblock at a time, however many rows a tree has.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from churnkit.session import scratch_path

FANOUT = 2
LEVELS = 9
BROADCAST_RUNS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, at bigint, digest string, n bigint"
OUTER = "tree string, block bigint, path array<string>, subroot string, root string"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    path = scratch_path(df.sparkSession, f"manifest-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


# ------------------------------------------------------------------ inside one superblock

def reduce_block(digests: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """All levels of a superblock from its nodes up.  One of several rises ``levels`` levels; one that is a
    whole tree ends with its root."""
    rows = [digests]
    while len(rows) <= levels and not (alone and len(rows[-1]) == 1):
        row = rows[-1]
        rows.append([digest("".join(row[i:i + fanout])) for i in range(0, len(row), fanout)])
    return rows


def siblings(rows: list[list[str]], i: int, fanout: int) -> list[str]:
    """The others of node ``i``'s run on each level, as ``left|right``."""
    out = []
    for row in rows[:-1]:
        first = i - i % fanout
        out.append("".join(row[first:i]) + "|" + "".join(row[i + 1:first + fanout]))
        i //= fanout
    return out


def fold(start: str, path: list[str]) -> str:
    for step in path:
        left, right = step.split("|")
        start = digest(left + start + right)
    return start


def _rows(nodes: pd.DataFrame, fanout: int, levels: int) -> list[list[str]]:
    return reduce_block(nodes["digest"].tolist(), fanout, levels, nodes["n"].iat[0] <= fanout ** levels)


def _reducer(fanout: int, levels: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        top = _rows(nodes, fanout, levels)[-1]
        size = fanout ** levels
        return pd.DataFrame({"tree": [nodes["tree"].iat[0]], "at": [nodes["at"].iat[0] // size], "digest": top,
                             "n": [-(-nodes["n"].iat[0] // size)]})
    return run


def _proofs(fanout: int, levels: int):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        rows = _rows(nodes, fanout, levels)
        path = list(outer["path"].iat[0])
        return pd.DataFrame({"tree": nodes["tree"], "block": nodes["at"],
                             "path": [siblings(rows, i, fanout) + path for i in range(len(nodes))],
                             "subroot": outer["subroot"].iat[0], "root": outer["root"].iat[0]})
    return run


def _finisher(fanout: int, levels: int):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("at")
        rows = _rows(leaves, fanout, levels)
        path, root = list(outer["path"].iat[0]), outer["root"].iat[0]
        proofs = [siblings(rows, i, fanout) + path for i in range(len(leaves))]
        seen = leaves["changed"].where(leaves["changed"].notna(), leaves["digest"])
        folded = [fold(start, proof) for start, proof in zip(seen, proofs)]
        return pd.DataFrame({"tree": leaves["tree"], "at": leaves["at"], "id": leaves["id"], "leaf": leaves["digest"],
                             "subroot": outer["subroot"].iat[0], "root": root,
                             "proof_sha256": [digest("".join(p).replace("|", "")) for p in proofs],
                             "folded_root": folded, "verified": [f == root for f in folded]})
    return run


# ------------------------------------------------------------------ whole trees

def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``at`` (from 0) in their ``tree`` by ``order``, and the tree's size ``n``.

    Rows are dealt out by range, so a tree of any size is spread over all
    partitions; only the counts per tree and partition are added up.  Rows
    equal in ``order`` are spread by their place in the input.
    """
    keys = ["tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_row", 33)
    runs = placed.groupBy("tree", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and one per tree
    runs = written(runs.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                               F.sum("_n").over(tree).alias("n")), "runs")
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    return (placed.withColumn("_part", part).join(runs, ["tree", "_part"])
            .withColumn("at", F.col("_before") + F.col("_row") - F.col("_first"))
            .drop("_part", "_row", "_first", "_before"))


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / size))


def grow(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The stages of all trees from ``nodes`` up, and per tree its root and the stage whose only superblock made it."""
    stages, roots = [], None
    while True:
        stages.append(nodes)
        up = written(_blocks(nodes.select("tree", "at", "digest", "n"), fanout ** levels).groupBy("tree", "block")
                     .applyInPandas(_reducer(fanout, levels), NODE), f"stage{len(stages)}")
        done = up.where("n = 1").select("tree", "digest", F.lit(len(stages) - 1).alias("stage"))
        roots = done if roots is None else roots.unionAll(done)
        nodes = up.where("n > 1")
        if nodes.isEmpty():
            return stages, roots


def hang(stages: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The outer proof (tree, block, path, subroot, root) of every superblock of the lowest stage.

    ``tops`` has each tree's own path, subroot, root and the stage of its only superblock.
    """
    outer = None
    for s in reversed(range(len(stages))):
        here = tops.where(F.col("stage") == s).select("tree", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root")
        outer = here if outer is None else here.unionAll(outer)
        if s:
            nodes = _blocks(stages[s], fanout ** levels).groupBy("tree", "block")
            outer = written(nodes.cogroup(outer.groupBy("tree", "block")).applyInPandas(_proofs(fanout, levels), OUTER),
                            f"proofs{s}")
    return outer


def manifest(df: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             changed: tuple[Column, dict[str, Column]] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``df``: its id, tree value and place, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the ``fields`` in their order; other columns do
    not matter.  ``changed`` (condition, replaced fields) stands for rows met
    again in another state: where the condition holds, folded_root starts at
    the leaf of the replaced fields instead.

    Null, empty and very long values are hashed as they are; a null tree value
    has a tree of its own, before all others.  Null ids come first in their
    tree, equal ids go by leaf, and repeated rows are leaves of their own side
    by side.  An empty table gives no rows.
    """
    values = {f: df[f] for f in fields}
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed[0], leaf_digest([changed[1].get(f, v) for f, v in values.items()]))
    tree = F.coalesce(F.concat(F.lit("="), df[tree_col].cast("string")), F.lit("-"))  # null sorts first
    # the texts are read once; all that follows works on digests
    leaves = written(df.select(tree.alias("tree"), df[id_col].alias("key"), leaf_digest(list(values.values())).alias("digest"),
                               other.alias("changed")), "leaves")
    # ids travel as text: pandas has no integers beside nulls
    leaves = ranked(leaves, ["key", "digest"]).withColumn("id", F.col("key").cast("string")).drop("key")
    stages, subroots = grow(leaves, fanout, levels)
    crown = written(ranked(subroots.withColumnRenamed("tree", "child").withColumn("tree", F.lit("")), ["child"]), "subroots")
    above, root = grow(crown, fanout, levels)
    tops = root.select("tree", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"),
                       F.col("digest").alias("root"), "stage")
    paths = (_blocks(crown, fanout ** levels).groupBy("tree", "block")
             .cogroup(hang(above, tops, fanout, levels).groupBy("tree", "block"))
             .applyInPandas(_proofs(fanout, levels), OUTER))
    tops = written(crown.join(paths.select(F.col("block").alias("at"), "path", "root"), "at").select(
        F.col("child").alias("tree"), "path", F.col("digest").alias("subroot"), "root", "stage"), "tops")
    out = (_blocks(leaves, fanout ** levels).groupBy("tree", "block")
           .cogroup(hang(stages, tops, fanout, levels).groupBy("tree", "block"))
           .applyInPandas(_finisher(fanout, levels),
                          "tree string, at bigint, id string, leaf string, subroot string, root string, "
                          "proof_sha256 string, folded_root string, verified boolean"))
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias("doc_id"),
                      F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)).alias("lang"), F.col("at").alias("position"),
                      "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
