"""Profiling: one aggregate per question, long output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col

# Name parts that mark a target column.
TARGET_NAME_PARTS = ("churn", "target", "label")


def profile(df: DataFrame) -> DataFrame:
    """Position, name and type of every column, with the row count."""
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    meta = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"))
            for i, f in enumerate(df.schema.fields)]
    return n.select("rows", F.lit(len(df.columns)).alias("columns"),
                    F.explode(F.array(*meta)).alias("c")).select("rows", "columns", "c.*")


def null_counts(df: DataFrame, only_with_nulls: bool = False) -> DataFrame:
    """Nulls per column in one aggregate, unpivoted to (column_name, null_count)."""
    agg = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                   F.col(f"n{i}").alias("null_count"))
                                          for i, c in enumerate(df.columns)])).alias("x")).select("x.*")
    return long.filter(F.col("null_count") > 0) if only_with_nulls else long


def target_candidates(df: DataFrame, max_values: int = 10) -> DataFrame:
    """Columns named like a target, with up to ``max_values`` distinct values each.

    The cap is the feature (a preview); distinct values are ranked per column
    after a distributed distinct, so no column's values pass through one task
    before being reduced.
    """
    from pyspark.sql import Window

    names = [c for c in df.columns if any(p in c.lower() for p in TARGET_NAME_PARTS)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, value_rank int")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                   col(c).cast("string").alias("value"))
                                          for c in names])).alias("p")).select("p.*").distinct()
    w = Window.partitionBy("column_name").orderBy(F.col("value").asc_nulls_first())
    return (pairs.withColumn("value_rank", F.row_number().over(w))
            .filter(F.col("value_rank") <= max_values))
