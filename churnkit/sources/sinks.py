"""Sinks: risk report CSV (S5), run comparison (S6), prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compare_runs(*runs: tuple[str, DataFrame], label_col: str = "Dataset") -> DataFrame:
    """Tag each metrics frame with its dataset name and stack them by name."""
    tagged = [df.select(F.lit(name).alias(label_col), *df.columns) for name, df in runs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def report_frame(df: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """S5 content: array columns joined with ', ', structs as JSON, highest risk first.

    The sort is a distributed range sort; Spark writes the parts in order.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(", ", c)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out).orderBy(F.col(prob).desc(), *[F.col(f"`{c}`") for c in df.columns if c != prob][:1])


def write_report(df: DataFrame, path: str, prob: str = "churn_probability") -> None:
    """Risk report as CSV with a header, ordered by probability descending."""
    write_csv(report_frame(df, prob), path)


def write_predictions(df: DataFrame, root: str, table: str, date_col: str = "ds",
                      ts_col: str = "timestamp", mode: str = "append") -> None:
    """Append to a Parquet table partitioned by day.

    The day column is derived from the row timestamp so retention can drop
    whole partitions (see :func:`churnkit.operators.store.retain`).
    """
    out = df if date_col in df.columns else df.withColumn(date_col, F.to_date(F.col(ts_col)))
    # a day's rows meet first, a large day in several tasks: few files per day
    out = out.hint("rebalance", F.col(date_col))
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(date_col).parquet(f"{root.rstrip('/')}/{table}"))
