"""A kept table of update facts: each new part of the log is folded in once.

The facts of a customer are two structs (``store.update_facts``), whatever the
length of the log.  They lie in buckets of the customer's hash.  Folding a part
writes the buckets that it touches anew, as one more version; a small table,
written last, says for each bucket which version holds.  Earlier parts of the
log and untouched buckets are not read, and a fold that is cut off changes
nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.operators.store import merge_facts, update_facts

BUCKETS = 64
ORDER = "struct<ts:timestamp_ntz,update_id:bigint,status:string,follow_up_notes:string>"


class UpdateFacts:
    """The facts table under ``root``; ``id_type`` is the type of the customer ids."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = f"_cust {id_type}, u {ORDER}, n {ORDER}, version string, bucket int"

    def _versions(self) -> dict[int, tuple[int, str]]:
        """Per bucket the number of the last fold that wrote it and its version; at most ``buckets`` rows a fold."""
        try:
            log = self.spark.read.schema("fold int, part string, version string, bucket int").option(
                "recursiveFileLookup", True).parquet(f"{self.root}/folds")
            self.names = {r["part"]: r["fold"] for r in log.select("part", "fold").distinct().collect()}
        except Exception as e:  # noqa: BLE001 - nothing was folded yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.names = {}
            return {}
        last = log.filter("bucket is not null").groupBy("bucket").agg(F.max(F.struct("fold", "version")).alias("v")).collect()
        return {r["bucket"]: (r["v"]["fold"], r["v"]["version"]) for r in last}

    def _read(self, buckets: dict[int, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/facts")
        pairs = [F.struct(F.lit(v), F.lit(b)) for b, v in sorted(buckets.items())]
        # names folders only: nothing else is opened
        return rows.filter(F.col("version").isin(sorted(set(buckets.values()))) & F.col("bucket").isin(sorted(buckets))
                           ).filter(F.struct("version", "bucket").isin(*pairs))

    def facts(self) -> DataFrame:
        return self._read({b: v for b, (_, v) in self._versions().items()}).drop("version", "bucket")

    def fold(self, part: DataFrame, name: str, customer: str = "customer_id") -> None:
        """Fold one part of the log in; a part that was folded already (by its name) changes nothing."""
        held = self._versions()
        if name in self.names:
            return
        bucket = F.pmod(F.xxhash64("_cust"), F.lit(self.buckets)).cast("int")
        new = update_facts(part.select(F.col(customer), F.col("ts").cast("timestamp_ntz").alias("ts"),
                                       F.col("update_id").cast("bigint").alias("update_id"), "status", "follow_up_notes"), customer)
        version = uuid.uuid4().hex
        path = f"{self.root}/parts/{version}"
        new.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
        new = self.spark.read.schema(self.schema.replace("version string, ", "")).parquet(path)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
        old = self._read({b: held[b][1] for b in touched if b in held}).drop("version", "bucket")
        merged = merge_facts(old, new.drop("bucket")).withColumns({"version": F.lit(version), "bucket": bucket})
        merged.write.mode("append").partitionBy("version", "bucket").parquet(f"{self.root}/facts")
        fold = max(self.names.values(), default=0) + 1
        rows = [(fold, name, version, b) for b in touched] or [(fold, name, version, None)]
        self.spark.createDataFrame(rows, "fold int, part string, version string, bucket int").coalesce(1).write.mode(
            "errorifexists").parquet(f"{self.root}/folds/{fold}")
