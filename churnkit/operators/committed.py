"""The prediction store: four typed tables whose rows count once their write is committed.

A write adds files to several tables and becomes visible as a whole: its rows
carry a key of their own, and one row of the commit log, written last, names
that key.  Readers keep the rows whose key the log names, so a write that is
cut off leaves nothing to see, and it can be made again.  Rows are never
changed in place.  A clean-up writes what survives of the affected keys under a
new key, and its commit says which keys that one replaces.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.functions.columns import col
from churnkit.operators import store

# The four tables of the prediction store.
SCHEMAS = {
    "single_predictions": "id string, customer_id string, timestamp timestamp_ntz, churn_probability double, risk_level string, "
                          "top_factors string, recommended_action string, input_features string",
    "batch_predictions": "id string, batch_id string, customer_id string, timestamp timestamp_ntz, churn_probability double, "
                         "risk_level string, top_factors string, recommended_action string",
    "batch_metadata": "batch_id string, timestamp timestamp_ntz, total_customers bigint, high_risk_count bigint, "
                      "medium_risk_count bigint, low_risk_count bigint, avg_churn_probability double",
    "risk_queue": "id string, customer_id string, timestamp timestamp_ntz, churn_probability double, risk_level string, "
                  "top_factors string, recommended_action string, status string, follow_up_notes string, last_updated timestamp_ntz",
}
LOG = "name string, key string, kind string, at timestamp_ntz, replaces array<string>"
PLACE = ", month date, commit string"  # where a row lies: the month of its timestamp and the key of its write
WIDENS = {"double": {"float", "int", "bigint"}, "bigint": {"int"}, "string": {"int", "bigint"}, "timestamp_ntz": {"timestamp"}}


def conform(rows: DataFrame, table: str, as_of: str) -> DataFrame:
    """The rows in the table's columns and types, without an id.

    A missing timestamp is ``as_of``; lists of factors are joined with commas
    and nested features written as JSON.  Other missing, unknown or wrongly
    typed columns are refused here.  A null customer, a probability outside 0
    to 1 and an unknown level fail the write when they are met.
    """
    want = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMAS[table]).fields if f.name != "id"}
    have = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [f"unknown column {c}" for c in have if c not in want]
    out = []
    for name, kind in want.items():
        c, got = col(name), have.get(name)
        if got is None:
            if name == "timestamp":
                c = F.lit(as_of)
            else:
                wrong.append(f"no column {name}")
                continue
        elif name == "top_factors" and isinstance(got, T.ArrayType):
            c = F.concat_ws(", ", c)
        elif name == "input_features" and isinstance(got, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif got != kind and got.simpleString() not in WIDENS.get(kind.simpleString(), ()):
            wrong.append(f"{name} is {got.simpleString()}, not {kind.simpleString()}")
        out.append(c.cast(kind).alias(name))
    if wrong:
        raise ValueError(f"{table}: " + "; ".join(wrong))
    rows = rows.select(*out)
    checks = {"customer_id": F.col("customer_id").isNotNull(), "churn_probability": F.col("churn_probability").between(0, 1),
              "risk_level": F.col("risk_level").isin(store.HIGH, store.MEDIUM, store.LOW)}
    return rows.select(*[F.when(checks[c], F.col(c)).otherwise(
        F.raise_error(F.lit(f"{table}: bad value of {c}")).cast(want[c])).alias(c) if c in checks else F.col(c) for c in rows.columns])


@dataclass
class Staged:
    """A write whose rows lie in the tables but do not count yet."""

    store: "CommittedStore"
    name: str
    key: str
    kind: str
    at: str
    replaces: tuple[str, ...] = ()

    def commit(self) -> str:
        """Make the rows count; a name that is committed already is an error and changes nothing."""
        row = self.store.spark.createDataFrame([(self.name, self.key, self.kind, list(self.replaces))],
                                               "name string, key string, kind string, replaces array<string>")
        row = row.select("name", "key", "kind", F.lit(self.at).cast("timestamp_ntz").alias("at"), "replaces")
        place = f"{self.store.root}/commits/{hashlib.sha256(self.name.encode()).hexdigest()}"
        row.coalesce(1).write.mode("errorifexists").parquet(place)
        return self.key


class CommittedStore:
    """The four tables and the commit log under ``root``, in storage that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> "CommittedStore":
        out = cls(spark, root)
        for table, ddl in SCHEMAS.items():
            spark.createDataFrame([], ddl + PLACE).write.mode("errorifexists").partitionBy("month", "commit").parquet(f"{out.root}/{table}")
        Staged(out, "created", "", "create", "1970-01-01 00:00:00").commit()
        return out

    # ------------------------------------------------------------------ reading

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{self.root}/commits")

    def keys(self) -> DataFrame:
        """The keys that count (column commit), one row per write."""
        log = self.log()
        gone = log.select(F.explode("replaces").alias("commit"))
        return log.filter("key <> ''").select(F.col("key").alias("commit")).join(gone, "commit", "left_anti")

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table] + PLACE).parquet(f"{self.root}/{table}")

    def read(self, table: str) -> DataFrame:
        """The rows of all committed writes; the keys prune the folders that are read."""
        return self._stored(table).join(self.keys(), "commit", "left_semi").drop("month", "commit")

    def queue(self, updates: DataFrame | None = None) -> DataFrame:
        """The queue, with a log of status updates folded in (Q8)."""
        rows = self.read("risk_queue")
        return rows if updates is None else store.apply_updates(rows, updates)

    # ------------------------------------------------------------------ writing

    def _append(self, rows: DataFrame, table: str, key: str) -> None:
        month = F.trunc(F.to_date("timestamp"), "month")
        fields = [f.name for f in T.StructType.fromDDL(SCHEMAS[table]).fields]
        out = rows.select(*fields, month.alias("month"), F.lit(key).alias("commit"))
        (out.hint("rebalance", F.col("month")).write.mode("append").partitionBy("month", "commit").parquet(f"{self.root}/{table}"))

    def _written(self, table: str, key: str) -> DataFrame:
        return self._stored(table).filter(F.col("commit") == key).drop("month", "commit")

    def _committed(self, name: str) -> bool:
        return not self.log().filter(F.col("name") == name).isEmpty()

    def _start(self, name: str, kind: str, as_of: str) -> Staged:
        if self._committed(name):
            raise ValueError(f"{name} is recorded already")
        return Staged(self, name, uuid.uuid4().hex, kind, as_of)

    @staticmethod
    def _with_id(rows: DataFrame, name: str) -> DataFrame:
        """Ids that a repeated write finds again: a hash of the write's name and the row."""
        return rows.withColumn("id", F.md5(F.concat_ws("|", F.lit(name), F.to_json(F.struct(*[col(c) for c in rows.columns])))))

    def stage_single(self, rows: DataFrame, name: str, as_of: str) -> Staged:
        """Single predictions, and their High ones as pending queue entries."""
        staged = self._start(f"single:{name}", "single", as_of)
        rows = conform(rows, "single_predictions", as_of)
        self._append(self._with_id(rows, staged.name), "single_predictions", staged.key)
        # the queue comes from what was written, so a scorer behind ``rows`` runs once
        written = self._written("single_predictions", staged.key).drop("input_features")
        self._append(store.queue_rows(written), "risk_queue", staged.key)
        return staged

    def stage_batch(self, rows: DataFrame, batch_id: str, as_of: str) -> Staged:
        """A batch of predictions, its High rows in the queue and its row of metadata; an empty batch has zeros there."""
        staged = self._start(f"batch:{batch_id}", "batch", as_of)
        rows = conform(rows.withColumn("batch_id", F.lit(batch_id)), "batch_predictions", as_of)
        self._append(self._with_id(rows, staged.name), "batch_predictions", staged.key)
        written = self._written("batch_predictions", staged.key)
        self._append(store.queue_rows(written), "risk_queue", staged.key)
        meta = store.batch_summary(written, self.spark.range(1).select(F.lit(batch_id).alias("batch_id")))
        meta = meta.withColumn("timestamp", F.coalesce("timestamp", F.lit(as_of).cast("timestamp_ntz")))
        self._append(meta, "batch_metadata", staged.key)
        return staged

    def record_single(self, rows: DataFrame, name: str, as_of: str) -> str:
        """Q1.  ``name`` tells this write from others; recording it twice is an error."""
        return self.stage_single(rows, name, as_of).commit()

    def record_batch(self, rows: DataFrame, batch_id: str, as_of: str) -> str:
        """Q2.  A batch id counts once, however often its write was cut off before."""
        return self.stage_batch(rows, batch_id, as_of).commit()

    # ------------------------------------------------------------------ clean-up

    def _survivors(self, table: str, as_of: str, days: int, updates: DataFrame | None) -> tuple[DataFrame, F.Column]:
        """The committed rows with their key, and whether each one stays."""
        rows = self._stored(table).join(self.keys(), "commit", "left_semi")
        cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
        if table != "risk_queue":
            return rows, F.coalesce(F.col("timestamp") >= cutoff, F.lit(False))
        if updates is not None:
            # the fold decides, the row itself stays as it was written
            rows = store.apply_updates(rows.withColumns({"_status": F.col("status"), "_notes": F.col("follow_up_notes"),
                                                         "_updated": F.col("last_updated")}), updates)
        gone = (F.col("status") == store.RESOLVED) & (F.col("last_updated") < cutoff)
        return rows, ~F.coalesce(gone, F.lit(False))

    def _rewrite(self, staged: Staged, tables: dict[str, DataFrame], keys: list[str]) -> str:
        for table, rows in tables.items():
            rows = rows.filter(F.col("commit").isin(keys))
            if "_status" in rows.columns:
                rows = rows.drop("status", "follow_up_notes", "last_updated").withColumnsRenamed(
                    {"_status": "status", "_notes": "follow_up_notes", "_updated": "last_updated"})
            self._append(rows, table, staged.key)
        staged.replaces = tuple(keys)
        return staged.commit()

    def clear_old(self, as_of: str, days: int, name: str, updates: DataFrame | None = None) -> str | None:
        """Q9 on the stored tables: predictions and metadata older than ``days`` before ``as_of`` go, queue rows if they
        are resolved (with ``updates`` folded in) and were last updated before then.

        Only writes with a row that goes are written again.  None if there is no such row.
        """
        staged = self._start(f"clear:{name}", "clear", as_of)
        kept, affected = {}, None
        for table in SCHEMAS:
            rows, stays = self._survivors(table, as_of, days, updates)
            kept[table] = rows.filter(stays)
            hit = rows.filter(~stays).select("commit").distinct()
            affected = hit if affected is None else affected.unionAll(hit)
        keys = sorted(r["commit"] for r in affected.distinct().collect())  # at most one per write
        return self._rewrite(staged, kept, keys) if keys else None

    def compact(self, as_of: str, name: str) -> str | None:
        """All committed writes as one: fewer files, the same rows.  None if there are fewer than two."""
        staged = self._start(f"compact:{name}", "compact", as_of)
        keys = sorted(r["commit"] for r in self.keys().collect())
        return self._rewrite(staged, {t: self._stored(t) for t in SCHEMAS}, keys) if len(keys) > 1 else None

