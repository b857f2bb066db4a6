"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROWS_A_PARTITION = 100_000

# Settings every job here relies on: UTC wall clock, ANSI arithmetic (lenient
# parsing is done explicitly with try_cast), AQE for partition coalescing and
# skew splitting of sort-merge joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for the input: shuffle partitions so that each post-shuffle
    partition starts near ``target_partition_bytes`` (AQE coalesces smaller
    ones and splits skewed ones), at least two waves of tasks, and file splits
    of the same size.  Our own broadcasts are bounded tables, so the automatic
    broadcast threshold stays at Spark's default.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }


def get_session(master: str | None = None, app: str = "churnkit",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    On a cluster this must be the shared location named in
    ``spark.checkpoint.dir``; only a local-mode session (tests, bench) may
    fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="churnkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def reliable(df):
    """Materialise ``df`` in the shared checkpoint folder (cuts lineage, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reliable_for_passes(df):
    """Like ``reliable``, read in partitions of some ``ROWS_A_PARTITION`` rows but at least one a core: a learner sends
    the driver a result for every partition in each of its passes."""
    out = reliable(df)
    return out.coalesce(max(1, out.sparkSession.sparkContext.defaultParallelism, -(-out.count() // ROWS_A_PARTITION)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint location for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{next(_counter)}-{os.getpid()}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def shuffle_width(spark: SparkSession, default: int = 200) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001 - conf may be absent on connect sessions
        return default
