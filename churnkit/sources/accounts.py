"""Account-snapshot and usage file sources."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Column order of the account snapshot upload.
ACCOUNT_FIELDS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
                  "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
                  "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
                  "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
                  "MonthlyCharges", "TotalCharges"]


def account_schema(with_label: bool = False) -> T.StructType:
    fields = ACCOUNT_FIELDS + (["Churn"] if with_label else [])
    return T.StructType([T.StructField(f, T.StringType(), True) for f in fields]
                        + [T.StructField(CORRUPT, T.StringType(), True)])


def read_accounts(spark: SparkSession, path: str, with_label: bool = False) -> DataFrame:
    """CSV with header; every field read as text, then typed leniently.

    Rows with too few or too many fields keep their raw line in
    ``_corrupt_record`` (PERMISSIVE mode) for :func:`split_rejects`.  CSV
    column pruning is off for this read, so a short row is detected whatever
    columns a later query uses.
    """
    raw = (spark.read.schema(account_schema(with_label)).option("header", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("enforceSchema", False).option("columnPruning", False).csv(path))
    return type_accounts(raw)


def type_accounts(raw: DataFrame) -> DataFrame:
    """Lenient typing of a text-typed snapshot (shared by batch and stream reads)."""
    typed = []
    for f in raw.columns:
        c = F.col(f)
        if f == "tenure":
            c = F.trim(c).try_cast("int")
        elif f == "MonthlyCharges":
            c = F.trim(c).try_cast("double")
        elif f == "SeniorCitizen":
            c = F.coalesce(F.trim(c).try_cast("int"), F.when(c == "Yes", 1).when(c == "No", 0))
        typed.append(c.alias(f))
    return raw.select(*typed)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, rejected) by the corrupt-record column; accepted drops it."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad)


def sequential_index(df: DataFrame, out: str = "_row") -> DataFrame:
    """0-based position in input order without a single-partition window.

    Spark deals file splits to partitions by size, so rows are counted per
    (file, split start): in the order of file names, then split starts.  A
    frame that comes from no files is counted per partition.  The offsets table
    has one row per split.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    if df.inputFiles():
        keys = ["_file", "_start"]
        tagged = tagged.withColumn("_file", F.input_file_name()).withColumn("_start", F.input_file_block_start())
    else:
        keys = ["_start"]
        tagged = tagged.withColumn("_start", F.spark_partition_id().cast("long"))
    sizes = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), keys)
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first")).drop(*keys, "_mid", "_off", "_first"))


def ensure_id(df: DataFrame, id_col: str = "customerID") -> DataFrame:
    """Use the id column as text, else ``row_{i}`` in input order."""
    if id_col in df.columns:
        return df.withColumn(id_col, F.col(id_col).cast("string"))
    indexed = sequential_index(df)
    return indexed.select(F.concat(F.lit("row_"), F.col("_row").cast("string")).alias(id_col),
                          *[F.col(f"`{c}`") for c in df.columns])


# Usage columns without a month suffix that hold numbers.
USAGE_NUMBERS = ("loc_og_t2o_mou", "std_og_t2o_mou", "loc_ic_t2o_mou")
MAX_HEADERS = 1000


def first_lines(spark: SparkSession, paths: list[str], at_once: int = 16) -> list[str]:
    """The first line of each file, through the file system that Spark reads it with (and its compression)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(path):
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if "://" in path or path.startswith("file:") else path)
        stream = p.getFileSystem(conf).open(p)
        try:
            codec = codecs.getCodec(p)
            source = codec.createInputStream(stream) if codec is not None else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
            return (reader.readLine() or "").removeprefix("\ufeff")
        finally:
            stream.close()

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(first, paths))


def usage_type(name: str, months=(6, 7, 8, 9)) -> T.DataType:
    """Metrics of a month are numbers, ids and dates text."""
    numeric = any(name.endswith(f"_{m}") for m in months) and not name.startswith(("date_", "last_date"))
    return T.DoubleType() if numeric or name in USAGE_NUMBERS else T.StringType()


def header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` by their header; only first lines are read.  Empty files are left out."""
    files = sorted(spark.read.text(path).inputFiles())
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, first_lines(spark, files)):
        if line:
            names = tuple(n.strip() for n in next(csv.reader([line])))
            if len(set(names)) < len(names):
                raise ValueError(f"{file}: a column name occurs twice")
            groups.setdefault(names, []).append(file)
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    return groups


def read_usage(spark: SparkSession, path: str, months=(6, 7, 8, 9)) -> DataFrame:
    """Wide usage CSV files, each read by its own header.

    Files of one header are read together with an explicit schema (ids and
    ``date_*`` columns as text, every ``*_{month}`` metric as double); the
    groups are put together by column name, and a column that a file lacks is
    null there.  Columns come in the order of the first file, new ones of later
    headers after them.
    """
    out = None
    for names, files in header_groups(spark, path).items():
        schema = T.StructType([T.StructField(n, usage_type(n, months), True) for n in names])
        part = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file with a header in {path}")
    return out


def pivot_usage(long: DataFrame, id_col: str, metric_col: str, month_col: str, value_col: str,
                metrics: list[str], months=(6, 7, 8, 9)) -> DataFrame:
    """S2 long form -> wide: one column per (metric, month) via a listed pivot."""
    keyed = long.withColumn("_mm", F.concat_ws("_", F.col(metric_col), F.col(month_col).cast("string")))
    values = [f"{m}_{mo}" for m in metrics for mo in months]
    return keyed.groupBy(id_col).pivot("_mm", values).agg(F.sum(value_col))
