"""Cleaning, casting and encoding.

Every operator is one projection over the input, so Catalyst fuses a chain of
them into a single whole-stage-codegen span; statistics (vocabulary, scaler)
are one aggregate each, fitted once and reused as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.functions.columns import col, qi, sql_lit

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)

# Cleaning of the account snapshot.
BINARY_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
GENDER_MAP = {"Male": 1, "Female": 0}
YES_NO_MAP = {"Yes": 1, "No": 0}
MULTI_COLUMNS = ["MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
                 "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
                 "Contract", "PaymentMethod"]
# Columns the usage cleaning drops when present.
USAGE_DROP = ["mobile_number", "circle_id", "loc_og_t2o_mou", "std_og_t2o_mou", "loc_ic_t2o_mou",
              "last_date_of_month_6", "last_date_of_month_7", "last_date_of_month_8",
              "date_of_last_rech_6", "date_of_last_rech_7", "date_of_last_rech_8",
              "date_of_last_rech_data_6", "date_of_last_rech_data_7", "date_of_last_rech_data_8",
              "total_calls_9", "total_data_9"]
FLAG_NAME_PARTS = ("fb_user", "night_pck_user")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def to_numbers(df: DataFrame, cols: list[str], default: float | None = 0.0) -> DataFrame:
    """C1 over several columns in one projection."""
    targets = set(cols)
    fill = "" if default is None else f", {sql_lit(float(default))}"

    def num(c):
        e = f"try_cast(cast({qi(c)} as string) as double)"
        return f"coalesce({e}{fill}) as {qi(c)}" if fill else f"{e} as {qi(c)}"
    return df.selectExpr(*[num(c) if c in targets else qi(c) for c in df.columns])


def encode_yes_no(df: DataFrame, cols: list[str]) -> DataFrame:
    """Yes/No -> 1/0 for the given columns (absent columns are skipped)."""
    targets = set(cols) & set(df.columns)
    return df.selectExpr(*[f"case when {qi(c)} = 'Yes' then 1 when {qi(c)} = 'No' then 0 end as {qi(c)}"
                           if c in targets else qi(c) for c in df.columns])


def encode_values(df: DataFrame, mappings: dict[str, dict], only_text: bool = False) -> DataFrame:
    """Map listed columns through fixed dictionaries.

    ``only_text``: a column whose type is not string is left as is (the
    senior flag is mapped only when it arrives as Yes/No text).
    """
    out = []
    for c in df.columns:
        m = mappings.get(c)
        if m is None or (only_text and not isinstance(df.schema[c].dataType, T.StringType)):
            out.append(qi(c))
        else:
            whens = " ".join(f"when {qi(c)} = {sql_lit(k)} then {sql_lit(v)}" for k, v in m.items())
            out.append(f"case {whens} end as {qi(c)}")
    return df.selectExpr(*out)


def fill_zero(df: DataFrame, name_parts: tuple = FLAG_NAME_PARTS) -> DataFrame:
    """C4: null -> 0 for flag columns matched by name part and all numeric columns."""
    flags = [c for c in df.columns if any(p in c for p in name_parts)]
    nums = set(numeric_columns(df)) | set(flags)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.selectExpr(*[f"coalesce({qi(c)}, cast(0 as {types[c]})) as {qi(c)}" if c in nums else qi(c)
                           for c in df.columns])


def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop listed columns that exist (silent otherwise)."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_period(df: DataFrame, month: int, keep: tuple = ()) -> DataFrame:
    """Drop every column of the label period (suffix ``_{month}``)."""
    suffix = f"_{month}"
    return df.selectExpr(*[qi(c) for c in df.columns if not c.endswith(suffix) or c in keep])


@dataclass
class Vocabulary:
    """Kept categories per column, fixed at fit time (first sorted value dropped)."""

    kept: dict[str, list[str]] = field(default_factory=dict)

    def dummy_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.kept.items() for v in vs]


def fit_vocabulary(df: DataFrame, cols: list[str], drop_first: bool = True,
                   max_categories: int = 1000) -> Vocabulary:
    """Distinct values of all ``cols`` in one distributed pass.

    The result has one row per (column, value); it reaches the driver only
    after a size check, since it becomes the one-hot schema.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return Vocabulary({})
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), col(c).cast("string").alias("v"))
                                          for c in cols])).alias("p")).select("p.k", "p.v")
    distinct = pairs.filter(F.col("v").isNotNull()).distinct()
    rows = distinct.limit(max_categories + 1).collect()  # one job; the limit is the size check
    if len(rows) > max_categories:
        raise ValueError(f"more than max_categories={max_categories} categories")
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        found[r["k"]].append(r["v"])
    kept = {}
    for c in cols:
        vals = sorted(found[c])
        kept[c] = vals[1:] if drop_first else vals
    return Vocabulary(kept)


def one_hot(df: DataFrame, vocab: Vocabulary, dtype: str = "int") -> DataFrame:
    """Replace each categorical column by ``{col}_{value}`` indicators.

    Null or unseen values give all zeros.  Dummy columns go to the end in
    vocabulary order, like ``get_dummies``.
    """
    encoded = set(vocab.kept)
    rest = [qi(c) for c in df.columns if c not in encoded]
    dummies = [f"cast(case when {qi(c)} = {sql_lit(v)} then 1 else 0 end as {dtype}) as {qi(c + '_' + v)}"
               for c, vs in vocab.kept.items() if c in df.columns for v in vs]
    return df.selectExpr(*rest, *dummies)


def align_columns(df: DataFrame, columns: list[str], keep: tuple = ()) -> DataFrame:
    """Training column list -- add missing as 0.0, fixed order, extras dropped, double."""
    have = set(df.columns)
    out = [qi(k) for k in keep if k in have]
    out += [f"cast({qi(c)} as double) as {qi(c)}" if c in have else f"0.0D as {qi(c)}" for c in columns]
    return df.selectExpr(*out)


def as_vector(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Assemble double columns into an MLlib vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(df)


@dataclass
class Scaler:
    """Population mean / deviation per column (sklearn semantics; 0 -> 1)."""

    mean: dict[str, float]
    scale: dict[str, float]


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """C11 fit: one aggregate computes every mean and population deviation."""
    aggs = []
    for c in cols:
        aggs += [F.avg(col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    mean = {c: float(row[f"m_{c}"] or 0.0) for c in cols}
    scale = {c: (float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) for c in cols}
    return Scaler(mean, scale)


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """C11 statistics as a one-row frame (no driver round trip)."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(col(c).cast("double"))
        aggs += [F.avg(col(c).cast("double")).alias(f"mean_{c}"),
                 F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"scale_{c}")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """C11 apply: (x - mean) / scale as one projection with literal constants."""
    return df.selectExpr(*[f"(cast({qi(c)} as double) - {sql_lit(float(scaler.mean[c]))}) / "
                           f"{sql_lit(float(scaler.scale[c]))} as {qi(c)}" if c in scaler.mean else qi(c)
                           for c in df.columns])


def scale_with_stats(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """C11 apply against a one-row statistics frame (broadcast, bounded to one row)."""
    j = df.crossJoin(F.broadcast(stats))
    return j.select(*[((col(c).cast("double") - F.col(f"mean_{c}")) / F.col(f"scale_{c}")).alias(c)
                      if c in cols else col(c) for c in df.columns])


def clean_accounts(df: DataFrame, keep_label: bool = True) -> DataFrame:
    """C1-C3 on the account snapshot: TotalCharges lenient, Yes/No and gender maps."""
    df = to_numbers(df, ["TotalCharges"]) if "TotalCharges" in df.columns else df
    df = encode_yes_no(df, BINARY_COLUMNS + (["Churn"] if keep_label else []))
    df = encode_values(df, {"gender": GENDER_MAP})
    df = encode_values(df, {"SeniorCitizen": YES_NO_MAP}, only_text=True)
    return df
