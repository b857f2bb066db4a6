"""Global-order operators that stay distributed.

An ordered window without ``partitionBy`` runs on a single task.  Running
totals over a global order are computed here in two levels instead:

1. collapse the input to distinct keys (hash aggregate with map-side
   combine, so a hot key costs one row per mapper);
2. cut the key range into order-preserving slices;
3. per-slice totals (one row per present slice, a bounded number) ->
   exclusive prefix offsets; the offsets table is the only broadcast;
4. a window partitioned by slice adds the in-slice running sum to the
   slice's offset.

The split points only balance the work; results are exact whatever they are.
Slices are order-preserving functions of the key computed per row: fixed
width for keys of a known range (probabilities), binade + mantissa prefix
for any other double, or (on request) cuts at sampled quantiles, which cost
one extra pass but balance any distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 20000  # bound of the broadcast offsets table
RANGE_BUCKETS = 4096  # fixed slices over a known key range


def _slice_column(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    if buckets <= 1:
        return df.withColumn("_slice", F.lit(0)), "_slice"
    from pyspark.ml.feature import Bucketizer

    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), probs, 10 * buckets)).first()
    # at most `buckets` doubles reach the driver; the slice search is a JVM binary search
    cuts = sorted(set(float(x) for x in (row[0] or [])))
    splits = [float("-inf")] + cuts + [float("inf")]
    keyed = df.withColumn("_key_d", F.col(key).cast("double"))
    tagged = Bucketizer(splits=splits, inputCol="_key_d", outputCol="_slice_d",
                        handleInvalid="keep").transform(keyed)
    return tagged.withColumn("_slice", F.col("_slice_d").cast("int")).drop("_key_d", "_slice_d"), "_slice"


def _binade_slice_column(df: DataFrame, key: str, sub_bits: int = 6) -> tuple[DataFrame, str]:
    """Order-preserving slices of any double, computed per row (no sampling pass).

    Positive values: (binade e = floor(log2 v), first ``sub_bits`` mantissa
    bits); negatives mirrored below zero.  ``log2`` is monotone and division
    by 2^e is exact, so the slice number never decreases as the key grows.
    Present slices are at most 2 x 2100 x 2^sub_bits, which bounds the
    broadcast offsets table.
    """
    subs = 1 << sub_bits
    v = F.col(key).cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a))
    sub = F.least(F.greatest(F.floor((a / F.pow(F.lit(2.0), e) - F.lit(1.0)) * F.lit(subs)), F.lit(0)),
                  F.lit(subs - 1))
    mag = (e + F.lit(1100)) * F.lit(subs) + sub          # in [0, 2200 * subs)
    span = 2200 * subs
    inf = float("inf")
    s = (F.when(F.isnan(v), F.lit(3 * span + 1)).when(v == inf, F.lit(3 * span))
         .when(v == -inf, F.lit(-1)).when(v > 0, F.lit(2 * span) + mag).when(v == 0, F.lit(span))
         .otherwise(F.lit(span) - F.lit(1) - mag)).cast("long")
    return df.withColumn("_slice", s), "_slice"


def _range_slice_column(df: DataFrame, key: str, buckets: int, lo: float, hi: float) -> tuple[DataFrame, str]:
    """Uniform slices of a known value range (no sampling pass)."""
    width = (hi - lo) / buckets
    s = F.floor((F.col(key).cast("double") - F.lit(lo)) / F.lit(width)).cast("int")
    return df.withColumn("_slice", F.least(F.greatest(s, F.lit(0)), F.lit(buckets - 1))), "_slice"


def running_totals(df: DataFrame, key: str, measures: list[str], descending: bool = False,
                   buckets: int | None = None, by: list[str] | None = None,
                   value_range: tuple[float, float] | None = None) -> DataFrame:
    """Inclusive running sums of ``measures`` over the order of ``key`` (per ``by`` group).

    ``df`` must hold one row per distinct (``by``, ``key``) (collapse it first,
    see :func:`distinct_totals`).  Output columns: the input plus ``cum_<m>``.
    The offsets table holds one row per (group, slice); groups are few
    (models, labels) in every use here.
    """
    by = list(by or [])
    if value_range is not None:
        # keys in a known range (scores in [0, 1]): fixed slices, one plan, no extra pass
        n = min(MAX_BUCKETS, buckets or RANGE_BUCKETS)
        tagged, s = _range_slice_column(df, key, n, *value_range)
    elif buckets:
        # explicit bucket count: cut at sampled quantiles (one extra pass)
        n = min(MAX_BUCKETS, buckets)
        tagged, s = _slice_column(df, key, n)
    else:
        n = 0
        tagged, s = _binade_slice_column(df, key)
    if descending:
        tagged = tagged.withColumn(s, -F.col(s))
    totals = tagged.groupBy(*by, s).agg(*[F.sum(m).alias(f"_tot_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, s, *[F.coalesce(F.sum(f"_tot_{m}").over(before), F.lit(0))
                                      .alias(f"_off_{m}") for m in measures])
    order = F.col(key).desc() if descending else F.col(key).asc()
    within = Window.partitionBy(*by, s).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offsets), [*by, s])
    return out.select(*df.columns, *[(F.sum(m).over(within) + F.col(f"_off_{m}")).alias(f"cum_{m}")
                                     for m in measures])


def distinct_totals(df: DataFrame, key: str, measures: dict) -> DataFrame:
    """Collapse to one row per key: ``measures`` maps output name -> Column."""
    return df.groupBy(key).agg(*[c.alias(name) for name, c in measures.items()])


def exact_quantile(df: DataFrame, col_name: str, q: float, buckets: int | None = None) -> DataFrame:
    """One-row frame ``quantile``: linear-interpolated q-quantile (pandas, ``percentile``).

    position h = (n-1)q; value = x[floor h] + (h - floor h)(x[floor h + 1] - x[floor h]).
    Distributed: value counts -> running counts -> the two order statistics.
    """
    vals = df.select(F.col(col_name).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = distinct_totals(vals, "v", {"n": F.count(F.lit(1))})
    cum = running_totals(counts, "v", ["n"], buckets=buckets)
    total = vals.agg(F.count(F.lit(1)).alias("total"))
    pos = total.select("total", (F.col("total") - 1).cast("double") * F.lit(q)).toDF("total", "h")
    pos = pos.select("total", "h", F.floor("h").cast("long").alias("lo"),
                     (F.col("h") - F.floor("h")).alias("frac"))
    j = cum.crossJoin(F.broadcast(pos))  # pos is one row
    # x[r] (0-based) = smallest v with cum_n > r
    stats = j.agg(
        F.min_by("v", F.when(F.col("cum_n") > F.col("lo"), F.col("cum_n"))).alias("x_lo"),
        F.min_by("v", F.when(F.col("cum_n") > F.col("lo") + 1, F.col("cum_n"))).alias("x_hi"),
        F.first("frac").alias("frac"), F.first("total").alias("total"))
    return stats.select(
        F.when(F.col("total") == 0, F.lit(None).cast("double"))
         .when((F.col("frac") == 0) | F.col("x_hi").isNull(), F.col("x_lo"))
         .otherwise(F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * F.col("frac")).alias("quantile"))
