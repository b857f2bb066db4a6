"""Stratified split, three-way split, folds, class weights.

Rows are ordered inside their class by ``md5(id || ':' || seed)``, so the
split is reproducible, independent of partitioning, and checkable by an oracle.

A split needs no ranks, only the hash at which a part ends.  It is found by
distributed selection: counts per class and hash prefix tell which prefix the
rank falls in, longer prefixes are counted inside that one alone, until few
enough hashes are left to look at.  Each row is then compared with its class's
cuts where it lies; no row moves.

Folds are ranks modulo k and need the ranks themselves.  They are computed
without a class-wide window: the hash is uniform, so its first hex digits cut
each class into equal slices; slice sizes (a table of classes x slices rows)
give offsets, and the row number inside (class, slice) finishes the rank.  A
class holding most rows is spread over all slices.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.columns import col

SLICE_HEX_DIGITS = 3  # 4096 slices per class
LOOKED_AT = 4096  # hashes of one prefix that are few enough to look at
MAX_CLASSES = 100


def hash_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(col(id_col).cast("string"), F.lit(f":{seed}")))


def class_rank(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``_rank`` (1-based rank inside the class by hash order) and ``_class_n``."""
    h = hash_key(id_col, seed)
    tagged = df.withColumn("_h", h).withColumn("_slice", F.substring("_h", 1, SLICE_HEX_DIGITS))
    sizes = tagged.groupBy(col(label).alias("_rk_cls"), "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_rk_cls").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_rk_cls")
    offsets = sizes.select("_rk_cls", F.col("_slice").alias("_oslice"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           F.sum("_n").over(whole).alias("_class_n"))
    # classes x slices rows: bounded broadcast
    j = tagged.join(F.broadcast(offsets), col(label).eqNullSafe(F.col("_rk_cls")) & (F.col("_slice") == F.col("_oslice")))
    within = Window.partitionBy(col(label), F.col("_slice")).orderBy("_h", col(id_col))
    return j.select(*[col(c) for c in df.columns],
                    (F.row_number().over(within) + F.col("_off")).alias("_rank"), F.col("_class_n"))


def _below(keyed: DataFrame, inside: list[tuple]) -> DataFrame:
    """The rows below (class, prefix) pairs, with the prefix; one pair per class and cut, so a bounded broadcast."""
    kind = keyed.schema["_cls"].dataType.simpleString()
    near = keyed.sparkSession.createDataFrame(inside, f"_c {kind}, _p string")
    return keyed.join(F.broadcast(near), F.col("_cls").eqNullSafe(F.col("_c")) & F.startswith(F.col("_h"), F.col("_p"))).drop("_c")


def _histogram(keyed: DataFrame, digits: int) -> dict | None:
    """{class: {prefix: rows}} of hash prefixes of ``digits``; None if there are more than MAX_CLASSES classes' worth."""
    most = MAX_CLASSES << 4 * SLICE_HEX_DIGITS
    rows = keyed.groupBy("_cls", F.substring("_h", 1, digits).alias("_s")).count().limit(most + 1).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["_cls"], {})[r["_s"]] = r["count"]
    return out if len(rows) <= most else None


def select_hashes(df: DataFrame, label: str, id_col: str, fracs: list[Fraction], seed: int = 42,
                  looked_at: int = LOOKED_AT) -> dict | None:
    """{class: [the hash of rank ceil(frac * n), or None for rank 0, per frac]}: exact, whatever the number of rows.
    None if there are too many classes."""
    keyed = df.select(col(label).alias("_cls"), hash_key(id_col, seed).alias("_h"))
    digits, found = SLICE_HEX_DIGITS, _histogram(keyed, SLICE_HEX_DIGITS)
    if found is None:
        return None
    cuts = {c: [None] * len(fracs) for c in found}
    # cuts not yet found: the prefix that they lie below and their rank among its rows
    todo = {}
    for c, slices in found.items():
        n = sum(slices.values())
        todo |= {(c, i): ("", -(-f.numerator * n // f.denominator)) for i, f in enumerate(fracs) if f}
    while todo:
        for (c, i), (prefix, rank) in todo.items():
            for longer in sorted(s for s in found[c] if s.startswith(prefix)):
                if rank <= found[c][longer]:
                    break
                rank -= found[c][longer]
            todo[c, i] = (longer, rank)
        few = {k: v for k, v in todo.items() if found[k[0]][v[0]] <= looked_at or digits >= 32}
        if few:
            held: dict = {}
            rows = _below(keyed, sorted({(c, p) for (c, _), (p, _) in few.items()}, key=repr))
            for r in rows.groupBy("_cls", "_p", "_h").count().collect():  # equal ids share a hash
                held.setdefault((r["_cls"], r["_p"]), []).append((r["_h"], r["count"]))
            for (c, i), (p, rank) in few.items():
                for h, n in sorted(held[c, p]):
                    rank -= n
                    if rank <= 0:
                        cuts[c][i] = h
                        break
        todo = {k: v for k, v in todo.items() if k not in few}
        if todo:
            digits += SLICE_HEX_DIGITS
            found = _histogram(_below(keyed, sorted({(c, p) for (c, _), (p, _) in todo.items()}, key=repr)), digits)
    return cuts


def stratified_split(df: DataFrame, label: str, id_col: str, fracs=(0.2,), names=("test", "train"),
                     seed: int = 42, out: str = "part") -> DataFrame:
    """B1/B2: per class, the first ceil(f1 n) rows in hash order are part 1, the
    next up to ceil((f1+f2) n) part 2, ..., the rest the last part.  Rows of one
    id stay together, in the part that the first of them falls in."""
    if len(names) != len(fracs) + 1:
        raise ValueError("need one more name than fractions")
    ends, total = [], Fraction(0)
    for f in fracs:
        total += Fraction(str(f))
        ends.append(total)
    cuts = select_hashes(df, label, id_col, ends, seed)
    if cuts is None:  # so many classes that their ranks are the smaller table
        ranked = class_rank(df, label, id_col, seed)
        part = F.lit(names[-1])
        for end, name in zip(ends[::-1], names[-2::-1]):
            part = F.when(F.col("_rank") <= ceil_frac(F.col("_class_n"), end), name).otherwise(part)
        return ranked.select(*[col(c) for c in df.columns], part.alias(out))
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(c, v) for c, v in cuts.items()], f"_c {kind}, _cuts array<string>")
    h = hash_key(id_col, seed)
    expr = None
    for i, name in enumerate(names[:-1]):
        cond = h <= F.col("_cuts")[i]
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    j = df.join(F.broadcast(table), col(label).eqNullSafe(F.col("_c")))  # one row per class, at most MAX_CLASSES
    return j.select(*[col(c) for c in df.columns], expr.otherwise(names[-1]).alias(out))


def ceil_frac(n: F.Column, frac: Fraction) -> F.Column:
    """ceil(frac * n) as floor((n p + q - 1) / q) with frac = p / q.

    The numerator is an exact integer; its quotient by q is at least 1/q away
    from the next integer, far above double rounding for any row count.
    """
    p, q = frac.numerator, frac.denominator
    return F.floor((n * F.lit(p) + F.lit(q - 1)) / F.lit(q)).cast("long")


def fold_ids(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
             out: str = "fold") -> DataFrame:
    """Stratified k folds, ``(rank - 1) % k`` inside each class."""
    ranked = class_rank(df, label, id_col, seed)
    return ranked.select(*[col(c) for c in df.columns], ((F.col("_rank") - 1) % k).cast("int").alias(out))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """weight = n / (2 n_class) -- balanced weights for a binary label."""
    counts = df.groupBy(col(label).alias("_rk_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(F.broadcast(total)).select(
        "_rk_cls", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    # classes x 1 rows: bounded broadcast
    return df.join(F.broadcast(w), col(label).eqNullSafe(F.col("_rk_cls"))).drop("_rk_cls")
