"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by exact name; names with spaces or dots are quoted."""
    return F.col(f"`{name}`")


def qi(name: str) -> str:
    """Quoted identifier for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def sql_lit(v) -> str:
    """SQL literal for a Python value (strings quoted, floats exact)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        r = repr(v)
        return f"{r}D" if r.replace("-", "").replace(".", "").isdigit() else f"CAST('{r}' AS DOUBLE)"
    return str(v)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null."""
    c = col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
