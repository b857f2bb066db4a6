"""Feature engineering.

All features of a stage are built in one ``select`` so the plan stays one
projection (no ``withColumn`` chains, no codegen fallback from deep plans).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from churnkit.functions.columns import qi, sql_lit

# The six optional add-on services counted by NumServices.
ADDON_SERVICES = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                  "StreamingTV", "StreamingMovies"]
# Tenure bins, right-closed, and their labels.
TENURE_EDGES = [-1, 6, 12, 24, 48, 72]
TENURE_LABELS = ["0-6mo", "7-12mo", "13-24mo", "25-48mo", "49-72mo"]
NEW_CUSTOMER_MAX_TENURE = 3          # training: tenure <= 3
SERVING_NEW_CUSTOMER_BELOW = 6       # serving: tenure < 6


def bucket(c: str, edges: list[float], labels: list[str]) -> str:
    """right-closed bins (e0, e1], (e1, e2], ...; outside -> null (SQL text)."""
    whens = " ".join(f"when {qi(c)} > {lo} and {qi(c)} <= {hi} then {sql_lit(lab)}"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"case {whens} end"


def _mean(cols: list[str]) -> str:
    return "((" + " + ".join(qi(c) for c in cols) + f") / {float(len(cols))}D)"


def row_std_sql(cols: list[str]) -> str:
    """Row-wise sample deviation (n - 1) as SQL text; null for a single column."""
    if len(cols) < 2:
        return "CAST(NULL AS DOUBLE)"
    m = _mean(cols)
    ss = " + ".join(f"({qi(c)} - {m}) * ({qi(c)} - {m})" for c in cols)
    return f"sqrt(({ss}) / {float(len(cols) - 1)}D)"


def _try_div(num: str, den: str) -> str:
    return f"try_divide({num}, {den})"


def _clip(e: str, lo: float, hi: float) -> str:
    return f"case when ({e}) is null then null else greatest({lo}D, least({hi}D, {e})) end"


def snapshot_features(df: DataFrame, variant: str = "training") -> DataFrame:
    """F1-F7 on the account snapshot (categorical columns still text).

    ``TotalCharges`` must be numeric already (C1).  ``variant="serving"``
    gives the serving definitions: /max(tenure, 1), ChargeIncrease as a flag,
    phone service counted among the services, new below 6 months, and no
    tenure group.
    """
    new = snapshot_feature_sql(variant, _is_text(df, "PhoneService") if variant == "serving" else True)
    return df.selectExpr(*[qi(c) for c in df.columns], *[f"{sql} as {qi(name)}" for name, sql in new.items()])


def snapshot_feature_sql(variant: str = "training", phone_is_text: bool = True) -> dict[str, str]:
    """The engineered features as SQL text over the cleaned columns (each name in backquotes)."""
    combo = "cast((`Contract` = 'Month-to-month') and (`PaymentMethod` = 'Electronic check') as int)"
    yes = [f"case when {qi(c)} = 'Yes' then 1 else 0 end" for c in ADDON_SERVICES]
    if variant == "training":
        avg = _try_div("`TotalCharges`", "(`tenure` + 1)")
        return {
            "AvgMonthlySpend": avg,
            "ChargeIncrease": f"(`MonthlyCharges` - {avg})",
            "NumServices": "(" + " + ".join(yes) + ")",
            "TenureGroup": bucket("tenure", TENURE_EDGES, TENURE_LABELS),
            "HighRiskCombo": combo,
            "IsNewCustomer": f"cast(`tenure` <= {NEW_CUSTOMER_MAX_TENURE} as int)",
        }
    if variant == "serving":
        avg = _try_div("`TotalCharges`", "(case when `tenure` = 0 then 1 else `tenure` end)")
        phone = "case when `PhoneService` = 'Yes' then 1 else 0 end" if phone_is_text else "coalesce(cast(`PhoneService` as int), 0)"
        return {
            "AvgMonthlySpend": avg,
            "ChargeIncrease": f"cast(`MonthlyCharges` > {avg} as int)",
            "NumServices": "(" + " + ".join([phone] + yes) + ")",
            "IsNewCustomer": f"cast(`tenure` < {SERVING_NEW_CUSTOMER_BELOW} as int)",
            "HighRiskCombo": combo,
        }
    raise ValueError(f"unknown variant {variant!r}")


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "string"


def common_metrics(columns: list[str], months=(6, 7, 8)) -> list[str]:
    """F8: metric base names present for every month, sorted for a stable order."""
    sets = []
    for m in months:
        suf = f"_{m}"
        sets.append({c[: -len(suf)] for c in columns if c.endswith(suf)})
    common = set.intersection(*sets) if sets else set()
    return sorted(b for b in common if all(f"{b}_{m}" in columns for m in months))


def behaviour_features(df: DataFrame, months=(6, 7, 8), stats=("trend", "avg", "std"),
                       names: str = "base", bases: list[str] | None = None) -> DataFrame:
    """Per metric trend (last - first), mean and sample deviation.

    ``names="base"`` -> ``{base}_trend`` / ``{base}_avg`` / ``{base}_std``;
    ``names="generated"`` -> ``feature_{i}`` in (metric, stat) order.
    """
    bases = bases if bases is not None else common_metrics(df.columns, months)
    first, last = months[0], months[-1]
    new = []
    for b in bases:
        cols = [f"{b}_{m}" for m in months]
        for s in stats:
            if s == "trend":
                e = f"{qi(f'{b}_{last}')} - {qi(f'{b}_{first}')}"
            elif s == "avg":
                e = _mean(cols)
            elif s == "std":
                e = row_std_sql(cols)
            else:
                raise ValueError(f"unknown stat {s!r}")
            new.append((f"{b}_{s}", e))
    if names == "generated":
        new = [(f"feature_{i}", e) for i, (_, e) in enumerate(new)]
    return df.selectExpr(*[qi(c) for c in df.columns], *[f"{e} as {qi(n)}" for n, e in new])


def usage_drop(metric: str, a: int = 7, b: int = 8) -> str:
    """(m_a - m_b) / (m_a + 1) clipped to [-1, 1] (SQL text)."""
    ma, mb = qi(f"{metric}_{a}"), qi(f"{metric}_{b}")
    return _clip(_try_div(f"({ma} - {mb})", f"({ma} + 1)"), -1.0, 1.0)


def consistency(cols: list[str]) -> str:
    """row deviation / (row mean + 1) (SQL text)."""
    return _try_div(row_std_sql(cols), f"({_mean(cols)} + 1)")


def went_quiet(calls: str = "total_ic_mou_8", data: str = "vol_2g_mb_8") -> str:
    """zero calls and zero data in the action month (SQL text)."""
    return f"cast(({qi(calls)} = 0) and ({qi(data)} = 0) as int)"


def matching_columns(columns: list[str], contains: tuple[str, ...], months=(6, 7, 8),
                     ignore_case: bool = False) -> list[str]:
    """Columns whose name contains one of ``contains`` and ends with a month suffix."""
    out = []
    for c in columns:
        name = c.lower() if ignore_case else c
        if any(p in name for p in contains) and any(c.endswith(f"_{m}") for m in months):
            out.append(c)
    return out


def sum_columns(columns: list[str]) -> str:
    """row total with nulls skipped (SQL text)."""
    return "(" + " + ".join(f"coalesce({qi(c)}, 0.0D)" for c in columns) + ")" if columns else "0.0D"


def usage_change_features(df: DataFrame) -> DataFrame:
    """F12-F14 and F9-F11 of the calibrated usage model, in one projection."""
    rech = [c for c in df.columns if "total_rech_amt" in c and re.search(r"_[678]$", c)]
    new = [f"{usage_drop('total_ic_mou')} as `CallUsageDrop_7to8`",
           f"{usage_drop('vol_2g_mb')} as `DataUsageDrop_7to8`"]
    if len(rech) >= 3:
        new.append(f"{consistency(rech)} as `RechargeConsistency`")
    new.append(f"{went_quiet()} as `WentQuiet`")
    staged = df.selectExpr(*[qi(c) for c in df.columns], *new)
    return behaviour_features(staged)


def usage_totals(df: DataFrame) -> DataFrame:
    """Call, data, minute and recharge totals and recharge deviation."""
    cols = df.columns
    calls = matching_columns(cols, ("og_mou", "ic_mou"))
    data = matching_columns(cols, ("vol_2g_mb", "vol_3g_mb"))
    minutes = matching_columns(cols, ("mou",))
    rech = matching_columns(cols, ("rech",), ignore_case=True)
    return df.selectExpr(*[qi(c) for c in cols],
                         f"{sum_columns(calls)} as total_calls_6_8",
                         f"{sum_columns(data)} as total_data_6_8",
                         f"{sum_columns(minutes)} as total_usage_6_8",
                         f"{sum_columns(rech)} as total_rech_6_8",
                         f"{row_std_sql(rech)} as rech_consistency")
