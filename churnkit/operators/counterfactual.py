"""Counterfactual scoring: change one factor, hold the rest.

The scenario list is a fixed parameter (28 entries).  An additive score is
worked out in the row: every term once for the row as it is, and per scenario
only the terms that read the changed column, as expressions in which a literal
stands for it.  No row is copied and nothing is shuffled to find the best value
of a factor.  Any other score gets copies of the row (``counterfactuals``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col, qi, sql_lit
from churnkit.operators.clean import Vocabulary, clean_accounts
from churnkit.operators.explain import LinearScore
from churnkit.operators.features import snapshot_feature_sql

# The what-if factors, their raw column and the values tried, in order.
SCENARIOS = [
    ("Contract Type", "Contract", ["Month-to-month", "One year", "Two year"]),
    ("Payment Method", "PaymentMethod",
     ["Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"]),
    ("Internet Service", "InternetService", ["DSL", "Fiber optic", "No"]),
    ("Online Security", "OnlineSecurity", ["Yes", "No"]),
    ("Tech Support", "TechSupport", ["Yes", "No"]),
    ("Tenure", "tenure", [0, 6, 12, 24, 36, 48, 60, 72]),
    ("Monthly Charges", "MonthlyCharges", [20, 40, 60, 80, 100, 120]),
]
MIN_REDUCTION = 0.01


def scenario_rows() -> list[tuple[str, str, int, str, str | None, float | None]]:
    """(factor, column, order, label, text value, numeric value)."""
    rows = []
    for factor, column, values in SCENARIOS:
        for i, v in enumerate(values):
            if column == "tenure":
                rows.append((factor, column, i, f"{v} mo", None, float(v)))
            elif column == "MonthlyCharges":
                rows.append((factor, column, i, f"${v}", None, float(v)))
            else:
                rows.append((factor, column, i, v, v, None))
    return rows


def scenarios(spark) -> DataFrame:
    """W1 as a small DataFrame (for inspection and tests)."""
    return spark.createDataFrame(scenario_rows(), "factor string, column string, order int, label string, "
                                                  "text_value string, num_value double")


def _scenario_array(with_current: bool) -> str:
    """The scenario list as one SQL array literal of structs."""
    rows = scenario_rows()
    if with_current:
        rows = [(None, None, -1, None, None, None)] + rows

    def text(v):
        return "CAST(NULL AS STRING)" if v is None else sql_lit(v)

    items = [f"named_struct('factor', {text(f)}, 'column', {text(c)}, 'order', {o}, 'label', {text(lab)}, "
             f"'text_value', {text(t)}, 'num_value', {'CAST(NULL AS DOUBLE)' if n is None else sql_lit(n)})"
             for f, c, o, lab, t, n in rows]
    return "array(" + ", ".join(items) + ")"


def counterfactuals(raw: DataFrame, score: Callable[[DataFrame], DataFrame], id_col: str = "customerID",
                    prob: str = "churn_probability", with_current: bool = False) -> DataFrame:
    """Every scenario applied to every row of the raw snapshot, scored.

    ``score`` maps a raw-snapshot frame to a frame that keeps the extra
    columns and adds ``prob``.  ``with_current`` adds the unchanged row
    (factor null, order -1), which :func:`best_change` uses as the baseline.
    Output: id, factor, order, label, prob.
    """
    expanded = raw.selectExpr("*", f"explode({_scenario_array(with_current)}) as _s")
    changed = []
    text_cols = {column for _, column, _ in SCENARIOS}
    types = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    for c in raw.columns:
        if c in ("tenure", "MonthlyCharges"):
            changed.append(f"case when _s.column = {sql_lit(c)} then cast(_s.num_value as {types[c]}) "
                           f"else {qi(c)} end as {qi(c)}")
        elif c in text_cols:
            changed.append(f"case when _s.column = {sql_lit(c)} then _s.text_value else {qi(c)} end as {qi(c)}")
        else:
            changed.append(qi(c))
    modified = expanded.selectExpr(*changed, "_s.factor as _factor", "_s.order as _order", "_s.label as _label")
    scored = score(modified)
    return scored.selectExpr(qi(id_col), "_factor as factor", "_order as `order`", "_label as label",
                             f"{qi(prob)} as {qi(prob)}")


def best_change(cf: DataFrame, id_col: str = "customerID", prob: str = "churn_probability") -> DataFrame:
    """Per (customer, factor) the value with the lowest probability (first on
    ties), the reduction from the current probability and whether it is worth it.

    ``cf`` comes from :func:`counterfactuals` with ``with_current=True``.  One
    aggregate per customer (filtered ``min_by`` per factor) combines the 29
    rows of a customer map-side, then the factors are unpacked.
    """
    factors = [f for f, _, _ in SCENARIOS]
    key = F.struct(F.col(prob), F.col("order"))
    val = F.struct(F.col("label").alias("best_value"), F.col(prob).alias("best_probability"))
    aggs = [F.max(F.when(F.col("factor").isNull(), F.col(prob))).alias("current_probability")]
    for i, f in enumerate(factors):
        aggs.append(F.min_by(F.when(F.col("factor") == f, val), F.when(F.col("factor") == f, key)).alias(f"f{i}"))
    per = cf.groupBy(col(id_col)).agg(*aggs)
    long = per.select(col(id_col), "current_probability", F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col(f"f{i}.best_value").alias("best_value"),
                 F.col(f"f{i}.best_probability").alias("best_probability"))
        for i, f in enumerate(factors)])).alias("b"))
    reduction = F.col("current_probability") - F.col("b.best_probability")
    return long.select(col(id_col), "b.factor", "b.best_value", "b.best_probability", "current_probability",
                       reduction.alias("reduction"), (reduction > MIN_REDUCTION).alias("worth_it"))


# ---------------------------------------------------------------- in the row, for additive scores

def _replaced(sql: str, names: dict[str, str]) -> str:
    """``sql`` with the SQL of ``names`` in place of their quoted names."""
    return re.sub(r"`([^`]+)`", lambda m: f"({names[m[1]]})" if m[1] in names else m[0], sql)


def term_inputs(model: LinearScore, vocab: Vocabulary, variant: str = "training") -> list[str]:
    """The model inputs as SQL over the cleaned snapshot: engineered features and indicators written out."""
    features = snapshot_feature_sql(variant)
    dummies = {f"{c}_{v}": f"cast(case when {qi(c)} = {sql_lit(v)} then 1 else 0 end as int)" for c, vs in vocab.kept.items() for v in vs}
    return [_replaced(_replaced(x, dummies | features), features) for _, _, x, _, _ in model.terms]


def scenario_probabilities(raw: DataFrame, model: LinearScore, vocab: Vocabulary, id_col: str = "customerID",
                           variant: str = "training") -> DataFrame:
    """One row per row of ``raw``: its id, ``current_probability`` and per factor (columns f0, f1, ...) the scenarios
    as an array of (prob, order, label)."""
    clean = clean_accounts(raw)
    types = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    inputs = term_inputs(model, vocab, variant)
    terms = [model.contribution(x, coef, centre) for x, (_, _, _, coef, centre) in zip(inputs, model.terms)]
    columns = sorted({column for _, column, _ in SCENARIOS})
    base = clean.selectExpr(qi(id_col), *[f"{t} as _t{i}" for i, t in enumerate(terms)],
                            *[qi(c) for c in sorted({n for x in inputs for n in re.findall(r"`([^`]+)`", x)} | set(columns))
                              if c != id_col])
    factors: dict[str, list[str]] = {}
    for factor, column, order, label, text, number in scenario_rows():
        value = sql_lit(text) if text is not None else f"cast({sql_lit(number)} as {types[column]})"
        parts = [_replaced(t, {column: value}) if qi(column) in t else f"_t{i}" for i, t in enumerate(terms)]
        factors.setdefault(factor, []).append(
            f"named_struct('prob', {model.probability(parts)}, 'order', {order}, 'label', {sql_lit(label)})")
    return base.selectExpr(qi(id_col), f"{model.probability([f'_t{i}' for i in range(len(terms))])} as current_probability",
                           *[f"array({', '.join(v)}) as f{i}" for i, v in enumerate(factors.values())])


def delta_counterfactuals(raw: DataFrame, model: LinearScore, vocab: Vocabulary, id_col: str = "customerID",
                          prob: str = "churn_probability", variant: str = "training") -> DataFrame:
    """W2 for an additive score: the rows of ``counterfactuals`` out of one narrow array per row."""
    wide = scenario_probabilities(raw, model, vocab, id_col, variant)
    cells = ", ".join(f"transform(f{i}, s -> named_struct('factor', {sql_lit(f)}, 'order', s.order, 'label', s.label, "
                      f"{sql_lit(prob)}, s.prob))" for i, (f, _, _) in enumerate(SCENARIOS))
    return wide.selectExpr(qi(id_col), f"inline(concat({cells}))")


def best_changes(raw: DataFrame, model: LinearScore, vocab: Vocabulary, id_col: str = "customerID",
                 variant: str = "training") -> DataFrame:
    """W3 in the row: id, current_probability and ``changes``, one entry per factor (see :func:`best_change`)."""
    wide = scenario_probabilities(raw, model, vocab, id_col, variant)
    # the least struct of a factor: lowest probability, first on ties
    best = ", ".join(f"named_struct('factor', {sql_lit(f)}, 'best', array_min(f{i}))" for i, (f, _, _) in enumerate(SCENARIOS))
    entry = ("named_struct('factor', b.factor, 'best_value', b.best.label, 'best_probability', b.best.prob, 'reduction', "
             f"current_probability - b.best.prob, 'worth_it', current_probability - b.best.prob > {sql_lit(MIN_REDUCTION)})")
    return wide.selectExpr(qi(id_col), "current_probability", f"transform(array({best}), b -> {entry}) as changes")


def delta_best_change(raw: DataFrame, model: LinearScore, vocab: Vocabulary, id_col: str = "customerID",
                      variant: str = "training") -> DataFrame:
    """W3 for an additive score, one row per (customer, factor)."""
    return best_changes(raw, model, vocab, id_col, variant).select(col(id_col), "current_probability", F.inline("changes")).select(
        col(id_col), "factor", "best_value", "best_probability", "current_probability", "reduction", "worth_it")
