"""Contributions, factors, actions and plain-English reasons.

Every customer's contributions travel as one array column
``contribs: array<struct<feature, value, contribution>>`` on its own row, so
top-k factors, rule matching, descriptions and texts are higher-order
functions over that array: map-side only, no shuffle and no join.  The
dictionaries below are literal maps / CASE chains evaluated in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.functions.columns import col, qi, sql_lit

# ---------------------------------------------------------------- fixed values
# Human-readable feature descriptions.
FEATURE_DESCRIPTIONS = {
    "gender": "Customer gender",
    "SeniorCitizen": "Senior citizen status",
    "Partner": "Having a partner",
    "Dependents": "Having dependents",
    "tenure": "How long they have been a customer",
    "PhoneService": "Having phone service",
    "PaperlessBilling": "Using paperless billing",
    "MonthlyCharges": "Monthly bill amount",
    "TotalCharges": "Total amount spent",
    "Contract_Month-to-month": "Month-to-month contract",
    "Contract_One year": "One-year contract",
    "Contract_Two year": "Two-year contract",
    "PaymentMethod_Electronic check": "Paying by electronic check",
    "PaymentMethod_Mailed check": "Paying by mailed check",
    "PaymentMethod_Credit card (automatic)": "Automatic credit card payment",
    "PaymentMethod_Bank transfer (automatic)": "Automatic bank transfer",
    "MultipleLines_Yes": "Having multiple phone lines",
    "MultipleLines_No phone service": "No phone service",
    "InternetService_Fiber optic": "Fiber optic internet",
    "InternetService_DSL": "DSL internet",
    "InternetService_No": "No internet service",
    "OnlineSecurity_Yes": "Having online security",
    "OnlineSecurity_No internet service": "No internet service",
    "OnlineBackup_Yes": "Having online backup",
    "OnlineBackup_No internet service": "No internet service",
    "DeviceProtection_Yes": "Having device protection",
    "DeviceProtection_No internet service": "No internet service",
    "TechSupport_Yes": "Having tech support",
    "TechSupport_No internet service": "No internet service",
    "StreamingTV_Yes": "Having streaming TV",
    "StreamingTV_No internet service": "No internet service",
    "StreamingMovies_Yes": "Having streaming movies",
    "StreamingMovies_No internet service": "No internet service",
    "AvgMonthlySpend": "Average monthly spending",
    "ChargeIncrease": "Recent bill increase",
    "NumServices": "Number of services subscribed",
    "IsNewCustomer": "Being a new customer",
    "HighRiskCombo": "High-risk profile (month-to-month + electronic check)",
}

# Half-open value ranges [low, high) and their phrases.
NUMERICAL_RANGES = {
    "tenure": [(0, 6, "new customer"), (6, 24, "short-term customer"),
               (24, 48, "mid-term customer"), (48, 100, "long-term customer")],
    "MonthlyCharges": [(0, 40, "low monthly bill"), (40, 80, "moderate monthly bill"),
                       (80, 120, "high monthly bill"), (120, 200, "very high monthly bill")],
    "TotalCharges": [(0, 500, "low total spend"), (500, 2000, "moderate total spend"),
                     (2000, 5000, "high total spend"), (5000, 100000, "very high total spend")],
    "AvgMonthlySpend": [(0, 40, "low average monthly spend"), (40, 80, "moderate average monthly spend"),
                        (80, 120, "high average monthly spend"), (120, 200, "very high average monthly spend")],
    "NumServices": [(0, 2, "few services"), (2, 4, "moderate number of services"),
                    (4, 6, "many services"), (6, 10, "very many services")],
}

# Strength words by absolute contribution (upper bounds, exclusive).
STRENGTH_WORDS = [(0.1, "slightly"), (0.3, "moderately"), (0.5, "significantly")]
STRENGTH_TOP = "very strongly"

# Retention action rules, checked in this order against each factor name.
ACTION_RULES = [
    ("Contract", "Offer discount to upgrade to a longer-term contract for better lock-in."),
    ("HighRiskCombo", "High-risk profile (month-to-month + electronic check) — prioritize proactive outreach."),
    ("InternetService_Fiber optic", "Investigate fiber service quality or offer a fiber plan discount."),
    ("PaymentMethod_Electronic check", "Encourage switch to auto-debit/UPI with a small incentive."),
    ("PaperlessBilling", "Offer a loyalty reward tied to billing preference."),
    ("ChargeIncrease", "Recent bill increase detected — consider a loyalty discount to offset it."),
    ("MonthlyCharges", "Offer a bundled discount to reduce effective monthly cost."),
    ("IsNewCustomer", "New customer — assign to onboarding/early retention outreach program."),
    ("tenure", "Assign to early-tenure onboarding/retention outreach program."),
    ("NumServices", "Low service engagement — offer a bundle to increase platform investment."),
    ("OnlineSecurity", "Bundle free online security add-on for 3 months."),
    ("TechSupport", "Proactively offer free tech support session."),
]
DEFAULT_ACTION = "Review customer profile for a tailored retention offer."

# Text of the explanation blocks.
POS_ONE = "The main factor increasing churn risk is:"
POS_MANY = "The main factors increasing churn risk are:"
NEG_ONE = "\nThe main factor reducing churn risk is:"
NEG_MANY = "\nThe main factors reducing churn risk are:"
CLOSE_MIXED = "\nOverall, the customer's profile shows competing factors that influence their churn probability."
CLOSE_POS = "\nOverall, the customer's profile indicates elevated churn risk."
CLOSE_NEG = "\nOverall, the customer's profile indicates lower churn risk."
BULLET = "• "
SUMMARY_HIGH, SUMMARY_MODERATE = 0.6, 0.3

SINGLE_TOP_N, BATCH_TOP_N, REASON_TOP_N = 5, 3, 3


# ---------------------------------------------------------------- contributions

@dataclass
class LinearScore:
    """p = sigmoid(intercept + sum coef * (x - centre)).

    ``terms``: (feature name, value SQL, model input SQL, coef, centre); the
    value is what texts show, the input what the model multiplies.
    """

    intercept: float
    terms: list[tuple[str, str, str, float, float]]
    digits: int | None = 6

    @staticmethod
    def contribution(x: str, coef: float, centre: float) -> str:
        # a missing input sits at the centre: no contribution
        return f"{sql_lit(coef)} * (coalesce({x}, {sql_lit(centre)}) - {sql_lit(centre)})"

    def probability(self, contributions: list[str]) -> str:
        """SQL of the probability from the contributions' SQL, added up in the order of the terms."""
        z = " + ".join([sql_lit(float(self.intercept)), *contributions])
        p = f"1.0D / (1.0D + exp(-({z})))"
        return p if self.digits is None else f"round({p}, {self.digits})"


def fixture_linear_score() -> LinearScore:
    """The fixed linear score of FIXTURES.md 2.5 on encoded account columns."""
    terms = [
        ("tenure", "cast(`tenure` as double)", "cast(`tenure` as double)", -0.02, 60.0),
        ("MonthlyCharges", "`MonthlyCharges`", "`MonthlyCharges` / 100000.0D", 0.15, 2.0),
        ("NumServices", "cast(`NumServices` as double)", "cast(`NumServices` as double)", -0.1, 4.0),
    ]
    for name, coef, centre in [("HighRiskCombo", 0.8, 0.2), ("Contract_One year", -0.3, 0.4),
                               ("Contract_Two year", -0.7, 0.2), ("InternetService_Fiber optic", 0.5, 0.4),
                               ("PaymentMethod_Electronic check", 0.35, 0.4)]:
        c = f"cast({qi(name)} as double)"
        terms.append((name, c, c, coef, centre))
    return LinearScore(-0.4, terms)


def linear_contributions(df: DataFrame, model: LinearScore, prob: str = "churn_probability",
                         out: str = "contribs", with_text: bool = False) -> DataFrame:
    """Per-row contribution array and probability (exact Shapley values of a
    linear model with independent features, relative to the centres).

    ``with_text`` adds each element's description, strength and sentence.
    Feature names are known when the plan is built, so these are plain
    (code-generated) expressions on that feature's own columns; leave them
    out when only factors and actions are needed.
    """
    items, contributions = [], []
    for name, value, x, coef, centre in model.terms:
        c = model.contribution(x, coef, centre)
        v = f"cast({value} as double)"
        items.append(annotated_item_sql(name, v, c) if with_text else
                     f"named_struct('feature', {sql_lit(name)}, 'value', {v}, 'contribution', {c})")
        contributions.append(c)
    return df.selectExpr("*", f"array({', '.join(items)}) as {qi(out)}", f"{model.probability(contributions)} as {qi(prob)}")


def contributions_long(df: DataFrame, id_col: str, contribs: str = "contribs") -> DataFrame:
    """X3 long form: (id, feature, value, contribution)."""
    return df.select(col(id_col), F.explode(contribs).alias("_c")).select(
        col(id_col), "_c.feature", "_c.value", "_c.contribution")


# ---------------------------------------------------------------- per-element expressions

def _description_map() -> Column:
    kv = []
    for k, v in FEATURE_DESCRIPTIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def describe(feature: Column) -> Column:
    """Dictionary description, else underscores replaced by spaces."""
    return F.coalesce(F.try_element_at(_description_map(), feature), F.regexp_replace(feature, "_", " "))


def fmt2(x: Column) -> Column:
    """Python-style ``f"{x:.2f}"`` (correct rounding of the binary value)."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def value_phrase(feature: Column, value: Column) -> Column:
    """Range phrase for the ranged features, else the value with 2 decimals."""
    out = None
    for name, ranges in NUMERICAL_RANGES.items():
        for lo, hi, text in ranges:
            cond = (feature == name) & (value >= lo) & (value < hi)
            out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(fmt2(value))


def is_ranged(feature: Column) -> Column:
    return feature.isin(*NUMERICAL_RANGES.keys())


def strength(contribution: Column) -> Column:
    """Strength word from the absolute contribution."""
    a = F.abs(contribution)
    out = None
    for bound, word in STRENGTH_WORDS:
        out = F.when(a < bound, word) if out is None else out.when(a < bound, word)
    return out.otherwise(STRENGTH_TOP)


def capitalize(s: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def sentence(feature: Column, value: Column, contribution: Column) -> Column:
    """One sentence per factor; zero counts as reducing."""
    verb = F.when(contribution > 0, F.lit("increases")).otherwise(F.lit("reduces"))
    desc = describe(feature)
    ranged = F.concat(F.lit("Their "), value_phrase(feature, value), F.lit(" ("), desc, F.lit(") "),
                      strength(contribution), F.lit(" "), verb, F.lit(" churn risk."))
    plain = F.concat(capitalize(desc), F.lit(" "), strength(contribution), F.lit(" "), verb, F.lit(" churn risk."))
    return F.when(is_ranged(feature) & value.isNotNull(), ranged).otherwise(plain)


def _strength_sql(c: str) -> str:
    whens = " ".join(f"when abs({c}) < {sql_lit(b)} then {sql_lit(w)}" for b, w in STRENGTH_WORDS)
    return f"case {whens} else {sql_lit(STRENGTH_TOP)} end"


def _phrase_sql(name: str, v: str) -> str:
    whens = " ".join(f"when {v} >= {lo} and {v} < {hi} then {sql_lit(t)}" for lo, hi, t in NUMERICAL_RANGES[name])
    return f"case {whens} else regexp_replace(format_number({v}, 2), ',', '') end"


def sentence_static(name: str, value: str, contribution: str) -> str:
    """X10 for a feature whose name is known when the plan is built (SQL text)."""
    verb = f"case when {contribution} > 0 then 'increases' else 'reduces' end"
    desc = FEATURE_DESCRIPTIONS.get(name, name.replace("_", " "))
    strength_sql = _strength_sql(contribution)
    plain = f"concat({sql_lit(desc.capitalize() + ' ')}, {strength_sql}, ' ', {verb}, ' churn risk.')"
    if name not in NUMERICAL_RANGES:
        return plain
    ranged = (f"concat('Their ', {_phrase_sql(name, value)}, {sql_lit(' (' + desc + ') ')}, {strength_sql}, ' ', "
              f"{verb}, ' churn risk.')")
    return f"case when {value} is not null then {ranged} else {plain} end"


def annotated_item_sql(name: str, value: str, contribution: str) -> str:
    """One contribution element with its text fields (static feature name, SQL text)."""
    desc = FEATURE_DESCRIPTIONS.get(name, name.replace("_", " "))
    return (f"named_struct('feature', {sql_lit(name)}, 'value', {value}, 'contribution', {contribution}, "
            f"'description', {sql_lit(desc)}, 'strength', {_strength_sql(contribution)}, "
            f"'sentence', {sentence_static(name, value, contribution)})")


def annotate(contribs: Column) -> Column:
    """Text fields for arrays whose feature names are only known per row
    (``array<struct<feature, value, contribution>>``)."""
    return F.transform(contribs, lambda x: F.struct(
        x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"),
        describe(x["feature"]).alias("description"), strength(x["contribution"]).alias("strength"),
        sentence(x["feature"], x["value"], x["contribution"]).alias("sentence")))


# ---------------------------------------------------------------- factors and actions

def _sorted(contribs: Column, key: str) -> Column:
    """Elements sorted by ``key`` descending ('signed' or 'abs'), ties by feature name."""
    def k(x):
        c = x["contribution"]
        return -c if key == "signed" else -F.abs(c)
    keyed = F.transform(contribs, lambda x: F.struct(k(x).alias("k"), x.alias("item")))
    return F.sort_array(keyed)


def top_items(contribs: Column, n: int, key: str = "signed") -> Column:
    """Top n contribution elements (X5 signed, X11 absolute)."""
    return F.transform(F.slice(_sorted(contribs, key), 1, n), lambda x: x["item"])


def top_factors(contribs: Column, n: int = BATCH_TOP_N) -> Column:
    """Names of the n largest signed contributions."""
    return F.transform(top_items(contribs, n, "signed"), lambda x: x["feature"])


def recommend(factors: Column) -> Column:
    """First rule (in rule order) matching the earliest factor, else the default."""
    def rule_index(f):
        out = None
        for i, (key, _) in enumerate(ACTION_RULES, 1):
            out = F.when(f.contains(key), F.lit(i)) if out is None else out.when(f.contains(key), F.lit(i))
        return out

    hits = F.filter(F.transform(factors, rule_index), lambda i: i.isNotNull())
    actions = F.array(*[F.lit(a) for _, a in ACTION_RULES])
    return F.coalesce(F.try_element_at(actions, F.try_element_at(hits, F.lit(1))), F.lit(DEFAULT_ACTION))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element transform),
    so an expensive sub-expression is not copied into every place it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reason_text(contribs: Column, n: int = REASON_TOP_N) -> Column:
    """X11: the plain-English explanation over the top n absolute contributions.

    ``contribs`` must carry the text fields (:func:`annotated_item_sql` or
    :func:`annotate`).
    """
    def body(top):
        pos = F.filter(top, lambda x: x["contribution"] > 0)
        neg = F.filter(top, lambda x: x["contribution"] < 0)

        def lines(items):
            return F.transform(items, lambda x: F.concat(F.lit(BULLET), x["sentence"]))

        def header(items, one, many):
            return (F.when(F.size(items) == 0, F.array().cast("array<string>"))
                    .when(F.size(items) == 1, F.array(F.lit(one))).otherwise(F.array(F.lit(many))))

        close = (F.when((F.size(pos) > 0) & (F.size(neg) > 0), F.lit(CLOSE_MIXED))
                 .when(F.size(pos) > 0, F.lit(CLOSE_POS)).otherwise(F.lit(CLOSE_NEG)))
        parts = F.concat(header(pos, POS_ONE, POS_MANY), lines(pos), header(neg, NEG_ONE, NEG_MANY),
                         lines(neg), F.array(close))
        return F.array_join(parts, "\n")

    return _let(top_items(contribs, n, "abs"), body)


def summary_text(contribs: Column, prob: Column) -> Column:
    """One line from the largest absolute contribution and the probability."""
    level = (F.when(prob > SUMMARY_HIGH, F.lit("high")).when(prob > SUMMARY_MODERATE, F.lit("moderate"))
             .otherwise(F.lit("low")))
    pct = F.concat(F.regexp_replace(F.format_number(prob * F.lit(100.0), 1), ",", ""), F.lit("%"))

    def body(top):
        head = F.concat(F.lit("This customer has "), level, F.lit(" churn risk ("), pct, F.lit("). Their "),
                        top["description"], F.lit(" "), top["strength"])
        return F.when(top["contribution"] > 0, F.concat(head, F.lit(" increases their likelihood to leave.")))\
            .otherwise(F.concat(head, F.lit(" helps retain them.")))

    return _let(F.element_at(top_items(contribs, 1, "abs"), 1), body)


def risk_report(df: DataFrame, id_col: str, contribs: str = "contribs", prob: str = "churn_probability",
                threshold: float = 0.5) -> DataFrame:
    """Id, probability to 4 decimals, level, top 3 factors, action; highest first."""
    from churnkit.operators.store import risk_level

    staged = df.select(col(id_col).alias("customer_id"), F.col(prob),
                       top_factors(F.col(contribs), BATCH_TOP_N).alias("top_factors"))
    # rounded like Python's round(): on the binary value, not on its decimal text
    rounded = F.regexp_replace(F.format_number(F.col(prob), 4), ",", "").cast("double")
    return staged.select("customer_id", rounded.alias("churn_probability"),
                         risk_level(prob, threshold).alias("risk_level"), "top_factors",
                         recommend(F.col("top_factors")).alias("recommended_action")).orderBy(
        F.col("churn_probability").desc(), F.col("customer_id"))
