"""Registered queries for contributions, texts, actions and counterfactuals (FX1 + fixed linear score):
X3, X5-X13, W2-W3."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnkit.operators import explain as ex
from churnkit.operators.accounts import encode_accounts
from churnkit.operators.counterfactual import delta_best_change, delta_counterfactuals, scenario_rows
from churnkit.operators.clean import Vocabulary
from churnkit.plans.account_queries import ACC_CTES, SQL_VOCAB, q
from churnkit.plans.fixture_sql import with_fx
from churnkit.plans.registry import register
from churnkit.sources import fixtures

REPORT_THRESHOLD = 0.5
# Scoring uses the vocabulary stored with the model (fixed at fit time), not one
# refitted on the rows being scored.
BUNDLE_VOCAB = Vocabulary({k: list(v) for k, v in SQL_VOCAB.items()})

# (feature, value sql, model input sql, coef, centre) -- mirrors explain.fixture_linear_score
TERMS = [
    ("tenure", "cast(tenure as double)", "cast(tenure as double)", -0.02, 60.0),
    ("MonthlyCharges", "\"MonthlyCharges\"", "\"MonthlyCharges\" / cast(100000.0 as double)", 0.15, 2.0),
    ("NumServices", "cast(\"NumServices\" as double)", "cast(\"NumServices\" as double)", -0.1, 4.0),
] + [(n, f"cast({q(n)} as double)", f"cast({q(n)} as double)", c, m) for n, c, m in [
    ("HighRiskCombo", 0.8, 0.2), ("Contract_One year", -0.3, 0.4), ("Contract_Two year", -0.7, 0.2),
    ("InternetService_Fiber optic", 0.5, 0.4), ("PaymentMethod_Electronic check", 0.35, 0.4)]]


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def contrib_sql(x, coef, centre):
    return f"{d(coef)} * (coalesce({x}, {d(centre)}) - {d(centre)})"


def prob_sql(cols=None):
    z = d(-0.4) + "".join(f" + {contrib_sql(x, c, m)}" for _, _, x, c, m in TERMS)
    return f"round(1.0 / (1.0 + exp(-({z}))), 6)"


LIN_SQL = ("select \"customerID\", " + ", ".join(
    f"{v} as v{i}, {contrib_sql(x, c, m)} as c{i}" for i, (_, v, x, c, m) in enumerate(TERMS))
    + f", {prob_sql()} as churn_probability from enc")
LONG_SQL = " union all ".join(
    f"select \"customerID\", '{n}' as feature, v{i} as value, c{i} as contribution from lin"
    for i, (n, _, _, _, _) in enumerate(TERMS))


def describe_sql(f="feature"):
    return ("case " + " ".join(f"when {f} = '{k}' then '{v}'" for k, v in ex.FEATURE_DESCRIPTIONS.items())
            + f" else replace({f}, '_', ' ') end")


def phrase_sql(f="feature", v="value"):
    parts = []
    for name, ranges in ex.NUMERICAL_RANGES.items():
        for lo, hi, text in ranges:
            parts.append(f"when {f} = '{name}' and {v} >= {lo} and {v} < {hi} then '{text}'")
    return "case " + " ".join(parts) + f" else printf('%.2f', {v}) end"


def strength_sql(c="contribution"):
    return ("case " + " ".join(f"when abs({c}) < {b} then '{w}'" for b, w in ex.STRENGTH_WORDS)
            + f" else '{ex.STRENGTH_TOP}' end")


def sentence_sql(f="feature", v="value", c="contribution"):
    verb = f"case when {c} > 0 then 'increases' else 'reduces' end"
    ranged = ", ".join(f"'{n}'" for n in ex.NUMERICAL_RANGES)
    desc = describe_sql(f)
    return (f"case when {f} in ({ranged}) and {v} is not null then 'Their ' || {phrase_sql(f, v)} || ' (' || "
            f"{desc} || ') ' || {strength_sql(c)} || ' ' || {verb} || ' churn risk.' else "
            f"upper(substr({desc}, 1, 1)) || lower(substr({desc}, 2)) || ' ' || {strength_sql(c)} || ' ' || "
            f"{verb} || ' churn risk.' end")


def action_sql():
    rule = "case " + " ".join(f"when contains(feature, '{k}') then {i}" for i, (k, _) in
                              enumerate(ex.ACTION_RULES, 1)) + " end"
    text = ("case rule_no " + " ".join(f"when {i} then '{a}'" for i, (_, a) in enumerate(ex.ACTION_RULES, 1))
            + f" else '{ex.DEFAULT_ACTION}' end")
    return rule, text


RULE_SQL, ACTION_TEXT_SQL = action_sql()
EX_CTES = ACC_CTES + [
    ("lin", LIN_SQL), ("long", LONG_SQL),
    ("signed", "select *, row_number() over (partition by \"customerID\" order by contribution desc, feature) "
               "as rk from long"),
    ("absr", "select *, row_number() over (partition by \"customerID\" order by abs(contribution) desc, feature) "
             "as rk from long"),
    ("acts", f"select \"customerID\", arg_min(rule_no, rk) as rule_no from (select *, {RULE_SQL} as rule_no "
             "from signed where rk <= 3) where rule_no is not null group by \"customerID\""),
    ("factors3", "select \"customerID\", string_agg(feature, ', ' order by rk) as top_factors from signed "
                 "where rk <= 3 group by \"customerID\""),
]
NL = "chr(10)"
REASON_SQL = (
    "select \"customerID\", concat_ws(" + NL + ", case when npos = 1 then '" + ex.POS_ONE + "' when npos > 1 then '"
    + ex.POS_MANY + "' end, pos_lines, case when nneg = 1 then " + NL + " || '" + ex.NEG_ONE.strip("\n")
    + "' when nneg > 1 then " + NL + " || '" + ex.NEG_MANY.strip("\n") + "' end, neg_lines, " + NL + " || "
    "case when npos > 0 and nneg > 0 then '" + ex.CLOSE_MIXED.strip("\n").replace("'", "''") + "' when npos > 0 "
    "then '" + ex.CLOSE_POS.strip("\n").replace("'", "''") + "' else '" + ex.CLOSE_NEG.strip("\n").replace("'", "''")
    + "' end) as reason from (select \"customerID\", count(*) filter (where contribution > 0) as npos, "
    "count(*) filter (where contribution < 0) as nneg, string_agg('• ' || sentence, " + NL + " order by rk) filter "
    "(where contribution > 0) as pos_lines, string_agg('• ' || sentence, " + NL + " order by rk) filter "
    "(where contribution < 0) as neg_lines from (select *, " + sentence_sql() + " as sentence from absr "
    "where rk <= 3) group by \"customerID\")")


def scored_accounts(spark, sf_dir, with_text=False):
    encoded, _ = encode_accounts(fixtures.accounts(spark, sf_dir), vocab=BUNDLE_VOCAB)
    return ex.linear_contributions(encoded, ex.fixture_linear_score(), with_text=with_text)


def long_contribs(spark, sf_dir):
    return ex.contributions_long(scored_accounts(spark, sf_dir), "customerID")


@register("x3_linear_contributions", with_fx("select * from long", "acc", extra=EX_CTES[:5]))
def x3_linear_contributions(spark, sf_dir):
    return long_contribs(spark, sf_dir)


@register("x3_probability", with_fx("select \"customerID\", churn_probability from lin", "acc", extra=EX_CTES[:4]))
def x3_probability(spark, sf_dir):
    return scored_accounts(spark, sf_dir).select("customerID", "churn_probability")


@register("x5_top_factors", with_fx(
    "select \"customerID\", cast(rk as integer) as rank, feature, contribution from signed where rk <= 5",
    "acc", extra=EX_CTES[:6]))
def x5_top_factors(spark, sf_dir):
    s = scored_accounts(spark, sf_dir)
    top = s.select("customerID", F.posexplode(ex.top_items(F.col("contribs"), ex.SINGLE_TOP_N, "signed")))
    return top.select("customerID", (F.col("pos") + 1).alias("rank"), F.col("col.feature").alias("feature"),
                      F.col("col.contribution").alias("contribution"))


@register("x6_recommend", with_fx(
    f"select l.\"customerID\", {ACTION_TEXT_SQL} as recommended_action from lin l left join acts a "
    "on l.\"customerID\" = a.\"customerID\"", "acc", extra=EX_CTES[:8]))
def x6_recommend(spark, sf_dir):
    s = scored_accounts(spark, sf_dir)
    return s.select("customerID", ex.recommend(ex.top_factors(F.col("contribs"), ex.BATCH_TOP_N))
                    .alias("recommended_action"))


@register("x7_describe", with_fx(
    f"select \"customerID\", feature, {describe_sql()} as description from long", "acc", extra=EX_CTES[:5]))
def x7_describe(spark, sf_dir):
    return long_contribs(spark, sf_dir).select("customerID", "feature",
                                               ex.describe(F.col("feature")).alias("description"))


@register("x8_value_phrase", with_fx(
    f"select \"customerID\", feature, {phrase_sql()} as phrase from long", "acc", extra=EX_CTES[:5]))
def x8_value_phrase(spark, sf_dir):
    return long_contribs(spark, sf_dir).select(
        "customerID", "feature", ex.value_phrase(F.col("feature"), F.col("value")).alias("phrase"))


@register("x9_strength", with_fx(
    f"select \"customerID\", feature, {strength_sql()} as strength from long", "acc", extra=EX_CTES[:5]))
def x9_strength(spark, sf_dir):
    return long_contribs(spark, sf_dir).select("customerID", "feature",
                                               ex.strength(F.col("contribution")).alias("strength"))


@register("x10_sentence", with_fx(
    f"select \"customerID\", feature, {sentence_sql()} as sentence from long", "acc", extra=EX_CTES[:5]))
def x10_sentence(spark, sf_dir):
    return long_contribs(spark, sf_dir).select(
        "customerID", "feature", ex.sentence(F.col("feature"), F.col("value"), F.col("contribution"))
        .alias("sentence"))


@register("x11_reason_text", with_fx(REASON_SQL, "acc", extra=EX_CTES[:7]))
def x11_reason_text(spark, sf_dir):
    s = scored_accounts(spark, sf_dir, with_text=True)
    return s.select("customerID", ex.reason_text(F.col("contribs")).alias("reason"))


@register("x12_summary_text", with_fx(
    "select a.\"customerID\", 'This customer has ' || case when l.churn_probability > 0.6 then 'high' "
    "when l.churn_probability > 0.3 then 'moderate' else 'low' end || ' churn risk (' || "
    "printf('%.1f', l.churn_probability * 100.0) || '%). Their ' || " + describe_sql("a.feature") + " || ' ' || "
    + strength_sql("a.contribution") + " || case when a.contribution > 0 then ' increases their likelihood to "
    "leave.' else ' helps retain them.' end as summary from absr a join lin l on a.\"customerID\" = l.\"customerID\" "
    "where a.rk = 1", "acc", extra=EX_CTES[:7]))
def x12_summary_text(spark, sf_dir):
    s = scored_accounts(spark, sf_dir, with_text=True)
    return s.select("customerID", ex.summary_text(F.col("contribs"), F.col("churn_probability")).alias("summary"))


@register("x13_risk_report", with_fx(
    "select l.\"customerID\" as customer_id, cast(printf('%.4f', l.churn_probability) as double) "
    "as churn_probability, case when "
    f"l.churn_probability > 0.6 then 'High' when l.churn_probability > {REPORT_THRESHOLD} then 'Medium' else 'Low' "
    f"end as risk_level, f.top_factors, {ACTION_TEXT_SQL} as recommended_action from lin l join factors3 f on "
    "l.\"customerID\" = f.\"customerID\" left join acts a on l.\"customerID\" = a.\"customerID\" "
    "order by churn_probability desc, customer_id", "acc", extra=EX_CTES))
def x13_risk_report(spark, sf_dir):
    rep = ex.risk_report(scored_accounts(spark, sf_dir), "customerID", threshold=REPORT_THRESHOLD)
    return rep.withColumn("top_factors", F.concat_ws(", ", "top_factors"))


# ------------------------------------------------------------------ counterfactuals

SCEN_VALUES = ", ".join(
    "('{}', '{}', {}, '{}', {}, {})".format(f, c, o, lab, "null" if t is None else f"'{t}'",
                                            "null" if n is None else d(n))
    for f, c, o, lab, t, n in scenario_rows())
ACC_COLS = [c for _, c in fixtures.ACCOUNT_COLUMNS]
CF_RAW = ("select " + ", ".join(
    (f"case when s.col = '{c}' then cast(s.nval as integer) else a.tenure end as tenure" if c == "tenure" else
     f"case when s.col = '{c}' then s.nval else a.{q(c)} end as {q(c)}" if c == "MonthlyCharges" else
     f"case when s.col = '{c}' then s.tval else a.{q(c)} end as {q(c)}"
     if c in ("Contract", "PaymentMethod", "InternetService", "OnlineSecurity", "TechSupport") else f"a.{q(c)}")
    for c in ACC_COLS) + ", s.factor, s.ord, s.label from acc a cross join (values " + SCEN_VALUES
    + ") s(factor, col, ord, label, tval, nval)")


def _cf_ctes():
    """The account CTE chain re-run over the scenario rows (same SQL, other source)."""
    clean = ACC_CTES[0][1].replace(" from acc", ", factor, ord, label from cfraw")
    feat = ACC_CTES[1][1].replace(" from clean", " from cfclean")
    enc = ACC_CTES[2][1].replace(" from feat", " from cffeat").replace("select ", "select factor, ord, label, ", 1)
    lin = LIN_SQL.replace(" from enc", " from cfenc").replace("select ", "select factor, ord, label, ", 1)
    return [("cfraw", CF_RAW), ("cfclean", clean), ("cffeat", feat), ("cfenc", enc), ("cflin", lin)]


CF_CTES = ACC_CTES + [("lin", LIN_SQL)] + _cf_ctes()
CF_SELECT = ("select c.\"customerID\", c.factor, c.ord as \"order\", c.label, c.churn_probability, "
             "b.churn_probability as current_probability from cflin c join lin b on c.\"customerID\" = b.\"customerID\"")
W2_SELECT = "select \"customerID\", factor, ord as \"order\", label, churn_probability from cflin"


@register("w2_counterfactuals", with_fx(W2_SELECT, "acc", extra=CF_CTES))
def w2_counterfactuals(spark, sf_dir):
    return delta_counterfactuals(fixtures.accounts(spark, sf_dir), ex.fixture_linear_score(), BUNDLE_VOCAB)


@register("w3_best_change", with_fx(
    "select \"customerID\", factor, label as best_value, churn_probability as best_probability, current_probability, "
    "current_probability - churn_probability as reduction, current_probability - churn_probability > 0.01 "
    "as worth_it from (select *, row_number() over (partition by \"customerID\", factor order by churn_probability, "
    "\"order\") as rn from (" + CF_SELECT + ")) where rn = 1", "acc", extra=CF_CTES))
def w3_best_change(spark, sf_dir):
    return delta_best_change(fixtures.accounts(spark, sf_dir), ex.fixture_linear_score(), BUNDLE_VOCAB)
