"""Golden explanation texts (FIXTURES.md 1.4) and the text building blocks."""

from pyspark.sql import functions as F

from churnkit.operators import explain as ex

SCHEMA = "id int, prob double, contribs array<struct<feature:string,value:double,contribution:double>>"

CASE1 = [("Contract_Month-to-month", 1.0, 0.5), ("tenure", 5.0, -0.2), ("MonthlyCharges", 85.5, 0.3),
         ("PaymentMethod_Electronic check", 1.0, 0.1), ("OnlineSecurity_Yes", 0.0, -0.05),
         ("InternetService_Fiber optic", 1.0, 0.4), ("Partner", 0.0, -0.1), ("TechSupport_Yes", 0.0, 0.2)]
CASE2 = [("Contract_Two year", 1.0, -0.4), ("tenure", 48.0, 0.1), ("MonthlyCharges", 65.2, -0.3),
         ("PaymentMethod_Bank transfer (automatic)", 1.0, -0.2), ("OnlineSecurity_Yes", 1.0, 0.05),
         ("InternetService_DSL", 0.0, -0.1), ("Partner", 1.0, 0.3), ("TechSupport_Yes", 1.0, -0.2)]


def frame(spark):
    df = spark.createDataFrame([(1, 0.75, CASE1), (2, 0.15, CASE2)], SCHEMA)
    return df.withColumn("contribs", ex.annotate(F.col("contribs")))


def test_reason_case1(spark):
    r = frame(spark).filter("id = 1").select(ex.reason_text(F.col("contribs")).alias("r")).first()["r"]
    assert r == ("The main factors increasing churn risk are:\n"
                 "• Month-to-month contract very strongly increases churn risk.\n"
                 "• Fiber optic internet significantly increases churn risk.\n"
                 "• Their high monthly bill (Monthly bill amount) significantly increases churn risk.\n"
                 "\nOverall, the customer's profile indicates elevated churn risk.")


def test_reason_case2_ties_kept(spark):
    r = frame(spark).filter("id = 2").select(ex.reason_text(F.col("contribs")).alias("r")).first()["r"]
    assert r == ("The main factor increasing churn risk is:\n"
                 "• Having a partner significantly increases churn risk.\n"
                 "\nThe main factors reducing churn risk are:\n"
                 "• Two-year contract significantly reduces churn risk.\n"
                 "• Their moderate monthly bill (Monthly bill amount) significantly reduces churn risk.\n"
                 "\nOverall, the customer's profile shows competing factors that influence their churn probability.")


def test_summaries(spark):
    rows = {r["id"]: r["s"] for r in frame(spark).select(
        "id", ex.summary_text(F.col("contribs"), F.col("prob")).alias("s")).collect()}
    assert rows[1] == ("This customer has high churn risk (75.0%). Their Month-to-month contract very strongly "
                       "increases their likelihood to leave.")
    assert rows[2] == ("This customer has low churn risk (15.0%). Their Two-year contract significantly helps "
                       "retain them.")


def test_only_zero_contributions_say_lower_risk(spark):
    df = spark.createDataFrame([(1, 0.2, [("tenure", 1.0, 0.0), ("Partner", 1.0, 0.0)])], SCHEMA)
    r = df.select(ex.reason_text(ex.annotate(F.col("contribs"))).alias("r")).first()["r"]
    assert r == "\nOverall, the customer's profile indicates lower churn risk."


def test_top_factors_and_action(spark):
    row = frame(spark).filter("id = 1").select(ex.top_factors(F.col("contribs"), 3).alias("t")).first()
    assert row["t"] == ["Contract_Month-to-month", "InternetService_Fiber optic", "MonthlyCharges"]
    acts = spark.createDataFrame([(["tenure", "Partner"],), (["gender"],), (["Contract_One year"],)], "f array<string>")
    got = [r[0] for r in acts.select(ex.recommend(F.col("f"))).collect()]
    assert got == ["Assign to early-tenure onboarding/retention outreach program.",
                   "Review customer profile for a tailored retention offer.",
                   "Offer discount to upgrade to a longer-term contract for better lock-in."]


def test_describe_fallback_and_phrase(spark):
    df = spark.createDataFrame([("Some_new_feature", 3.14159), ("tenure", 100.0), ("tenure", 5.0),
                                ("HighRiskCombo", 0.125)], "f string, v double")
    got = df.select(ex.describe(F.col("f")), ex.value_phrase(F.col("f"), F.col("v"))).collect()
    assert got[0][0] == "Some new feature" and got[0][1] == "3.14"
    assert got[1][1] == "100.00" and got[2][1] == "new customer"
    assert got[3][1] == f"{0.125:.2f}"
