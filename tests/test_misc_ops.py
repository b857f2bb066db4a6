"""Small operators without an oracle of their own: C9 assembly, W1 scenarios, S6 stacking."""

from pyspark.sql import functions as F

from churnkit.operators.clean import as_vector
from churnkit.operators.counterfactual import scenario_rows, scenarios
from churnkit.sources.sinks import compare_runs


def test_as_vector(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "a int, b double, c double")
    v = as_vector(df, ["a", "b", "c"]).first()["features"].toArray().tolist()
    assert v[:2] == [1.0, 2.0]


def test_scenarios_table(spark):
    rows = scenario_rows()
    assert len(rows) == 28
    s = scenarios(spark)
    counts = {r["factor"]: r["count"] for r in s.groupBy("factor").count().collect()}
    assert counts == {"Contract Type": 3, "Payment Method": 4, "Internet Service": 3, "Online Security": 2,
                      "Tech Support": 2, "Tenure": 8, "Monthly Charges": 6}
    assert [r["label"] for r in s.filter(F.col("factor") == "Tenure").orderBy("order").collect()][:2] == ["0 mo", "6 mo"]


def test_compare_runs_tags_and_stacks(spark):
    a = spark.createDataFrame([(0.9, 0.5)], "accuracy double, f1 double")
    b = spark.createDataFrame([(0.8, 0.4)], "accuracy double, f1 double")
    rows = compare_runs(("d1", a), ("d2", b)).orderBy("Dataset").collect()
    assert [(r["Dataset"], r["accuracy"]) for r in rows] == [("d1", 0.9), ("d2", 0.8)]


def test_scale_conf_sizes_partitions():
    from churnkit.session import scale_conf

    conf = scale_conf(100 * (1 << 40), executors=1000, cores_per_executor=4)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600  # 100 TiB / 256 MiB
    small = scale_conf(1 << 30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80      # two waves of 40 slots
