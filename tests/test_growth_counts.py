"""Distinct counts whose tasks do not grow with the input."""

from pyspark.sql import functions as F

from posthound.operators import evidence
from posthound.plans import reports
from tests.test_growth import plan_of

SMALL = "/root/testdata/sf0.001"


def test_top_rules_deal_both_sides_by_mail(spark):
    plan = plan_of(reports.top_rules(spark, SMALL))
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan


def test_paths_are_counted_without_an_expansion(spark):
    assert "Expand" not in plan_of(evidence.evidence_paths(spark, SMALL))
    rows = [(1, "$.a", "string", "x"), (1, "$.a", "string", "x"), (1, "$.a", "string", "y"), (2, "$.a", "string", "x"), (2, "$.a", "null", None), (1, "$.b", "list", None), (None, "$.b", "list", None)]
    found = spark.createDataFrame(rows, "id int, path string, kind string, value string")
    plain = found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_events"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"))
    assert sorted(map(tuple, evidence.path_counts(found, "id").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
