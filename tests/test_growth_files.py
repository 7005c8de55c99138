"""Findings on files: no broadcast of what grows with the files, small tables spread before rows are made of them."""

from posthound.operators import files
from posthound.sources import adapters as src
from tests.test_growth import plan_of

SMALL = "/root/testdata/sf0.001"


def test_archives_are_joined_without_a_broadcast(spark):
    df = files.filetype_rules(spark, SMALL)
    assert "Broadcast" not in plan_of(df)


def test_a_small_table_is_spread_before_texts_are_made_of_it(spark):
    assert src.over(spark, SMALL, ((1, "a"), (2, "b"))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_indicators_are_not_worked_out_twice(spark):
    plan = plan_of(files.indicator_groups(spark, SMALL))
    assert plan.count("fodhelper") == 1
