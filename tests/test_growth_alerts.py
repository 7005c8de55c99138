"""Alerts in several styles read their lines once."""

import re

from posthound.plans import render
from tests.test_growth import plan_of


def test_all_styles_read_the_lines_once(spark):
    plan = plan_of(render.alert_texts(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Scan parquet .*o_orderkey", plan)) <= 3, plan.count("Scan parquet")
    assert plan.count("Generate inline(each") == 1
