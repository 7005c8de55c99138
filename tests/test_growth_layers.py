"""Layers of scripts are unfolded once."""

from posthound.operators import scripts
from tests.test_growth import plan_of


def test_layers_are_unfolded_once(spark):
    rows = spark.createDataFrame([(1, scripts.SCRIPTS[0][1]), (2, "é plain"), (3, None)], "id int, text string")
    found = scripts.script_findings(rows, "id", "text")
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("MapInPandas") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "script.obfuscation", 30), (1, "script.shadow_delete", 85)]
