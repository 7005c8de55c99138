"""Pointer jumping without broadcasts."""

from posthound.operators import ancestors
from tests.test_growth import plan_of


def test_roots_broadcast_nothing(spark, monkeypatch):
    plans, write = [], ancestors.written
    monkeypatch.setattr(ancestors, "written", lambda df, name: (plans.append(plan_of(df)), write(df, name))[1])
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)] + [(20, 21), (21, 20), (22, 20)], "id long, parent long")
    got = ancestors.roots(nodes)
    plans.append(plan_of(got))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    assert {(r.id, r.root, r.depth) for r in got.collect()} == {(i, 0, i) for i in range(9)} | {(i, 20, None) for i in (20, 21, 22)}
