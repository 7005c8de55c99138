"""What must not grow faster than the input: candidates of rule tables, broadcasts, batches, tasks."""

from pyspark.sql import functions as F

from posthound.operators import anchors, claims


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_proposed_only_where_their_own_rare_literal_is(spark):
    rules = [(f"r{i}", None, 1, 2, None, None, [f"commonword{i:05d}", "shared.thing", "<often>"]) for i in range(2000)]
    table = spark.createDataFrame(rules, claims.RULE_COLUMNS)
    rows = spark.createDataFrame([(i, bytearray(f"<often> CommonWord{i:05d} text".encode())) for i in range(50)] + [(50, bytearray(b"<often> shared-thing"))], "id int, data binary")
    hits = anchors.pattern_hits(rows.select("id", F.lit("").alias("kind"), "data"), table.select(F.explode("patterns").alias("pattern")).distinct(), "id")
    assert hits.groupBy("pattern").count().count() == 52 and hits.count() == 102  # a shared pattern once a row, not once a rule
    got = {(r.id, r.rule) for r in anchors.scan_table(rows, table).collect()}
    assert got == {(i, f"yara.r{i}") for i in range(50)} | {(50, f"yara.r{i}") for i in range(2000)}
