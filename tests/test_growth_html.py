"""Pages are read once, in bounded batches, and their facts are not joined back."""

import pandas as pd
from pyspark.sql import functions as F

from posthound.operators import scripts
from posthound.sources import mail
from tests.test_growth import plan_of


def test_html_findings_read_pages_once_without_a_join(spark):
    plan = plan_of(scripts.html_findings(spark.createDataFrame([(1, "<p>")], "id int, text string"), "id", "text"))
    assert "Join" not in plan and plan.count("MapInPandas") == 1


def test_facts_leave_a_task_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(mail, "BATCH_CHARS", 5_000)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 40, 1, 1).select("id", F.concat(F.lit("<a href='x'>"), F.col("id").cast("string"), F.lit("</a>"), F.repeat(F.lit("y"), 1000)).alias("html"))
    facts = mail.html_facts(pages, "id", "html", also=("html",))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    sizes = facts.mapInPandas(lambda it: (pd.DataFrame({"n": [len(b)]}) for b in it), "n int").collect()
    assert sum(r.n for r in sizes) == 40
    rows = facts.orderBy("id").collect()
    assert [r.links[0].shown for r in rows] == [str(i) for i in range(40)] and all(r.html.startswith(f"<a href='x'>{r.id}<") for r in rows)
