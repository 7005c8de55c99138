"""Counters and histograms of stored results as samples, and as the text that a metrics collector reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.sources import adapters as src

R = Registry()
#: Upper bounds of durations in seconds.
BOUNDS = ("0.1", "0.25", "0.5", "1", "2", "5", "10", "30", "60", "120", "300")
SAMPLE = "metric", "kind", "labels", "value"


def _escaped(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def label_text(names: tuple[str, ...]) -> Column:
    """`{name="value",...}` of string columns, quotes, backslashes and line ends escaped; null reads as an empty value."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{n}="'), _escaped(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit('"')) for n in names]), F.lit("}"))


def counter(rows: DataFrame, metric: str, names: tuple[str, ...]) -> DataFrame:
    """metric, kind, labels, value: one sample per combination of labels, the value as text."""
    return rows.groupBy(*names).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(metric).alias("metric"), F.lit("counter").alias("kind"), label_text(names).alias("labels"), "value")


def histogram(rows: DataFrame, metric: str, millis: str, names: tuple[str, ...] = (), bounds: tuple[str, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets by upper bound in seconds, +Inf last, and sum and count, in one aggregation of whole milliseconds; nulls are not observed."""
    seen = rows.filter(F.col(millis).isNotNull())
    upto = [F.count_if(F.col(millis) <= int(round(float(b) * 1000))).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = seen.groupBy(*names).agg(*upto, F.count(F.lit(1)).alias("n"), F.sum(millis).alias("total"))
    seconds = F.concat(F.expr("total div 1000").cast("string"), F.lit("."), F.lpad((F.col("total") % 1000).cast("string"), 3, "0"))
    sample = lambda end, le, value: F.struct(F.lit(metric + end).alias("metric"), F.lit(le).cast("string").alias("le"), value.cast("string").alias("value"))
    every = F.array(*[sample("_bucket", b, F.col(f"b{i}")) for i, b in enumerate(bounds)], sample("_bucket", "+Inf", F.col("n")), sample("_sum", None, seconds), sample("_count", None, F.col("n")))
    out = one.select(*names, F.inline(every))
    labels = F.when(F.col("le").isNotNull(), label_text((*names, "le"))).otherwise(label_text(names) if names else F.lit(""))
    return out.select("metric", F.lit("histogram").alias("kind"), labels.alias("labels"), "value")


def exposition(samples: DataFrame) -> Column:
    """A sample's line; lines of one metric stay together if they are sorted."""
    return F.concat("metric", "labels", F.lit(" "), "value")


_LE = ", ".join(f"'{b}'" for b in BOUNDS)


@R.add(
    _q(
        [src.ANALYSES_SQL, src.FINDINGS_SQL],
        f"""SELECT 'counter' AS kind, 'posthound_messages_total{{connector="' || connector || '",level="' || level || '"}} ' || CAST(count(*) AS VARCHAR) AS line FROM analyses GROUP BY connector, level
UNION ALL SELECT 'counter', 'posthound_findings_total{{category="' || category || '",severity="' || CAST(severity AS VARCHAR) || '"}} ' || CAST(count(*) AS VARCHAR) FROM findings GROUP BY category, severity
UNION ALL SELECT 'histogram', 'posthound_duration_seconds_bucket{{connector="' || connector || '",le="' || le || '"}} ' || CAST(count(*) FILTER (duration_ms <= CAST(le AS DOUBLE) * 1000) AS VARCHAR) FROM analyses, (SELECT unnest([{_LE}]) AS le) GROUP BY connector, le
UNION ALL SELECT 'histogram', 'posthound_duration_seconds_bucket{{connector="' || connector || '",le="+Inf"}} ' || CAST(count(*) AS VARCHAR) FROM analyses GROUP BY connector
UNION ALL SELECT 'histogram', 'posthound_duration_seconds_sum{{connector="' || connector || '"}} ' || CAST(CAST(sum(duration_ms) AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(sum(duration_ms) AS BIGINT) % 1000 AS VARCHAR), 3, '0') FROM analyses GROUP BY connector
UNION ALL SELECT 'histogram', 'posthound_duration_seconds_count{{connector="' || connector || '"}} ' || CAST(count(*) AS VARCHAR) FROM analyses GROUP BY connector""",
    )
)
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by connector and level, findings by category and severity, durations by connector."""
    results = src.analyses(spark, sf_dir)
    every = counter(results, "posthound_messages_total", ("connector", "level")).unionByName(counter(src.findings(spark, sf_dir), "posthound_findings_total", ("category", "severity")))
    every = every.unionByName(histogram(results, "posthound_duration_seconds", "duration_ms", ("connector",)))
    return every.select("kind", exposition(every).alias("line"))
