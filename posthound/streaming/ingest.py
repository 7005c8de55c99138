"""Streams: effectively-once ingest, retries with a dead-letter table, alert suppression with state, and a running timeline."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from posthound.operators.dml import new_results
from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.sources import adapters as src
from posthound.streaming.ordered import in_order

R = Registry()
MAX_ATTEMPTS = 3


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that appends rows whose natural key is not stored yet.

    A batch that is delivered again overwrites its own folder, so that neither a replay nor a repeated key adds rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) else spark.createDataFrame([], batch.schema)
        own = f"/epoch={epoch}/"
        stored = stored.filter(~F.input_file_name().contains(own)) if _exists(spark, path) else stored
        new_results(batch, stored).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def retry_step(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, retry, dead) of jobs(id, raw, attempts): work returns its input with `error`, null where it went well.

    Malformed jobs, and those that fail for the third time, go to the dead letters with their error.
    """
    bad = F.col("id").isNull() | F.col("raw").isNull()
    ready = jobs.filter(~bad & (F.col("attempts") < MAX_ATTEMPTS))
    tried = work(ready).withColumn("attempts", F.col("attempts") + 1)
    done = tried.filter("error is null").drop("error")
    failed = tried.filter("error is not null")
    retry = failed.filter(F.col("attempts") < MAX_ATTEMPTS).drop("error")
    dead = failed.filter(F.col("attempts") >= MAX_ATTEMPTS)
    poison = jobs.filter(~bad & (F.col("attempts") >= MAX_ATTEMPTS)).withColumn("error", F.lit("too many attempts"))
    broken = jobs.filter(bad).withColumn("error", F.lit("malformed"))
    return done, retry, dead.unionByName(poison).unionByName(broken).withColumn("failed_at", now)


def error_results(dead: DataFrame) -> DataFrame:
    """Exhausted jobs as results: an error verdict, never clean."""
    return dead.select("id", F.lit("error").alias("level"), F.lit(0).alias("score"), F.array("error").alias("errors"))


_ALERT_SCHEMA = "key string, id long, at timestamp"


def suppress(alerts: DataFrame, window_s: int) -> DataFrame:
    """The alerts(key, id, at) that are sent: after one of a key, others rest for window_s seconds from that accepted one.

    Which alerts are accepted depends on those before, but never across a gap of window_s: the first alert after one is always
    sent. A key's alerts are cut there, and only the alerts between two gaps are folded in order by one task.
    """
    if window_s <= 0:
        return alerts.select("key", "id", "at")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        kept, until = [], None
        for row in pdf.itertuples(index=False):
            if until is None or row.at >= until:
                kept.append(row)
                until = row.at + pd.Timedelta(seconds=window_s)
        return pd.DataFrame(kept, columns=pdf.columns)

    own = W.partitionBy("key").orderBy("at", "id")
    new = F.coalesce(F.col("at") >= F.lag("at").over(own) + F.expr(f"interval {window_s} seconds"), F.lit(True))
    pieces = alerts.select("key", "id", "at").withColumn("new", new.cast("int")).withColumn("piece", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    # An alert between two gaps stands alone in most histories: such pieces need no fold.
    pieces = pieces.withColumn("last", F.lead("piece").over(own))
    alone = (F.col("new") == 1) & (F.col("last").isNull() | (F.col("last") != F.col("piece")))
    folded = pieces.filter(~alone).groupBy("key", "piece").applyInPandas(lambda pdf: fold(pdf[["key", "id", "at"]]), _ALERT_SCHEMA)
    return pieces.filter(alone).select("key", "id", "at").unionByName(folded)


def suppress_stream(alerts: DataFrame, window_s: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, whose batches may come in any order within `late`: a key's state is the time until which it rests,
    and goes once the watermark has passed that. Needs the RocksDB state store."""

    def fold(key: str, rows: list[tuple], kept: tuple | None, known: int):
        until, sent = (kept[0] if kept else None), []
        for at, id_, when in rows:
            if until is None or at >= until:
                sent.append((key, id_, when))
                until = at + window_s * 1_000_000
        resting = until is not None and until > known
        return sent, (until,) if resting else None, until if resting else None

    return in_order(alerts.withColumn("when", F.col("at")), "key", "at", ["id", "when"], fold, "until long", _ALERT_SCHEMA, late)


def timeline_stream(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and level of a stream of results; rows later than the watermark are left out."""
    return results.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 hour"), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "level", "n")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir).filter(F.col("level").isin("suspicious", "malicious"))
    return rows.select(F.concat_ws(":", F.lit("alert"), "connector", "level").alias("key"), "id", F.col("received_at").cast("timestamp").alias("at"))


@R.add(
    _q(
        [src.ANALYSES_SQL],
        """, a AS (SELECT 'alert:' || connector || ':' || level AS key, id, received_at AS t, row_number() OVER (PARTITION BY connector, level ORDER BY received_at, id) AS n FROM analyses WHERE level IN ('suspicious', 'malicious')),
r AS (SELECT key, id, t, n, t + INTERVAL 3600 SECOND AS rest, true AS sent FROM a WHERE n = 1
  UNION ALL SELECT a.key, a.id, a.t, a.n, CASE WHEN a.t >= r.rest THEN a.t + INTERVAL 3600 SECOND ELSE r.rest END, a.t >= r.rest FROM r JOIN a ON a.key = r.key AND a.n = r.n + 1)
SELECT key, id FROM r WHERE sent""",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("\n, a AS", ", a AS")
)
def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress(_alerts(spark, sf_dir), 3600).select("key", "id")


@R.add(_q([src.ANALYSES_SQL], "SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M:%S') AS hour, level, count(*) AS n FROM analyses GROUP BY 1, 2"))
def timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the running timeline."""
    return timeline_stream(src.analyses(spark, sf_dir)).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "level", "n")


@R.add("SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'dead' WHEN event_id % 5 = 0 THEN 'retry' ELSE 'done' END AS outcome FROM events")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth job is at its last attempt, and every fifth fails."""
    jobs = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw"), F.when(F.col("event_id") % 10 == 0, 2).otherwise(0).alias("attempts"))
    done, retry, dead = retry_step(jobs, lambda d: d.withColumn("error", F.when(F.col("id") % 5 == 0, "failed")), F.lit(None).cast("timestamp"))
    tag = lambda d, name: d.select("id", F.lit(name).alias("outcome"))
    return tag(done, "done").unionByName(tag(retry, "retry")).unionByName(tag(dead, "dead"))


RESULT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("connector", "mailbox", "remote_id", "level")] + [T.StructField("id", T.LongType()), T.StructField("received_at", T.TimestampType())])
