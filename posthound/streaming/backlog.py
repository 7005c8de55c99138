"""Backlog of streaming queries as a relation, and admission by it.

A listener keeps one row per finished batch and writes them to a table every so often. What still waited at each batch follows
from a join with two listings that Spark has anyway: the files of the source's folder, and the log in which a query's checkpoint
notes the files of each batch.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, at timestamp, rows_in long, rows_per_s double, done_per_s double, state_rows long, batch_ms long"


class Backlog(StreamingQueryListener):
    """Progress of all queries of a session as rows of a Parquet table under `path`."""

    def __init__(self, spark: SparkSession, path: str, every: int = 10) -> None:
        self.spark, self.path, self.every = spark, path, every
        self.held: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        rows_in = sum(int(source.get("numInputRows") or 0) for source in p["sources"])
        state = sum(int(o["numRowsTotal"]) for o in p["stateOperators"])
        row = (p.get("name") or p["id"], p["batchId"], p["timestamp"], rows_in, float(p.get("inputRowsPerSecond") or 0), float(p.get("processedRowsPerSecond") or 0), state, int(p.get("batchDuration") or 0))
        with self.lock:
            self.held.append(row)
            full = len(self.held) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            plain = SCHEMA.replace("at timestamp", "at string")
            self.spark.createDataFrame(rows, plain).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def depth(progress: DataFrame, folder: str, checkpoint: str, source: int = 0) -> DataFrame:
    """query, batch, at, waiting, drain_s of one query's progress: files that had come in when the batch began and that no batch up
    to it has taken; seconds until none waits at the rate of the last three batches that took any (null before the first)."""
    spark = progress.sparkSession
    came = spark.read.format("binaryFile").load(folder).select(F.col("modificationTime").alias("at"), F.lit(1).alias("came"), F.lit(0).alias("taken"))
    log = spark.read.text(f"{checkpoint}/sources/{source}").filter(F.col("value").startswith("{"))
    entry = F.from_json("value", "path string, batchId long")
    taken = log.select(entry.alias("e")).select("e.path", F.col("e.batchId").alias("batch")).distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    batches = progress.join(taken, "batch", "left").select("query", "batch", "at", F.coalesce("n", F.lit(0)).alias("n"), "batch_ms")
    # Arrivals and batches on one line of time: both are running sums, by way of counts per batch.
    bounds = batches.select("batch", "at", F.lag("at").over(W.orderBy("batch")).alias("since"))
    arrived = came.join(F.broadcast(bounds), (came["at"] <= bounds["at"]) & (bounds["since"].isNull() | (came["at"] > bounds["since"]))).groupBy("batch").agg(F.sum("came").alias("came"))
    upto, last = W.partitionBy("query").orderBy("batch"), W.partitionBy("query").orderBy("batch").rowsBetween(-2, 0)
    rows = batches.join(arrived, "batch", "left").withColumn("waiting", F.sum(F.coalesce("came", F.lit(0)) - F.col("n")).over(upto))
    rate = F.sum("n").over(last) / F.sum("batch_ms").over(last) * 1000
    return rows.select("query", "batch", "at", "waiting", F.when(rate > 0, F.col("waiting") / rate).alias("drain_s"))


def admitted(jobs: DataFrame, waiting: int, most: int, priority: Column) -> DataFrame:
    """jobs with `admitted`: all while fewer than `most` wait, beyond that only those of a priority above 0; nothing is dropped."""
    return jobs.withColumn("admitted", (F.lit(waiting) < most) | (priority > 0))
