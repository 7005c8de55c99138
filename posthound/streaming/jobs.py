"""The job queue as a state machine: leases, retries after a delay, reclaim of idle jobs, and dead letters.

A queue is a log of events: `put` offers a job, `take` leases it to a worker, `ack` ends it, `fail` gives it back. The machine
answers with `ready` (the job may be taken), `done` and `dead`. A failed job is ready again after a delay; a leased job without
an answer is reclaimed once it idles too long; whatever was tried as often as allowed is dead, with its error. A job without
content is dead at once. A job that ended stays known for a while, so that a log which is delivered again starts nothing anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.plans.registry import Registry
from posthound.sources import adapters as src
from posthound.streaming.ordered import in_order, ordered_batch

R = Registry()
COLUMNS = ["event", "raw", "error"]
KEPT = "status string, attempts int, due long, raw string"
OUT = "id long, status string, attempts int, error string, raw string, at timestamp"


@dataclass(frozen=True)
class Policy:
    """attempts a job gets, seconds before it is tried again, seconds a lease may idle, seconds an ended job stays known."""

    attempts: int = 3
    delay_s: int = 60
    idle_s: int = 300
    remember_s: int = 86_400

    def fold(self, key: int, rows: list[tuple], kept: tuple | None, known: int):
        from datetime import datetime, timedelta

        out: list[tuple] = []
        status, attempts, due, raw = kept or (None, 0, None, None)

        def say(status: str, at: int, error: str | None = None) -> None:
            out.append((key, status, attempts, error, raw, datetime(1970, 1, 1) + timedelta(microseconds=at)))

        def end(how: str, at: int, error: str | None = None) -> None:
            nonlocal status, due, raw
            say(how, at, error)
            status, due, raw = "ended", at + self.remember_s * 1_000_000, None

        def run_timers(now: int) -> None:
            nonlocal status, attempts, due, raw
            while due is not None and due <= now:
                at = due
                if status == "ended":
                    status, attempts, due, raw = None, 0, None, None
                elif attempts >= self.attempts:  # a lease idled on the last attempt
                    end("dead", at, "abandoned")
                else:
                    attempts, status, due = attempts + 1, "ready", None
                    say("ready", at)

        for at, event, content, error in rows:
            run_timers(at)
            if status == "ended" or (status is None) != (event == "put"):
                continue
            if event == "put":
                attempts, raw = 1, content
                if content is None:
                    attempts = 0
                    end("dead", at, "malformed")
                else:
                    status = "ready"
                    say("ready", at)
            elif event == "take" and status == "ready":
                status, due = "taken", at + self.idle_s * 1_000_000
            elif event == "ack":
                end("done", at)
            elif event == "fail" and status == "taken":
                if attempts >= self.attempts:
                    end("dead", at, error or "failed")
                else:
                    status, due = "waiting", at + self.delay_s * 1_000_000
        run_timers(known)
        return out, None if status is None else (status, attempts, due, raw), due


def queue_stream(log: DataFrame, policy: Policy = Policy(), late: str = "10 minutes") -> DataFrame:
    """id, status, attempts, error, raw, at: what becomes of the jobs of a stream log(id, event, raw, error, at)."""
    return in_order(log, "id", "at", COLUMNS, policy.fold, KEPT, OUT, late)


def queue_history(log: DataFrame, policy: Policy = Policy(), until: str | None = None) -> DataFrame:
    """The same over a finished log; until: the moment up to which timers run."""
    return ordered_batch(log, "id", "at", COLUMNS, policy.fold, OUT, until)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue log of jobs made of events, one each: ended at once, after a failure, never, without an answer, without content, or twice offered."""
    events = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("way"), F.col("ts").cast("timestamp").alias("t"), "props")
    ways = {
        0: [("put", 0), ("take", 10), ("ack", 20)],
        1: [("put", 0), ("take", 10), ("fail", 20), ("take", 90), ("ack", 95)],
        2: [("put", 0), ("take", 1), ("fail", 2), ("take", 63), ("fail", 64), ("take", 125), ("fail", 126)],
        3: [("put", 0), ("take", 5)],
        4: [("put", 0), ("take", 5), ("take", 306), ("ack", 310)],
        5: [("put", 0), ("take", 5), ("ack", 6), ("put", 7), ("take", 8), ("fail", 9)],
    }
    steps = F.lit(None).cast("array<struct<event:string,after:int>>")
    for way, log in ways.items():
        steps = F.when(F.col("way") == way, F.array(*[F.struct(F.lit(e).alias("event"), F.lit(s).alias("after")) for e, s in log])).otherwise(steps)
    steps = F.when(F.col("way") == 6, F.array(F.struct(F.lit("put").alias("event"), F.lit(0).alias("after")))).otherwise(steps)
    rows = events.withColumn("s", F.explode(steps))
    raw = F.when((F.col("s.event") == "put") & (F.col("way") != 6), F.col("props"))
    return rows.select("id", "s.event", raw.alias("raw"), F.when(F.col("s.event") == "fail", F.concat(F.lit("error "), F.col("id").cast("string"))).alias("error"), F.timestamp_micros(F.unix_micros("t") + F.col("s.after") * 1_000_000).alias("at"))


@R.add(
    """WITH w(way, status, attempts, error, after) AS (VALUES (0, 'ready', 1, NULL, 0), (0, 'done', 1, NULL, 20), (1, 'ready', 1, NULL, 0), (1, 'ready', 2, NULL, 80), (1, 'done', 2, NULL, 95),
  (2, 'ready', 1, NULL, 0), (2, 'ready', 2, NULL, 62), (2, 'ready', 3, NULL, 124), (2, 'dead', 3, 'own', 126), (3, 'ready', 1, NULL, 0), (3, 'ready', 2, NULL, 305),
  (4, 'ready', 1, NULL, 0), (4, 'ready', 2, NULL, 305), (4, 'done', 2, NULL, 310), (5, 'ready', 1, NULL, 0), (5, 'done', 1, NULL, 6), (6, 'dead', 0, 'malformed', 0))
SELECT event_id AS id, status, CAST(attempts AS INTEGER) AS attempts, CASE WHEN error = 'own' THEN 'error ' || event_id ELSE error END AS error, epoch_us(ts) + after * 1000000 AS at_us FROM events JOIN w ON way = event_id % 7"""
)
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every event's job; a job taken once and never answered is ready again, and stays so."""
    return queue_history(event_log(spark, sf_dir)).select("id", "status", "attempts", "error", F.unix_micros("at").alias("at_us"))
