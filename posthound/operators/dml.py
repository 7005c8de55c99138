"""Writes to stored results: insert-if-absent, feedback, actions, retention, bounded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.sources import adapters as src

R = Registry()
KEY = ("connector", "mailbox", "remote_id")
MAX_KEY, MAX_ACTIONS, MAX_TEXT = 255, 200, 2000
A = src.ANALYSES_SQL


def clip(text: Column, n: int) -> Column:
    """At most n code points, the last an ellipsis if anything was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def clean(text: Column) -> Column:
    """Without NUL characters and with invalid UTF-8 replaced."""
    return F.replace(F.make_valid_utf8(text), F.lit("\0"), F.lit(""))


def key_part(text: Column, n: int = MAX_KEY) -> Column:
    """A key column as stored: parts that are too long or hold control characters become their hash."""
    text = F.coalesce(text, F.lit(""))
    return F.when((F.length(text) > n) | text.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({k: key_part(F.col(k)) for k in KEY})


def new_results(incoming: DataFrame, stored: DataFrame, order: str = "received_at") -> DataFrame:
    """Rows of incoming whose natural key is not stored; of several with one key the first by `order`, then id."""
    first = F.row_number().over(W.partitionBy(*KEY).orderBy(order, "id"))
    fresh = with_keys(incoming).withColumn("_k", first).filter("_k = 1").drop("_k")
    return fresh.join(with_keys(stored).select(*KEY).distinct(), list(KEY), "left_anti").select(*incoming.columns)


def has_ref(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return with_keys(incoming).join(with_keys(stored).select(*KEY).distinct(), list(KEY), "left_semi")


def merge_actions(old: Column, new: Column, most: int = MAX_ACTIONS) -> Column:
    """Ordered union of two lists of actions."""
    return F.slice(F.array_distinct(F.concat(old, new)), 1, most)


def latest_feedback(log: DataFrame, key: str = "id", at: str = "fp_at") -> DataFrame:
    """The last entry of an append-only feedback log per result; ties by user."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), F.desc("fp_user")))
    return log.withColumn("_k", last).filter("_k = 1").drop("_k")


def expired(results: DataFrame, cutoff: Column) -> DataFrame:
    return results.filter(F.col("received_at") < cutoff)


def bounded(results: DataFrame, texts: tuple[str, ...] = ("subject",), lists: tuple[str, ...] = ("families",), n: int = MAX_TEXT, most: int = MAX_ACTIONS) -> DataFrame:
    """Columns as the writer stores them: texts cleaned and clipped, lists cut."""
    return results.withColumns({c: clip(clean(F.col(c)), n) for c in texts} | {c: F.slice(c, 1, most) for c in lists})


# --- queries: odd events are stored, the rest comes in -----------------------------------------------------------------------

_SPLIT = "stored AS (SELECT * FROM analyses WHERE id % 3 = 0), incoming AS (SELECT * FROM analyses WHERE id % 3 > 0)"


@R.add(_q([A, _SPLIT], "SELECT id FROM incoming i WHERE EXISTS (SELECT 1 FROM stored s WHERE s.connector = i.connector AND s.mailbox = i.mailbox AND s.remote_id = i.remote_id)"))
def has_ref_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir)
    return has_ref(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")).select("id")


@R.add(
    _q(
        [A, _SPLIT],
        """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY connector, mailbox, remote_id ORDER BY received_at, id) AS k FROM incoming) i
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.connector = i.connector AND s.mailbox = i.mailbox AND s.remote_id = i.remote_id)""",
    )
)
def new_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir)
    return new_results(rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")).select("id")


@R.add("SELECT doc_id, CASE WHEN length(text) > 255 OR regexp_matches(text, '[\\x00-\\x1f\\x7f]') THEN 'sha256:' || sha256(text) ELSE text END AS key FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def key_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", key_part(F.col("text")).alias("key"))


@R.add(_q([A], "SELECT id, array_to_string(list_distinct_ordered, ',') AS actions FROM (SELECT id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_concat(families, ['label', level, 'label']), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END) AS list_distinct_ordered FROM analyses)"), name="merge_actions")
def merge_actions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.analyses(spark, sf_dir).select("id", F.array_join(merge_actions(F.col("families"), F.array(F.lit("label"), F.col("level"), F.lit("label"))), ",").alias("actions"))


_FEEDBACK = """log AS (SELECT doc_id AS id, quality = 1 AND toxic = 0 AS false_positive, 'u' || CAST(doc_id % 5 AS VARCHAR) AS fp_user, doc_id % 7 AS fp_at FROM labels
  UNION ALL SELECT doc_id - doc_id % 4, toxic = 1, 'v' || CAST(doc_id % 3 AS VARCHAR), doc_id % 11 FROM labels)"""


@R.add(_q([_FEEDBACK], "SELECT id, max(fp_at) AS fp_at, arg_max(fp_user, (fp_at, fp_user)) AS fp_user FROM log GROUP BY id"), name="latest_feedback")
def latest_feedback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = src.table(spark, sf_dir, "labels")
    one = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("false_positive"), F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")).alias("fp_user"), (F.col("doc_id") % 7).alias("fp_at"))
    two = labels.select((F.col("doc_id") - F.col("doc_id") % 4).alias("id"), (F.col("toxic") == 1).alias("false_positive"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("fp_user"), (F.col("doc_id") % 11).alias("fp_at"))
    return latest_feedback(one.unionByName(two)).select("id", "fp_at", "fp_user")


@R.add(_q([A], "SELECT level, count(*) AS kept FROM analyses WHERE NOT received_at < (SELECT max(received_at) - INTERVAL 20 DAY FROM analyses) GROUP BY level"))
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge of everything older than 20 days before the newest result leaves, by level."""
    rows = src.analyses(spark, sf_dir)
    cutoff = rows.agg((F.max("received_at") - F.expr("interval 20 days")).alias("cutoff"))
    return rows.join(F.broadcast(cutoff), ~(F.col("received_at") < F.col("cutoff"))).groupBy("level").agg(F.count(F.lit(1)).alias("kept"))


@R.add("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS text FROM documents")
def bounded_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(src.table(spark, sf_dir, "documents").select("doc_id", "text"), ("text",), (), 120)
