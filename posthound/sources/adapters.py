"""Relations of the engine read from the supplied tables: analyses, findings, artifacts, messages, feedback.

Each adapter has its twin as a DuckDB common table expression, so that queries can be held against SQL on the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.session import spread

#: Verdict levels from the least to the greatest.
LEVEL_RANK = {"clean": 0, "error": 1, "suspicious": 2, "malicious": 3}
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


#: Rows of a table in a task that makes several of each.
PER_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sf_dir: str, texts, note: str = " -- {}", of: str = "customer", key: str = "c_custkey") -> DataFrame:
    """id, text: each of texts(number below 10, text) once for every row of a table, with the row's key noted at its end; id is key * 10 + number."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).cast("string").alias("t")) for i, t in texts])
    before, after = note.split("{}")
    rows = spread(table(spark, sf_dir, of).select(key), PER_TASK, key).select(key, F.explode(each).alias("x"))
    return rows.select((F.col(key) * 10 + F.col("x.i")).alias("id"), F.concat("x.t", F.lit(before), F.col(key).cast("string"), F.lit(after)).alias("text"))


def level_rank(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in LEVEL_RANK.items():
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per event."""
    k = F.get_json_object("props", "$.k").cast("long")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") >= 70, "malicious").when(F.col("value") >= 30, "suspicious").otherwise("clean")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("connector"),
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@Corp.Example")).alias("mailbox"),
        F.concat(F.lit("m"), (F.col("event_id") % 1000).cast("string")).alias("remote_id"),
        F.concat(F.col("event_type"), F.lit(" 100% "), (k % 13).cast("string"), F.lit("_x")).alias("subject"),
        F.when(F.col("event_id") % 37 > 0, F.concat(F.lit("s"), (F.col("event_id") % 37).cast("string"), F.lit("@example.org"))).otherwise(F.lit("")).alias("from_addr"),
        F.col("ts").alias("received_at"),
        level.alias("level"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("score"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.when(k % 7 > 0, F.array(F.concat(F.lit("Fam"), (k % 7).cast("string")), F.concat(F.lit("Fam"), (k % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("families"),
        (k % 10 == 0).alias("false_positive"),
    )


ANALYSES_SQL = """analyses AS (
  SELECT event_id AS id, 'c' || CAST(user_id % 4 AS VARCHAR) AS connector, 'U' || CAST(user_id AS VARCHAR) || '@Corp.Example' AS mailbox,
    'm' || CAST(event_id % 1000 AS VARCHAR) AS remote_id, event_type || ' 100% ' || CAST(k % 13 AS VARCHAR) || '_x' AS subject,
    CASE WHEN event_id % 37 > 0 THEN 's' || CAST(event_id % 37 AS VARCHAR) || '@example.org' ELSE '' END AS from_addr, ts AS received_at,
    CASE WHEN event_type = 'error' THEN 'error' WHEN value >= 70 THEN 'malicious' WHEN value >= 30 THEN 'suspicious' ELSE 'clean' END AS level,
    CAST(least(100, floor(value)) AS INTEGER) AS score, CAST(floor(value * 10) AS BIGINT) AS duration_ms,
    CASE WHEN k % 7 > 0 THEN ['Fam' || CAST(k % 7 AS VARCHAR), 'Fam' || CAST(k % 3 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS families,
    k % 10 = 0 AS false_positive
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per order: the parents of findings and artifacts."""
    level = F.when(F.col("o_orderstatus") == "F", "malicious").when(F.col("o_orderstatus") == "P", "suspicious").otherwise("clean")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("box"), (F.col("o_custkey") % 50).cast("string")).alias("mailbox"),
        F.col("o_orderpriority").alias("connector"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string"), F.lit("@p"), (F.col("o_custkey") % 3).cast("string"), F.lit(".example")).alias("from_addr"),
        F.col("o_orderdate").alias("received_at"),
        level.alias("level"),
        (F.col("o_orderkey") % 11 == 0).alias("false_positive"),
    )


MAILS_SQL = """mails AS (
  SELECT o_orderkey AS id, 'box' || CAST(o_custkey % 50 AS VARCHAR) AS mailbox, o_orderpriority AS connector,
    's' || CAST(o_custkey % 20 AS VARCHAR) || '@p' || CAST(o_custkey % 3 AS VARCHAR) || '.example' AS from_addr, o_orderdate AS received_at,
    CASE o_orderstatus WHEN 'F' THEN 'malicious' WHEN 'P' THEN 'suspicious' ELSE 'clean' END AS level, o_orderkey % 11 = 0 AS false_positive
  FROM orders)"""

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def _position() -> Column:
    return F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)) - 1


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per order line; position is the order of emission."""
    score = F.rint(F.col("l_discount") * 1000).cast("int")
    rows = table(spark, sf_dir, "lineitem").withColumn("position", _position()).withColumn("score", score)
    severity = F.when(F.col("score") >= 90, 4).when(F.col("score") >= 60, 3).when(F.col("score") >= 25, 2).when(F.col("score") > 0, 1).otherwise(0)
    category = F.when(F.col("l_returnflag") == "A", "phishing").when(F.col("l_returnflag") == "R", "spoofing").otherwise("malware")
    return rows.select(
        F.col("l_orderkey").alias("analysis_id"),
        F.col("position").cast("int").alias("position"),
        F.concat(F.lit("r."), F.col("l_returnflag"), F.lit("."), F.col("l_linestatus"), (F.col("l_suppkey") % 4).cast("string")).alias("rule"),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("a"), (F.col("l_partkey") % 5).cast("string"))).alias("artifact_id"),
        F.when(F.col("l_suppkey") % 6 > 2, F.concat(F.element_at(F.array(F.lit("Agent Tesla"), F.lit("agent-tesla"), F.lit("Emotet"), F.lit("EMOTET")), (F.col("l_suppkey") % 4 + 1).cast("int")))).alias("malware_family"),
        category.alias("category"),
        severity.cast("int").alias("severity"),
        "score",
    )


FINDINGS_SQL = f"""findings AS (
  SELECT l_orderkey AS analysis_id, position, 'r.' || l_returnflag || '.' || l_linestatus || CAST(l_suppkey % 4 AS VARCHAR) AS rule,
    CASE WHEN l_partkey % 3 > 0 THEN 'a' || CAST(l_partkey % 5 AS VARCHAR) END AS artifact_id,
    CASE WHEN l_suppkey % 6 > 2 THEN ['Agent Tesla', 'agent-tesla', 'Emotet', 'EMOTET'][l_suppkey % 4 + 1] END AS malware_family,
    CASE l_returnflag WHEN 'A' THEN 'phishing' WHEN 'R' THEN 'spoofing' ELSE 'malware' END AS category,
    CASE WHEN score >= 90 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 25 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END AS severity, score
  FROM (SELECT *, CAST(round_even(l_discount * 1000, 0) AS INTEGER) AS score,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS INTEGER) AS position FROM lineitem))"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attachment per order line, its part's hash, name and type."""
    rows = table(spark, sf_dir, "lineitem").withColumn("position", _position().cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return rows.join(part, rows["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("analysis_id"), "position", F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), F.col("p_name").alias("filename"), F.col("p_type").alias("detected_type"), F.col("p_size").cast("long").alias("size")
    )


ARTIFACTS_SQL = f"""artifacts AS (
  SELECT l_orderkey AS analysis_id, position, sha256(CAST(l_partkey AS VARCHAR)) AS sha256, p_name AS filename, p_type AS detected_type, CAST(p_size AS BIGINT) AS size
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS INTEGER) AS position FROM lineitem)
  JOIN part ON l_partkey = p_partkey)"""
