"""Verdicts: adjusted findings, the noisy-OR score, escalation and families of each mail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.sources import adapters as src

R = Registry()
M, FI = src.MAILS_SQL, src.FINDINGS_SQL


@dataclass(frozen=True)
class ScoreConfig:
    """Thresholds, score overrides by rule (exact, or a prefix ending in `*`) and trusted senders (address, @domain or domain)."""

    suspicious: int = 30
    malicious: int = 70
    overrides: dict[str, int] = field(default_factory=dict)
    trusted: tuple[str, ...] = ()


HALVED = ("phishing", "spoofing", "suspicious_file")
ESCALATING = ("malware", "reputation")
TOO_LARGE = "policy.message_too_large"
SAMPLE = ScoreConfig(overrides={"r.A.F1": 0, "r.A*": 35, "r.A.O*": 55, "r.R.F2": 250, "r.N*": 12}, trusted=("s3@p0.example", "@p1.example"))


def override(rule: Column, score: Column, overrides: dict[str, int]) -> Column:
    """The score that applies: that of the exact rule, else of the longest prefix, else its own; null removes the finding."""
    exact = {k: v for k, v in overrides.items() if not k.endswith("*")}
    prefixes = sorted((k for k in overrides if k.endswith("*")), key=lambda k: (-len(k), k))
    out = score
    for k in reversed(prefixes):
        out = F.when(rule.startswith(k[:-1]), F.lit(overrides[k])).otherwise(out)
    for k, v in exact.items():
        out = F.when(rule == k, F.lit(v)).otherwise(out)
    touched = rule.isin(list(exact)) if exact else F.lit(False)
    for k in prefixes:
        touched = touched | rule.startswith(k[:-1])
    return F.when(touched & (out <= 0), F.lit(None)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), out)))


def is_trusted(address: Column, trusted: tuple[str, ...]) -> Column:
    address = F.lower(F.coalesce(address, F.lit("")))
    domain = F.substring_index(address, "@", -1)
    mails = [t.lower() for t in trusted if "@" in t and not t.startswith("@")]
    domains = [t.lower().lstrip("@") for t in trusted if "@" not in t or t.startswith("@")]
    return (address.isin(mails) if mails else F.lit(False)) | (domain.isin(domains) & address.contains("@") if domains else F.lit(False))


def effective_findings(findings: DataFrame, mails: DataFrame, config: ScoreConfig) -> DataFrame:
    """Findings with `adjusted`: overridden, and halved for trusted senders unless the mail shows spoofing."""
    rows = findings.withColumn("adjusted", override(F.col("rule"), F.col("score"), config.overrides).cast("double")).filter("adjusted is not null")
    if not config.trusted:
        return rows
    trusted = mails.select(F.col("id").alias("analysis_id"), is_trusted(F.col("from_addr"), config.trusted).alias("trusted"))
    spoofed = F.bool_or(((F.col("category") == "spoofing") & (F.col("severity") >= src.SEVERITY["high"])) | (F.col("rule") == "headers.dmarc_fail")).over(W.partitionBy("analysis_id"))
    rows = rows.join(trusted, "analysis_id").withColumn("spoofed", spoofed)
    halve = F.col("trusted") & ~F.col("spoofed") & F.col("category").isin(*HALVED) & (F.col("severity") <= src.SEVERITY["medium"])
    return rows.withColumn("adjusted", F.when(halve, F.col("adjusted") / 2).otherwise(F.col("adjusted"))).drop("trusted", "spoofed")


def family_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def verdicts(findings: DataFrame, mails: DataFrame, config: ScoreConfig) -> DataFrame:
    """analysis_id, level, score, families, top_rule of every mail; mails without findings are clean."""
    rows = effective_findings(findings, mails, config)
    # The factors multiply in the order of emission, so that the product is the same to the last bit everywhere.
    factors = F.transform(F.array_sort(F.collect_list(F.when(F.col("adjusted") > 0, F.struct("position", "adjusted")))), lambda x: 1 - x["adjusted"] / 100)
    ranked = F.struct((-F.col("severity")).alias("s"), (-F.col("adjusted")).alias("a"), "position", "rule")
    named = F.array_sort(F.collect_list(F.when(F.col("malware_family").isNotNull(), F.struct((-F.col("severity")).alias("s"), (-F.col("adjusted")).alias("a"), "position", F.col("malware_family").alias("f"), family_key(F.col("malware_family")).alias("k")))))
    by = rows.groupBy("analysis_id").agg(
        F.rint(100 * (1 - F.aggregate(factors, F.lit(1.0), lambda a, f: a * f))).cast("int").alias("score"),
        (F.bool_or((F.col("severity") >= src.SEVERITY["critical"]) & F.col("category").isin(*ESCALATING)) | (F.count_distinct(F.when(F.col("severity") >= src.SEVERITY["high"], F.col("rule"))) >= 2)).alias("escalated"),
        F.bool_or(F.col("rule") == TOO_LARGE).alias("partial"),
        F.min(ranked).alias("top"),
        named.alias("named"),
    )
    # The first label of each canonical name.
    kept = F.aggregate("named", F.array().cast("array<struct<f:string,k:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["f"].alias("f"), x["k"].alias("k"))))))
    level = F.when(F.col("escalated") | (F.col("score") >= config.malicious), "malicious").when(F.col("partial") | (F.col("score") >= config.suspicious), "suspicious").otherwise("clean")
    score = F.when(F.col("escalated"), F.greatest("score", F.lit(config.malicious))).when(F.col("partial"), F.greatest("score", F.lit(config.suspicious))).otherwise(F.col("score"))
    by = by.select("analysis_id", level.alias("level"), score.alias("score"), F.array_join(F.transform(kept, lambda x: x["f"]), ",").alias("families"), F.col("top.rule").alias("top_rule"))
    return mails.select(F.col("id").alias("analysis_id")).join(by, "analysis_id", "left").na.fill({"level": "clean", "score": 0, "families": "", "top_rule": ""})


# The SQL twin, with SAMPLE's overrides and trusted senders written out.
_EFFECTIVE = """adjusted0 AS (SELECT *, CASE WHEN rule = 'r.A.F1' THEN 0 WHEN rule = 'r.R.F2' THEN 250 WHEN starts_with(rule, 'r.A.O') THEN 55 WHEN starts_with(rule, 'r.A') THEN 35 WHEN starts_with(rule, 'r.N') THEN 12 ELSE score END AS o FROM findings),
adjusted1 AS (SELECT f.*, CAST(least(100, greatest(0, o)) AS DOUBLE) AS a0, lower(m.from_addr) = 's3@p0.example' OR lower(m.from_addr) LIKE '%@p1.example' AS trusted,
  bool_or((category = 'spoofing' AND severity >= 3) OR rule = 'headers.dmarc_fail') OVER (PARTITION BY analysis_id) AS spoofed
  FROM adjusted0 f JOIN mails m ON f.analysis_id = m.id WHERE NOT (rule = 'r.A.F1')),
effective AS (SELECT *, CASE WHEN trusted AND NOT spoofed AND category IN ('phishing', 'spoofing', 'suspicious_file') AND severity <= 2 THEN a0 / 2 ELSE a0 END AS adjusted FROM adjusted1)"""
_PLAIN = "effective AS (SELECT *, CAST(score AS DOUBLE) AS adjusted FROM findings)"
_VERDICT = """by_mail AS (SELECT analysis_id,
    CAST(round_even(100 * (1 - list_reduce(list_prepend(CAST(1 AS DOUBLE), coalesce(list(1 - adjusted / 100 ORDER BY position) FILTER (WHERE adjusted > 0), [])), lambda a, b: a * b)), 0) AS INTEGER) AS score,
    bool_or(severity >= 4 AND category IN ('malware', 'reputation')) OR count(DISTINCT CASE WHEN severity >= 3 THEN rule END) >= 2 AS escalated,
    bool_or(rule = 'policy.message_too_large') AS partial, arg_min(rule, (-severity, -adjusted, position)) AS top_rule FROM effective GROUP BY analysis_id),
first_name AS (SELECT analysis_id, k, arg_min(malware_family, (-severity, -adjusted, position)) AS f, min((-severity, -adjusted, position)) AS first_at
    FROM (SELECT *, regexp_replace(lower(malware_family), '[^a-z0-9]', '', 'g') AS k FROM effective WHERE malware_family IS NOT NULL) GROUP BY analysis_id, k),
names AS (SELECT analysis_id, string_agg(f, ',' ORDER BY first_at) AS families FROM first_name GROUP BY analysis_id),
verdict AS (SELECT m.id AS analysis_id, coalesce(CASE WHEN escalated OR score >= 70 THEN 'malicious' WHEN partial OR score >= 30 THEN 'suspicious' ELSE 'clean' END, 'clean') AS level,
    coalesce(CASE WHEN escalated THEN greatest(score, 70) WHEN partial THEN greatest(score, 30) ELSE score END, 0) AS score, coalesce(families, '') AS families, coalesce(top_rule, '') AS top_rule
    FROM mails m LEFT JOIN by_mail ON m.id = by_mail.analysis_id LEFT JOIN names ON m.id = names.analysis_id)"""


@R.add(_q([M, FI, _PLAIN, _VERDICT], "SELECT * FROM verdict"))
def score_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(src.findings(spark, sf_dir), src.mails(spark, sf_dir), ScoreConfig())


@R.add(_q([M, FI, _EFFECTIVE, _VERDICT], "SELECT * FROM verdict"))
def score_overrides_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(src.findings(spark, sf_dir), src.mails(spark, sf_dir), SAMPLE)


@R.add(_q([M, FI, _EFFECTIVE], "SELECT analysis_id, position, rule, adjusted FROM effective"), name="effective_findings")
def effective_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective_findings(src.findings(spark, sf_dir), src.mails(spark, sf_dir), SAMPLE).select("analysis_id", "position", "rule", "adjusted")


@R.add(_q([M, FI, _PLAIN, _VERDICT], "SELECT level, count(*) AS n, CAST(sum(score) AS BIGINT) AS score_sum FROM verdict GROUP BY level"))
def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_verdict(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, rule, artifact_id ORDER BY position) AS k FROM findings) WHERE k = 1"


@R.add(_q([FI], f"SELECT analysis_id, position, rule, artifact_id FROM ({_FIRST})"))
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each mail's findings with one rule and attachment; no attachment equals no attachment."""
    first = F.row_number().over(W.partitionBy("analysis_id", "rule", "artifact_id").orderBy("position"))
    return src.findings(spark, sf_dir).withColumn("k", first).filter("k = 1").select("analysis_id", "position", "rule", "artifact_id")


@R.add(_q([FI], "SELECT analysis_id, position, rule, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY severity DESC, score DESC, position) AS INTEGER) AS rank FROM findings"))
def rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("analysis_id").orderBy(F.desc("severity"), F.desc("score"), "position")
    return src.findings(spark, sf_dir).select("analysis_id", "position", "rule", F.row_number().over(order).alias("rank"))


@R.add(_q([FI], "SELECT analysis_id, rule, position FROM (SELECT analysis_id, rule, min(position) AS position, row_number() OVER (PARTITION BY analysis_id ORDER BY min(position)) AS k FROM findings GROUP BY analysis_id, rule) WHERE k <= 3"))
def first_n_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct rules of each mail, in order of emission."""
    rows = src.findings(spark, sf_dir).groupBy("analysis_id", "rule").agg(F.min("position").alias("position"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("analysis_id").orderBy("position"))).filter("k <= 3").select("analysis_id", "rule", "position")


@R.add(
    _q(
        [FI],
        """SELECT analysis_id, rule, coalesce(artifact_id, '') AS artifact, max(score) AS best, string_agg(DISTINCT coalesce(malware_family, '-'), ',' ORDER BY coalesce(malware_family, '-')) AS names, count(*) AS n
FROM findings GROUP BY analysis_id, rule, artifact_id""",
    )
)
def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one rule and attachment as one: the best score and its distinct names."""
    rows = src.findings(spark, sf_dir)
    names = F.array_join(F.array_sort(F.collect_set(F.coalesce("malware_family", F.lit("-")))), ",")
    return rows.groupBy("analysis_id", "rule", "artifact_id").agg(F.max("score").alias("best"), names.alias("names"), F.count(F.lit(1)).alias("n")).select("analysis_id", "rule", F.coalesce("artifact_id", F.lit("")).alias("artifact"), "best", "names", "n")
