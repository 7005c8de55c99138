"""Alerts: grouping keys, threat profiles, payloads for machines, chat services and log collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.functions.text import defang
from posthound.operators.dml import clip
from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.plans.scoring import _PLAIN, _VERDICT, score_verdict
from posthound.sources import adapters as src

R = Registry()
#: Profile flags and the rule words or categories that raise them.
PROFILE = {"malware": (("r.N",), ("malware",)), "phishing": (("r.A",), ("phishing",)), "spoofing": (("r.R",), ("spoofing",)), "open_line": (("O",), ())}


def dedup_keys(mails: DataFrame, artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """analysis_id, dedup_key: the sorted distinct hashes of attachments of flagged mails, hashed; without any, the sender."""
    flagged = findings.filter(F.col("severity") >= src.SEVERITY["medium"]).select("analysis_id").distinct()
    hashes = artifacts.join(flagged, "analysis_id", "left_semi").filter(F.length("sha256") > 0).groupBy("analysis_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("sha256"))), ",").alias("h"))
    out = mails.select(F.col("id").alias("analysis_id"), "from_addr").join(hashes, "analysis_id", "left")
    return out.select("analysis_id", F.sha2(F.coalesce("h", F.concat(F.lit("from:"), F.lower("from_addr"))), 256).alias("dedup_key"))


def profile(findings: DataFrame) -> DataFrame:
    """analysis_id and one flag per threat: any finding whose rule words or category tell it."""
    words = F.split("rule", r"\.")
    flags = []
    for name, (prefixes, categories) in PROFILE.items():
        hit = F.col("category").isin(*categories) if categories else F.lit(False)
        for p in prefixes:
            hit = hit | (F.col("rule").startswith(p) if "." in p else F.exists(words, lambda w: w.startswith(p)))  # noqa: B023
        flags.append(F.bool_or(hit).alias(name))
    return findings.groupBy("analysis_id").agg(*flags)


def payload(rows: DataFrame) -> Column:
    """The machine-readable alert of rows(id, level, score, subject, from_addr)."""
    return F.to_json(F.struct("id", "level", "score", defang(F.col("subject")).alias("subject"), defang(F.col("from_addr")).alias("sender")))


def slack_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cef(rows: DataFrame, vendor: str = "posthound") -> Column:
    """A Common Event Format line; header and extension values are escaped by their own rules."""
    head = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    value = lambda c: F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")), r"[\r\n]+", " ")
    severity = F.when(F.col("level") == "malicious", "10").when(F.col("level") == "suspicious", "6").otherwise(F.lit("1"))
    return F.concat(F.lit(f"CEF:0|{vendor}|mail|1|"), head(F.col("level")), F.lit("|"), head(F.col("subject")), F.lit("|"), severity, F.lit("|suser="), value(F.col("from_addr")), F.lit(" cn1="), F.col("score").cast("string"))


#: What a reader should do about each threat of a profile.
ADVICE = (("malware", "Isolate the attachments and scan the receiving hosts."), ("phishing", "Do not follow the links; reset passwords that were typed in."), ("spoofing", "Confirm the sender by another way."))


def recommendations(flags: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(flags[k], F.lit(text)) for k, text in ADVICE]), lambda x: x.isNotNull())


def summary(top_rule: Column, families: Column, most: int = 480) -> Column:
    """One sentence on a verdict: its strongest reason and the families it names."""
    text = F.concat(F.lit("Strongest sign: "), F.coalesce(top_rule, F.lit("none")), F.when(F.coalesce(families, F.lit("")) != "", F.concat(F.lit("; names "), F.regexp_replace(families, ",", ", "))).otherwise(F.lit("")), F.lit("."))
    return clip(text, most)


def chat_payload(service: str, title: Column, text: Column) -> Column:
    """The message body that a chat service's webhook takes."""
    if service == "slack":
        return F.to_json(F.struct(F.concat(F.lit("*"), slack_text(title), F.lit("*\n"), slack_text(text)).alias("text")))
    if service == "discord":
        return F.to_json(F.struct(clip(F.concat(F.lit("**"), title, F.lit("**\n"), text), 2000).alias("content")))
    if service == "teams":
        return F.to_json(F.struct(F.lit("MessageCard").alias("@type"), title.alias("title"), text.alias("text")))
    return F.to_json(F.struct(F.concat(title, F.lit("\n"), text).alias("text")))


M, A, AR, FI = src.MAILS_SQL, src.ANALYSES_SQL, src.ARTIFACTS_SQL, src.FINDINGS_SQL


@R.add(
    _q(
        [M, AR, FI],
        """, h AS (SELECT analysis_id, string_agg(DISTINCT lower(sha256), ',' ORDER BY lower(sha256)) AS h FROM artifacts WHERE analysis_id IN (SELECT analysis_id FROM findings WHERE severity >= 2) GROUP BY analysis_id)
SELECT m.id AS analysis_id, sha256(coalesce(h, 'from:' || lower(from_addr))) AS dedup_key FROM mails m LEFT JOIN h ON m.id = h.analysis_id""",
    ).replace("\n, h AS", ", h AS")
)
def alert_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_keys(src.mails(spark, sf_dir), src.artifacts(spark, sf_dir), src.findings(spark, sf_dir))


@R.add(_q([FI], "SELECT analysis_id, bool_or(category = 'malware' OR starts_with(rule, 'r.N')) AS malware, bool_or(category = 'phishing' OR starts_with(rule, 'r.A')) AS phishing, bool_or(category = 'spoofing' OR starts_with(rule, 'r.R')) AS spoofing, bool_or(contains(rule, '.O')) AS open_line FROM findings GROUP BY analysis_id"))
def threat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(src.findings(spark, sf_dir))


@R.add()
def alert_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir).filter("level = 'malicious'")
    return rows.select("id", payload(rows).alias("payload"))


@R.add(_q([A], "SELECT id, 'CEF:0|posthound|mail|1|malicious|' || subject || '|10|suser=' || from_addr || ' cn1=' || CAST(score AS VARCHAR) AS line FROM analyses WHERE level = 'malicious'"))
def alert_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir).filter("level = 'malicious'")
    return rows.select("id", cef(rows).alias("line"))


@R.add(_q([A], "SELECT le, count(*) FILTER (WHERE duration_ms <= le * 1000) AS n FROM analyses, (SELECT unnest(CAST([0.1, 0.25, 0.5, 1, 2.5, 5, 10] AS DOUBLE[])) AS le) GROUP BY le"))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of durations, in one pass over the results."""
    bounds = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
    one = src.analyses(spark, sf_dir).agg(*[F.count_if(F.col("duration_ms") <= b * 1000).alias(str(i)) for i, b in enumerate(bounds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.le", "x.n")


@R.add(
    _q(
        [M, FI, _PLAIN, _VERDICT],
        "SELECT analysis_id, 'Strongest sign: ' || top_rule || CASE WHEN families <> '' THEN '; names ' || replace(families, ',', ', ') ELSE '' END || '.' AS summary FROM verdict WHERE top_rule <> ''",
    )
)
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_verdict(spark, sf_dir).filter("top_rule <> ''").select("analysis_id", summary(F.col("top_rule"), F.col("families")).alias("summary"))


@R.add(
    _q(
        [FI],
        """SELECT analysis_id, CAST(malware AS INTEGER) + CAST(phishing AS INTEGER) + CAST(spoofing AS INTEGER) AS n FROM
 (SELECT analysis_id, bool_or(category = 'malware') AS malware, bool_or(category = 'phishing') AS phishing, bool_or(category = 'spoofing') AS spoofing FROM findings GROUP BY analysis_id)""",
    )
)
def alert_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = profile(src.findings(spark, sf_dir))
    return flags.select("analysis_id", F.size(recommendations({k: F.col(k) for k, _ in ADVICE})).alias("n"))


@R.add()
def chat_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir).filter("level = 'malicious'")
    return rows.select("id", *[chat_payload(s, F.col("level"), defang(F.col("subject"))).alias(s) for s in ("slack", "discord", "teams", "plain")])
