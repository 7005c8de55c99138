"""Reporting: filtered lists, statistics, timelines and campaigns over stored results."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.plans.registry import Registry
from posthound.session import shares, written
from posthound.sources import adapters as src

R = Registry()
TIME_ZONE = "America/Argentina/Buenos_Aires"
THREATS = ("suspicious", "malicious")
MAX_IDS, MAX_QUERY, MAX_PAGE = 1000, 200, 500


@dataclass
class ResultFilter:
    """Conjunctive conditions on results; what is None does not filter."""

    ids: list | None = None
    level: str | None = None
    min_level: str | None = None
    connector: str | None = None
    mailbox: str | None = None
    q: str | None = None
    sha256: str | None = None
    family: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    include_false_positives: bool = True
    _extra: list[Column] = field(default_factory=list)

    def apply(self, results: DataFrame, artifacts: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
        c = F.col
        if self.ids is not None:
            if len(set(self.ids)) > MAX_IDS:
                raise ValueError(f"at most {MAX_IDS} ids")
            results = results.filter(c("id").isin(list(set(self.ids))) if self.ids else F.lit(False))
        if self.level:
            results = results.filter(c("level") == self.level)
        if self.min_level:
            least = src.LEVEL_RANK[self.min_level]
            results = results.filter(c("level").isin([k for k, v in src.LEVEL_RANK.items() if v >= least]))
        if self.connector:
            results = results.filter(c("connector") == self.connector[:64])
        if self.mailbox:
            results = results.filter(F.lower(F.trim("mailbox")) == self.mailbox.strip().lower())
        if self.since is not None:
            results = results.filter(c("received_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            results = results.filter(c("received_at") <= F.lit(self.until).cast("timestamp_ntz"))
        if not self.include_false_positives:
            results = results.filter(~c("false_positive"))
        if self.sha256:
            results = results.join(artifacts.filter(c("sha256") == self.sha256.lower()).select(c("analysis_id").alias("id")).distinct(), "id", "left_semi")
        if self.q and self.q.strip():
            results = self._search(results, artifacts, self.q.strip()[:MAX_QUERY].lower())
        if self.family:
            wanted = self.family.lower()
            own = F.exists("families", lambda f: F.lower(f) == wanted) if "families" in results.columns else F.lit(False)
            if findings is None:
                results = results.filter(own)
            else:
                keys = findings.filter(F.lower("malware_family") == wanted).select(c("analysis_id").alias("_hit")).distinct()
                results = results.join(keys, c("id") == c("_hit"), "left").filter(own | c("_hit").isNotNull()).drop("_hit")
        return results

    @staticmethod
    def _search(results: DataFrame, artifacts: DataFrame | None, q: str) -> DataFrame:
        """Literal, case-insensitive search over text columns, attachment names and, from 8 hex digits on, hash prefixes."""
        texts = [F.lower(F.coalesce(n, F.lit(""))).contains(q) for n in ("subject", "from_addr", "from_display") if n in results.columns]
        own = F.lit(False)
        for t in texts:
            own = own | t
        if artifacts is None:
            return results.filter(own)
        hit = F.lower("filename").contains(q)
        if len(q) >= 8 and all(ch in "0123456789abcdef" for ch in q):
            hit = hit | F.col("sha256").startswith(q)
        keys = artifacts.filter(hit).select(F.col("analysis_id").alias("_hit")).distinct()
        return results.join(keys, F.col("id") == F.col("_hit"), "left").filter(own | F.col("_hit").isNotNull()).drop("_hit")


def page(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, ids breaking ties; limit is held within 1 to 500."""
    return results.orderBy(F.desc("received_at"), F.desc("id")).offset(max(0, offset)).limit(min(MAX_PAGE, max(1, limit)))


def _q(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}"


A, M, FI, AR = src.ANALYSES_SQL, src.MAILS_SQL, src.FINDINGS_SQL, src.ARTIFACTS_SQL


# --- statistics --------------------------------------------------------------------------------------------------------------


@R.add(_q([A], "SELECT level, count(*) AS n FROM analyses GROUP BY level"))
def stats_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.analyses(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@R.add(_q([A], "SELECT connector, count(*) AS n FROM analyses GROUP BY connector"))
def stats_by_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.analyses(spark, sf_dir).groupBy("connector").agg(F.count(F.lit(1)).alias("n"))


@R.add(_q([A], "SELECT CAST(round(coalesce(CAST(sum(duration_ms) AS DOUBLE) / count(duration_ms), 0), 1) AS DOUBLE) AS avg_ms FROM analyses"))
def stats_avg_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.analyses(spark, sf_dir).agg(F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 1).alias("avg_ms"))


@R.add(_q([A], "SELECT level, connector, count(*) AS n, max(score) AS max_score FROM analyses GROUP BY level, connector"))
def stats_level_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.analyses(spark, sf_dir).groupBy("level", "connector").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))


@R.add(
    _q(
        [A],
        """SELECT count(*) AS total, CAST(sum(CASE WHEN level = 'clean' THEN 1 ELSE 0 END) AS BIGINT) AS clean, CAST(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error,
 CAST(sum(CASE WHEN level = 'suspicious' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious, CAST(sum(CASE WHEN level = 'malicious' THEN 1 ELSE 0 END) AS BIGINT) AS malicious,
 CAST(sum(CASE WHEN false_positive THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM analyses""",
    )
)
def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [F.count_if(F.col("level") == n).alias(n) for n in src.LEVEL_RANK]
    return src.analyses(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), *by, F.count_if("false_positive").alias("false_positives"))


@R.add(_q([A], "SELECT from_addr, count(*) AS n FROM analyses WHERE level IN ('suspicious', 'malicious') AND from_addr <> '' GROUP BY from_addr ORDER BY n DESC, from_addr LIMIT 10"))
def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.analyses(spark, sf_dir).filter(F.col("level").isin(*THREATS) & (F.col("from_addr") != ""))
    return rows.groupBy("from_addr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_addr").limit(10)


@R.add(_q([FI, M], "SELECT rule, count(DISTINCT f.analysis_id) AS n FROM findings f JOIN mails m ON f.analysis_id = m.id WHERE severity > 0 GROUP BY rule ORDER BY n DESC, rule LIMIT 10"))
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.findings(spark, sf_dir).filter("severity > 0").select("analysis_id", "rule")
    # Both sides dealt by mail over as many tasks as the lines need: pairs become distinct where they lie, without a further shuffle.
    tasks = shares(src.table(spark, sf_dir, "lineitem"), 2_000_000)
    mails = src.mails(spark, sf_dir).select(F.col("id").alias("analysis_id")).repartition(tasks, "analysis_id")
    pairs = rows.repartition(tasks, "analysis_id").hint("merge").join(mails, "analysis_id", "left_semi").distinct()
    return pairs.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(10)


@R.add(_q([A], "SELECT family, count(*) AS n FROM (SELECT unnest(list_distinct(families)) AS family FROM analyses) GROUP BY family ORDER BY n DESC, family LIMIT 10"))
def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family counts once per mail."""
    return src.analyses(spark, sf_dir).select(F.explode(F.array_distinct("families")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family").limit(10)


# --- timelines -----------------------------------------------------------------------------------------------------------------


def timeline(results: DataFrame, unit: str, zone: str, hours: int) -> DataFrame:
    """Zero-filled counts by local hour or day and level over the last `hours` before the newest result."""
    local = lambda c: F.date_format(F.date_trunc(unit, F.from_utc_timestamp(F.col(c).cast("timestamp"), zone)), "yyyy-MM-dd HH:mm:ss")
    # The spine steps hourly in UTC, so that zones with odd offsets and clock changes keep every bucket.
    now = results.agg(F.max(F.col("received_at").cast("timestamp")).alias("now"))
    spine = now.select(F.explode(F.expr(f"sequence(date_trunc('HOUR', now - interval {hours} hours), now, interval 1 hour)")).alias("h")).select(local("h").alias("bucket")).distinct()
    recent = results.join(F.broadcast(now), F.col("received_at").cast("timestamp") >= F.expr(f"date_trunc('HOUR', now - interval {hours} hours)")).drop("now")
    counts = recent.select(local("received_at").alias("bucket"), "level").groupBy("bucket").pivot("level", list(src.LEVEL_RANK)).count()
    return spine.join(counts, "bucket", "left").na.fill(0, list(src.LEVEL_RANK))


def _timeline_sql(unit: str, hours: int) -> str:
    local = f"(%s AT TIME ZONE 'UTC') AT TIME ZONE '{TIME_ZONE}'"
    bucket = lambda c: f"strftime(date_trunc('{unit}', {local % c}), '%Y-%m-%d %H:%M:%S')"
    since = f"(SELECT date_trunc('hour', max(received_at) - INTERVAL {hours} HOUR) FROM analyses)"
    cols = ", ".join(f"CAST(coalesce(sum(CASE WHEN level = '{n}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for n in src.LEVEL_RANK)
    return _q(
        [
            A,
            f"spine AS (SELECT DISTINCT {bucket('h')} AS bucket FROM (SELECT unnest(generate_series({since}, (SELECT max(received_at) FROM analyses), INTERVAL 1 HOUR)) AS h))",
            f"hits AS (SELECT {bucket('received_at')} AS bucket, level FROM analyses WHERE received_at >= {since})",
        ],
        f"SELECT spine.bucket AS bucket, {cols} FROM spine LEFT JOIN hits ON spine.bucket = hits.bucket GROUP BY spine.bucket",
    )


@R.add(_timeline_sql("hour", 72))
def timeline_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(src.analyses(spark, sf_dir), "HOUR", TIME_ZONE, 72)


@R.add(_timeline_sql("day", 24 * 90))
def timeline_day_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(src.analyses(spark, sf_dir), "DAY", TIME_ZONE, 24 * 90)


# --- campaigns -----------------------------------------------------------------------------------------------------------------


def campaigns(artifacts: DataFrame, results: DataFrame, least: int = 2, limit: int = 50, include_clean: bool = False) -> DataFrame:
    """Attachments that several mails share: counts, time range, commonest name and type, mailboxes, worst level."""
    keep = F.lit(True) if include_clean else F.col("level").isin(*THREATS) & ~F.col("false_positive")
    rows = artifacts.join(results.filter(keep).withColumnRenamed("id", "analysis_id"), "analysis_id").filter(F.length("sha256") > 0)
    grouped = rows.groupBy("sha256").agg(
        F.count_distinct("analysis_id").alias("n"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.max_by("level", src.level_rank(F.col("level"))).alias("level")
    )
    top = grouped.filter(F.col("n") >= least).orderBy(F.desc("n"), F.desc("last_seen"), "sha256").limit(limit)
    # At most `limit` campaigns: what they hold is counted in one pass, and the three summaries read the counts.
    top = written(top, "campaigns")
    held = rows.join(F.broadcast(top.select("sha256")), "sha256", "left_semi").groupBy("sha256", "filename", "detected_type", "mailbox")
    detail = written(held.agg(F.count(F.lit(1)).alias("mails")), "campaign_counts")
    # The commonest value, ties to the smaller one.
    common = lambda c: detail.groupBy("sha256", c).agg(F.sum("mails").alias("k")).groupBy("sha256").agg(F.min(F.struct((-F.col("k")).alias("k"), c)).alias("m")).select("sha256", F.col(f"m.{c}").alias(c))
    boxes = detail.select("sha256", "mailbox").distinct().groupBy("sha256").agg(F.slice(F.array_sort(F.collect_list("mailbox")), 1, 200).alias("boxes"))
    out = top.join(common("filename"), "sha256").join(common("detected_type"), "sha256").join(boxes, "sha256")
    return out.select("sha256", "n", "first_seen", "last_seen", "level", "filename", "detected_type", F.array_join("boxes", ",").alias("mailboxes"))


_CAMPAIGN = """rows AS (SELECT a.*, m.mailbox, m.received_at, m.level FROM artifacts a JOIN mails m ON a.analysis_id = m.id WHERE m.level IN ('suspicious', 'malicious') AND NOT m.false_positive),
top AS (SELECT sha256, count(DISTINCT analysis_id) AS n, min(received_at) AS first_seen, max(received_at) AS last_seen, arg_max(level, CASE level WHEN 'malicious' THEN 3 ELSE 2 END) AS level
  FROM rows GROUP BY sha256 HAVING count(DISTINCT analysis_id) >= 2 ORDER BY n DESC, last_seen DESC, sha256 LIMIT 50),
names AS (SELECT sha256, arg_min(filename, (-k, filename)) AS filename FROM (SELECT sha256, filename, count(*) AS k FROM rows GROUP BY ALL) GROUP BY sha256),
types AS (SELECT sha256, arg_min(detected_type, (-k, detected_type)) AS detected_type FROM (SELECT sha256, detected_type, count(*) AS k FROM rows GROUP BY ALL) GROUP BY sha256),
boxes AS (SELECT sha256, string_agg(mailbox, ',' ORDER BY mailbox) AS mailboxes FROM (SELECT DISTINCT sha256, mailbox FROM rows) GROUP BY sha256)"""


@R.add(_q([M, AR, _CAMPAIGN], "SELECT top.*, filename, detected_type, mailboxes FROM top JOIN names USING (sha256) JOIN types USING (sha256) JOIN boxes USING (sha256)"), name="campaigns")
def campaigns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns(src.artifacts(spark, sf_dir), src.mails(spark, sf_dir))


@R.add(_q([M, AR, _CAMPAIGN], "SELECT rows.sha256, rows.analysis_id, position, mailbox, rows.level FROM rows JOIN top USING (sha256)"))
def campaign_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = campaigns(src.artifacts(spark, sf_dir), src.mails(spark, sf_dir)).select("sha256")
    rows = src.artifacts(spark, sf_dir).join(src.mails(spark, sf_dir).filter(F.col("level").isin(*THREATS) & ~F.col("false_positive")).withColumnRenamed("id", "analysis_id"), "analysis_id")
    return rows.join(F.broadcast(top), "sha256", "left_semi").select("sha256", "analysis_id", "position", "mailbox", "level")


# --- lists ---------------------------------------------------------------------------------------------------------------------

_COLS = "id, connector, mailbox, level, score"


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(*_COLS.split(", "))


def _list(name: str, where: str, flt: ResultFilter) -> None:
    R.add(_q([A], f"SELECT {_COLS} FROM analyses WHERE {where}"), name=name)(lambda spark, sf_dir: _listed(flt.apply(src.analyses(spark, sf_dir))))


_list("list_ids", "id IN (1, 5, 8, 13, 21)", ResultFilter(ids=[1, 5, 8, 13, 21, 21]))
_list("list_no_ids", "false", ResultFilter(ids=[]))
_list("list_level", "level = 'error'", ResultFilter(level="error"))
_list("list_min_level", "level IN ('suspicious', 'malicious')", ResultFilter(min_level="suspicious"))
_list("list_connector", "connector = 'c2'", ResultFilter(connector="c2"))
_list("list_mailbox_ci", "lower(trim(mailbox)) = 'u8@corp.example'", ResultFilter(mailbox=" u8@CORP.example "))
_list("list_q_literal", "contains(lower(subject), '0% 3_') OR contains(lower(from_addr), '0% 3_')", ResultFilter(q="0% 3_"))
_list("list_family", "list_contains(list_transform(families, lambda f: lower(f)), 'fam2')", ResultFilter(family="FAM2"))
_list("list_range", "received_at >= TIMESTAMP '2024-01-05 00:00:00' AND received_at <= TIMESTAMP '2024-01-09 23:59:59.999999'", ResultFilter(since=datetime(2024, 1, 5), until=datetime(2024, 1, 9, 23, 59, 59, 999999)))
_list("list_no_fp", "NOT false_positive AND level IN ('suspicious', 'malicious')", ResultFilter(min_level="suspicious", include_false_positives=False))


@R.add(_q([A], f"SELECT {_COLS} FROM analyses WHERE received_at >= TIMESTAMP '2024-01-05 03:00:00' AND received_at <= TIMESTAMP '2024-01-09 02:59:59.999999' AND level IN ('suspicious', 'malicious') AND NOT false_positive"))
def list_local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's form: threats of local calendar days 5 to 8 January, false positives hidden."""
    bound = lambda s: F.to_utc_timestamp(F.lit(s).cast("timestamp"), TIME_ZONE)
    at = F.col("received_at").cast("timestamp")
    rows = ResultFilter(min_level="suspicious", include_false_positives=False).apply(src.analyses(spark, sf_dir))
    return _listed(rows.filter((at >= bound("2024-01-05 00:00:00")) & (at < bound("2024-01-09 00:00:00"))))


@R.add(_q([M, AR], "SELECT id, mailbox, level FROM mails WHERE EXISTS (SELECT 1 FROM artifacts a WHERE a.analysis_id = mails.id AND starts_with(a.sha256, substr(sha256('7'), 1, 12)))"))
def list_sha_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    q = hashlib.sha256(b"7").hexdigest()[:12]
    return ResultFilter(q=q).apply(src.mails(spark, sf_dir), src.artifacts(spark, sf_dir)).select("id", "mailbox", "level")


@R.add(_q([M, AR], "SELECT id, mailbox, level FROM mails WHERE id IN (SELECT analysis_id FROM artifacts WHERE sha256 = sha256('11'))"))
def list_sha_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return ResultFilter(sha256=hashlib.sha256(b"11").hexdigest().upper()).apply(src.mails(spark, sf_dir), src.artifacts(spark, sf_dir)).select("id", "mailbox", "level")


@R.add(_q([M, FI], "SELECT id, mailbox, level FROM mails WHERE EXISTS (SELECT 1 FROM findings f WHERE f.analysis_id = mails.id AND lower(f.malware_family) = 'emotet')"))
def list_finding_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ResultFilter(family="Emotet").apply(src.mails(spark, sf_dir), findings=src.findings(spark, sf_dir)).select("id", "mailbox", "level")


@R.add(
    _q(
        [M, FI, AR],
        """SELECT id, mailbox, level, (SELECT count(*) FROM findings f WHERE f.analysis_id = p.id) AS n_findings, (SELECT count(*) FROM artifacts a WHERE a.analysis_id = p.id) AS n_artifacts
FROM (SELECT * FROM mails ORDER BY received_at DESC, id DESC LIMIT 100 OFFSET 20) p""",
    )
)
def list_page_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.broadcast(page(src.mails(spark, sf_dir), 100, 20))
    count = lambda rows, name: rows.groupBy(F.col("analysis_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = shown
    for rows, name in ((src.findings(spark, sf_dir), "n_findings"), (src.artifacts(spark, sf_dir), "n_artifacts")):
        out = out.join(count(rows.join(shown.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi"), name), "id", "left")
    return out.select("id", "mailbox", "level", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"))


@R.add(
    _q(
        [M, FI, AR],
        """SELECT id, level, coalesce((SELECT string_agg(CAST(position AS VARCHAR) || ':' || rule || ':' || CAST(score AS VARCHAR), ',' ORDER BY position) FROM findings f WHERE f.analysis_id = m.id), '') AS findings,
 coalesce((SELECT string_agg(filename, ',' ORDER BY position) FROM artifacts a WHERE a.analysis_id = m.id), '') AS attachments FROM mails m""",
    )
)
def result_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("position").cast("string"), F.lit(":"), "rule", F.lit(":"), F.col("score").cast("string"))
    ordered = lambda rows, value, name: rows.groupBy(F.col("analysis_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", value.alias("v")))), lambda x: x["v"]), ",").alias(name))
    out = src.mails(spark, sf_dir).select("id", "level")
    out = out.join(ordered(src.findings(spark, sf_dir), said, "findings"), "id", "left").join(ordered(src.artifacts(spark, sf_dir), F.col("filename"), "attachments"), "id", "left")
    return out.na.fill("", ["findings", "attachments"])
