"""State beside the results and facts of single messages: key-value state, tags, cached reputation, lookups, signatures, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.functions import hosts, urls
from posthound.plans.registry import Registry
from posthound.plans.reports import THREATS, _q, campaigns
from posthound.sources import adapters as src

R = Registry()
M, FI, AR, A = src.MAILS_SQL, src.FINDINGS_SQL, src.ARTIFACTS_SQL, src.ANALYSES_SQL


# --- state -------------------------------------------------------------------------------------------------------------------


def upsert(state: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("namespace", "key"), order: str = "seq") -> DataFrame:
    """state with changes applied: of several rows of one key that with the largest `order` (ties: the largest row)."""
    rest = [c for c in state.columns if c not in keys]
    last = F.max(F.struct(order, *[c for c in rest if c != order])).alias("last")
    return state.unionByName(changes).groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


@R.add("SELECT event_type AS namespace, CAST(user_id % 100 AS BIGINT) AS key, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), (F.col("user_id") % 100).cast("long").alias("key"), "value", F.col("event_id").alias("seq"))
    return upsert(rows.filter("seq % 3 = 0"), rows.filter("seq % 3 > 0"))


def tagged(results: DataFrame, tags: DataFrame) -> DataFrame:
    """actions(id, action, label): what a connector writes back for each result, by the level's rows of tags(connector, level, action, label)."""
    return results.join(F.broadcast(tags), ["connector", "level"]).select("id", "action", "label")


_TAGS = (("c0", "malicious", "label", "threat"), ("c0", "suspicious", "label", "check"), ("c1", "malicious", "category", "Threat"), ("c1", "malicious", "move", "quarantine"), ("c2", "clean", "keyword", "$Scanned"))


@R.add(_q([A], f"SELECT a.id, t.action, t.label FROM analyses a JOIN (VALUES {', '.join(map(str, _TAGS))}) t(connector, level, action, label) ON a.connector = t.connector AND a.level = t.level"))
def tag_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(src.analyses(spark, sf_dir), spark.createDataFrame(list(_TAGS), "connector string, level string, action string, label string"))


def cached(lookups: DataFrame, cache: DataFrame, now: Column, found_hours: int = 24, absent_hours: int = 6) -> DataFrame:
    """lookups(indicator) with the cached answer `found` that is still valid at `now`, null where a new lookup is due.

    Positive answers hold for found_hours, negative ones for absent_hours; of several the newest counts.
    """
    newest = cache.groupBy("indicator").agg(F.max(F.struct("fetched_at", "found")).alias("c")).select("indicator", "c.found", "c.fetched_at")
    until = F.col("fetched_at") + F.when(F.col("found"), F.expr(f"interval {found_hours} hours")).otherwise(F.expr(f"interval {absent_hours} hours"))
    return lookups.join(newest.filter(until > now).select("indicator", "found"), "indicator", "left")


@R.add(
    """WITH c AS (SELECT user_id AS indicator, arg_max(value >= 50, (ts, value >= 50)) AS found, max(ts) AS fetched_at FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT indicator, CASE WHEN fetched_at + CASE WHEN found THEN INTERVAL 24 HOUR ELSE INTERVAL 6 HOUR END > now THEN found END AS found FROM c, n"""
)
def reputation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("indicator"), (F.col("value") >= 50).alias("found"), F.col("ts").alias("fetched_at"))
    now = rows.agg(F.max("fetched_at")).first()[0]
    return cached(rows.select("indicator").distinct(), rows, F.lit(now))


def with_columns_of(rows: DataFrame, version: int, wanted: dict[str, str], wanted_version: int) -> DataFrame:
    """Stored rows as this version reads them: columns that an older version lacks come as nulls; rows of a newer version are refused."""
    if version > wanted_version:
        raise ValueError(f"stored by version {version}, this is {wanted_version}")
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


# --- lookups ---------------------------------------------------------------------------------------------------------------------


def eligible(found: DataFrame, company: tuple[str, ...] = (), most: int = 20, longest: int = 2048) -> DataFrame:
    """message, rank, url: the first `most` distinct URLs of each message of found(message, position, url) that may be looked up.

    Only http and https, public hosts, none of the company's; user names and fragments never leave.
    """
    p = urls.parts(F.col("url"))
    number = hosts.ipv4_number(p["host"])
    top = F.shiftright(number, 24)
    reserved = hosts.is_private(number) | (top >= 224) | F.shiftright(number, 22).isin((100 << 2) + 1)
    inside = ~p["host"].contains(".") | p["host"].rlike(r"\.(localhost|local|internal|lan)$") | F.coalesce(reserved, F.lit(False))
    for domain in company:
        inside = inside | (p["host"] == domain) | p["host"].endswith(f".{domain}")
    bare = F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""), p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    good = found.filter((F.length("url") <= longest) & ~F.col("url").rlike(r"\s") & p["scheme"].isin("http", "https") & (p["host"] != "") & ~inside)
    first = good.groupBy("message", bare.alias("url")).agg(F.min("position").alias("position"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("message").orderBy("position", "url"))).filter(F.col("rank") <= most).select("message", "rank", "url")


_P = {k: v for k, v in urls._parts_sql("url").items()}
_RESERVED = r"^(0|10|127)[.]|^169[.]254[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|^(22[4-9]|2[34][0-9]|25[0-5])[.]"


@R.add(
    rf"""WITH p AS (SELECT page_id % 40 AS message, page_id AS position, url AS own, {", ".join(f"{v} AS {k}" for k, v in _P.items())} FROM
  (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://user:pw@') || '#frag' WHEN 1 THEN 'http://10.1.2.' || CAST(page_id % 200 AS VARCHAR) || '/x' WHEN 2 THEN 'ftp' || substr(url, 5) ELSE url END AS url FROM pages)),
g AS (SELECT message, position, scheme || '://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM p
  WHERE length(own) <= 2048 AND NOT regexp_matches(own, '\s') AND scheme IN ('http', 'https') AND contains(host, '.') AND NOT regexp_matches(host, '[.](localhost|local|internal|lan)$')
  AND NOT (regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') AND regexp_matches(host, '{_RESERVED}')) AND host <> 'example.net' AND NOT ends_with(host, '.example.net')),
f AS (SELECT message, url, min(position) AS position FROM g GROUP BY ALL)
SELECT message, CAST(rank AS INTEGER) AS rank, url FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY position, url) AS rank FROM f) WHERE rank <= 20"""
)
def lookup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    odd = F.when(k % 5 == 0, F.concat(F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.lit("#frag"))).when(k % 5 == 1, F.concat(F.lit("http://10.1.2."), (k % 200).cast("string"), F.lit("/x"))).when(k % 5 == 2, F.concat(F.lit("ftp"), F.expr("substring(url, 5)"))).otherwise(F.col("url"))
    return eligible(src.table(spark, sf_dir, "pages").select((k % 40).alias("message"), k.alias("position"), odd.alias("url")), ("example.net",))


def listed_urls(hits: DataFrame) -> DataFrame:
    """One finding per message and artifact of hits(message, artifact_id, position, status, threat, families): rep.urlhaus."""
    seen = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "families"))), lambda x: F.coalesce(x["families"], F.array().cast("array<string>")))))
    malware = F.bool_or(~F.lower(F.coalesce("threat", F.lit(""))).contains("phish"))
    known = F.bool_or(F.coalesce("status", F.lit("")).isin("online", "offline"))
    rows = hits.groupBy("message", "artifact_id").agg(F.count(F.lit(1)).alias("n_urls"), malware.alias("m"), known.alias("o"), seen.alias("f"))
    return rows.select("message", "artifact_id", F.lit("rep.urlhaus").alias("rule"), F.when(F.col("m"), "malware").otherwise("phishing").alias("category"), F.when(F.col("o"), 85).otherwise(75).alias("score"), F.get("f", F.lit(0)).alias("malware_family"), "n_urls")


@R.add(
    """WITH h AS (SELECT page_id % 60 AS message, CASE WHEN page_id % 3 > 0 THEN 'a' || CAST(page_id % 3 AS VARCHAR) END AS artifact_id, page_id AS position,
  CASE page_id % 7 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'unknown' END AS status, CASE page_id % 4 WHEN 0 THEN 'malware_download' ELSE 'Phishing' END AS threat,
  CASE WHEN page_id % 5 > 1 THEN 'fam' || CAST(page_id % 6 AS VARCHAR) END AS family FROM pages)
SELECT message, artifact_id, 'rep.urlhaus' AS rule, CASE WHEN bool_or(NOT contains(lower(threat), 'phish')) THEN 'malware' ELSE 'phishing' END AS category,
  CASE WHEN bool_or(status IN ('online', 'offline')) THEN 85 ELSE 75 END AS score, arg_min(family, position) FILTER (family IS NOT NULL) AS malware_family, count(*) AS n_urls FROM h GROUP BY message, artifact_id"""
)
def urlhaus_by_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    status = F.when(k % 7 == 0, "online").when(k % 7 == 1, "offline").otherwise("unknown")
    families = F.when(k % 5 > 1, F.array(F.concat(F.lit("fam"), (k % 6).cast("string"))))
    return listed_urls(src.table(spark, sf_dir, "pages").select((k % 60).alias("message"), F.when(k % 3 > 0, F.concat(F.lit("a"), (k % 3).cast("string"))).alias("artifact_id"), k.alias("position"), status.alias("status"), F.when(k % 4 == 0, "malware_download").otherwise("Phishing").alias("threat"), families.alias("families")))


# --- facts of a message -----------------------------------------------------------------------------------------------------------


def root_of(artifact_id: Column) -> Column:
    """The attachment that came with the message itself: ids are paths through their containers."""
    return F.substring_index(artifact_id, "/", 1)


@R.add("SELECT 'm' || CAST(l_orderkey AS VARCHAR) AS root, count(*) AS n, count(DISTINCT l_partkey) AS children FROM lineitem GROUP BY l_orderkey")
def root_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat_ws("/", F.concat(F.lit("m"), F.col("l_orderkey").cast("string")), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = src.table(spark, sf_dir, "lineitem").select(at.alias("id"))
    return rows.groupBy(root_of(F.col("id")).alias("root")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.split("id", "/")[1]).alias("children"))


def best_per_rule(findings: DataFrame) -> DataFrame:
    """Of several findings of one rule in a message that of the best score, the earlier of equal ones."""
    rest = [c for c in findings.columns if c not in ("analysis_id", "rule", "score", "position")]
    best = F.max(F.struct("score", (-F.col("position")).alias("back"), *rest)).alias("b")
    return findings.groupBy("analysis_id", "rule").agg(best).select("analysis_id", "rule", "b.score", (-F.col("b.back")).alias("position"), *[F.col(f"b.{c}").alias(c) for c in rest])


@R.add(_q([FI], "SELECT analysis_id, rule, max(score) AS score, CAST(-(arg_max(-position, (score, -position))) AS INTEGER) AS position, arg_max(severity, (score, -position)) AS severity FROM findings GROUP BY analysis_id, rule"), name="best_per_rule")
def best_per_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per_rule(src.findings(spark, sf_dir).select("analysis_id", "rule", "score", "position", "severity"))


def attachment_facts(findings: DataFrame) -> DataFrame:
    """analysis_id, artifact_id, rank, severity, rule, families: attachments with relevant findings, the worst first.

    The first finding by severity, score and position speaks for an attachment; families come in the same order, each once.
    """
    own = findings.filter("artifact_id is not null and severity > 0").select("analysis_id", "artifact_id", F.struct((-F.col("severity")).alias("s"), (-F.col("score")).alias("v"), "position", "rule", "malware_family").alias("f"))
    rows = own.groupBy("analysis_id", "artifact_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    families = F.array_distinct(F.filter(F.transform("fs", lambda f: f["malware_family"]), lambda f: f.isNotNull()))
    first = F.col("fs")[0]
    rank = F.row_number().over(W.partitionBy("analysis_id").orderBy("first.s", "first.v", "first.position"))
    rows = rows.select("analysis_id", "artifact_id", first.alias("first"), F.array_join(families, ",").alias("families")).withColumn("rank", rank)
    return rows.select("analysis_id", "artifact_id", "rank", (-F.col("first.s")).alias("severity"), F.col("first.rule").alias("rule"), "families")


@R.add(
    _q(
        [
            FI,
            "r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY severity DESC, score DESC, position) AS k FROM findings WHERE artifact_id IS NOT NULL AND severity > 0)",
            "g AS (SELECT analysis_id, artifact_id, min(k) AS k, arg_min(severity, k) AS severity, arg_min(rule, k) AS rule FROM r GROUP BY ALL)",
            "f AS (SELECT analysis_id, artifact_id, malware_family, min(k) AS k FROM r WHERE malware_family IS NOT NULL GROUP BY ALL)",
            "j AS (SELECT analysis_id, artifact_id, string_agg(malware_family, ',' ORDER BY k) AS families FROM f GROUP BY ALL)",
        ],
        "SELECT g.analysis_id, g.artifact_id, CAST(row_number() OVER (PARTITION BY g.analysis_id ORDER BY g.k) AS INTEGER) AS rank, severity, rule, coalesce(families, '') AS families FROM g LEFT JOIN j ON g.analysis_id = j.analysis_id AND g.artifact_id = j.artifact_id",
    ),
    name="attachment_facts",
)
def attachment_facts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachment_facts(src.findings(spark, sf_dir))


def campaign_families(artifacts: DataFrame, results: DataFrame, findings: DataFrame, most: int = 10) -> DataFrame:
    """sha256, families: the families that most mails of each shown campaign name, commonest first, ties by name."""
    top = F.broadcast(campaigns(artifacts, results).select("sha256"))
    held = results.filter(F.col("level").isin(*THREATS) & ~F.col("false_positive")).select(F.col("id").alias("analysis_id"))
    rows = artifacts.select("sha256", "analysis_id").join(top, "sha256", "left_semi").join(held, "analysis_id", "left_semi").distinct()
    named = findings.filter("malware_family is not null").select("analysis_id", F.col("malware_family").alias("family")).distinct()
    counts = rows.join(named, "analysis_id").groupBy("sha256", "family").agg(F.count(F.lit(1)).alias("n"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "family"))), 1, most)
    return counts.groupBy("sha256").agg(listed.alias("l")).select("sha256", F.array_join(F.transform("l", lambda x: x["family"]), ",").alias("families"))


@R.add(
    _q(
        [
            M,
            AR,
            FI,
            "rows AS (SELECT a.sha256, a.analysis_id, m.received_at FROM artifacts a JOIN mails m ON a.analysis_id = m.id WHERE m.level IN ('suspicious', 'malicious') AND NOT m.false_positive)",
            "top AS (SELECT sha256 FROM rows GROUP BY sha256 HAVING count(DISTINCT analysis_id) >= 2 ORDER BY count(DISTINCT analysis_id) DESC, max(received_at) DESC, sha256 LIMIT 50)",
            "n AS (SELECT sha256, malware_family AS family, count(DISTINCT rows.analysis_id) AS n FROM rows JOIN top USING (sha256) JOIN findings f ON f.analysis_id = rows.analysis_id WHERE malware_family IS NOT NULL GROUP BY ALL)",
            "k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY n DESC, family) AS k FROM n)",
        ],
        "SELECT sha256, string_agg(family, ',' ORDER BY k) AS families FROM k WHERE k <= 10 GROUP BY sha256",
    ),
    name="campaign_families",
)
def campaign_families_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_families(src.artifacts(spark, sf_dir), src.mails(spark, sf_dir), src.findings(spark, sf_dir))


# --- scalars ----------------------------------------------------------------------------------------------------------------------


def _pads(key: bytes) -> tuple[str, str]:
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(body: Column, key: bytes) -> Column:
    """The HMAC of a text by SHA-256, in hexadecimal, by its two nested hashes."""
    inner, outer = (F.unhex(F.lit(p)) for p in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


@R.add(f"SELECT doc_id, sha256(unhex('{_pads(b'signing key')[1]}') || unhex(sha256(unhex('{_pads(b'signing key')[0]}') || encode(coalesce(text, ''))))) AS signature FROM documents")
def body_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", hmac_sha256(F.coalesce("text", F.lit("")), b"signing key").alias("signature"))


def _one_place(x: Column) -> Column:
    return F.replace(F.replace(F.format_number(x, 1), F.lit(",")), F.lit("."), F.lit(","))


def shown_bytes(n: Column) -> Column:
    """A size as people read it: bytes, then KB to TB with one decimal, a comma before it."""
    n = F.when(n < 0, 0).otherwise(n).cast("long")
    out = F.concat(_one_place(n / 1024**4), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (k + 1), F.concat(_one_place(n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return F.coalesce(F.when(n == 1, "1 byte").when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(out), F.lit("—"))


def shown_ms(ms: Column) -> Column:
    ms = F.when(ms < 0, 0).otherwise(ms).cast("long")
    return F.coalesce(F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(_one_place(ms / 1000), F.lit(" s"))), F.lit("—"))


def shown_int(n: Column) -> Column:
    return F.coalesce(F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit(".")), F.lit("0"))


@R.add(
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey AS BIGINT) * l_partkey * l_suppkey AS b, CAST(l_suppkey AS BIGINT) * 37 AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b = 1 THEN '1 byte' WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' bytes' WHEN b < 1048576 THEN replace(format('{:.1f}', b / 1024), '.', ',') || ' KB' WHEN b < 1073741824 THEN replace(format('{:.1f}', b / 1048576), '.', ',') || ' MB'
  WHEN b < 1099511627776 THEN replace(format('{:.1f}', b / 1073741824), '.', ',') || ' GB' ELSE replace(format('{:.1f}', b / 1099511627776), '.', ',') || ' TB' END AS bytes,
  CASE WHEN ms < 1000 THEN CAST(ms AS VARCHAR) || ' ms' ELSE replace(format('{:.1f}', ms / 1000), '.', ',') || ' s' END AS took, replace(format('{:,}', b), ',', '.') AS n FROM n"""
)
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("l_partkey").cast("long") * F.col("l_partkey") * F.col("l_suppkey")
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown_bytes(b).alias("bytes"), shown_ms(F.col("l_suppkey").cast("long") * 37).alias("took"), shown_int(b).alias("n"))


def backoff_seconds(attempt: Column, draw: Column, base: float = 1.0, cap: float = 300.0, factor: float = 2.0, jitter: float = 0.2) -> Column:
    """Seconds before a retry: doubled per attempt up to cap, less a part of `jitter` by draw (0 to 1)."""
    return F.least(F.lit(cap), base * F.pow(F.lit(factor), F.least(F.greatest(attempt, F.lit(0)), F.lit(1000)))) * (1 - min(max(jitter, 0.0), 1.0) * draw)


@R.add("SELECT event_id, round(least(300, pow(2, event_id % 12)) * (1 - 0.2 * (event_id % 10) / 10.0), 6) AS seconds FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").select("event_id", F.round(backoff_seconds(F.col("event_id") % 12, F.col("event_id") % 10 / 10), 6).alias("seconds"))


def string_list(json: Column) -> Column:
    """A stored JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def instant(value: Column) -> Column:
    """A time from epoch milliseconds or ISO text; null if it is neither."""
    return F.when(value.rlike(r"^-?[0-9]{1,17}$"), F.timestamp_millis(value.try_cast("long"))).otherwise(value.try_cast("timestamp"))
