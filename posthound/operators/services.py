"""Services that attackers use like anyone else: a table of hosts with path prefixes, joined by the longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.functions import urls
from posthound.operators.scripts import COLLECTING
from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()

#: Public services by what a link into them usually carries (host, path prefix): our own table, a deployment passes a larger one.
SHARING = {
    "file_share": (
        ("drive.google.com", "/file"), ("drive.google.com", "/uc"), ("dropbox.com", "/s"), ("dropbox.com", "/scl"), ("1drv.ms", ""), ("onedrive.live.com", "/download"), ("mega.nz", "/file"), ("mediafire.com", "/file"),
        ("wetransfer.com", "/downloads"), ("we.tl", ""), ("box.com", "/s"), ("pcloud.link", ""), ("gofile.io", "/d"), ("anonfiles.com", ""), ("send.cm", ""), ("filetransfer.io", ""), ("catbox.moe", ""), ("pixeldrain.com", "/u"),
        ("cdn.discordapp.com", "/attachments"), ("archive.org", "/download"), ("sendspace.com", "/file"), ("zippyshare.com", "/v"), ("uploadfiles.io", ""), ("fromsmash.com", ""),
    ),
    "code_host": (
        ("raw.githubusercontent.com", ""), ("gist.githubusercontent.com", ""), ("github.com", "/releases/download"), ("gitlab.com", "/-/raw"), ("bitbucket.org", "/downloads"), ("pastebin.com", "/raw"), ("paste.ee", "/r"), ("hastebin.com", "/raw"), ("rentry.co", ""),
    ),
    "page_builder": (
        ("forms.gle", ""), ("forms.office.com", ""), ("sites.google.com", "/view"), ("docs.google.com", "/presentation"), ("docs.google.com", "/document"), ("canva.com", "/design"), ("notion.site", ""), ("webflow.io", ""), ("wixsite.com", ""), ("weebly.com", ""),
        ("github.io", ""), ("pages.dev", ""), ("workers.dev", ""), ("netlify.app", ""), ("vercel.app", ""), ("web.app", ""), ("firebaseapp.com", ""), ("blob.core.windows.net", ""), ("storage.googleapis.com", ""), ("s3.amazonaws.com", ""), ("typeform.com", "/to"), ("jotform.com", ""),
    ),
}
SCORES = {"file_share": 20, "code_host": 20, "page_builder": 25, "collector": 30}


def own_table(spark: SparkSession) -> DataFrame:
    """host, prefix, kind, score of the services above and of those that collect what a page posts."""
    rows = [(h, p, kind) for kind, places in SHARING.items() for h, p in places] + [(h, p, "collector") for h, p in COLLECTING]
    return spark.createDataFrame([(h, p, k, SCORES[k]) for h, p, k in rows], "host string, prefix string, kind string, score int")


def prefixes(path: Column) -> Column:
    """The path cut before each of its slashes, the whole path, and the empty prefix."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    runs = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/"))))
    return F.array_distinct(runs)


def service_of(rows: DataFrame, services: DataFrame, key: str, url: str) -> DataFrame:
    """key, url, host, prefix, kind, score: the service that each URL leads into; URLs without one are left out.

    services(host, prefix, kind, score) fits its host and all subdomains, if the URL's path is its prefix or goes on below it. The
    longest host wins, then the longest prefix, then the kind that sorts first. Any number of services: both ways of being
    longer are keys of one equi-join, which takes all of a URL's host suffixes with all of its path prefixes.
    """
    parts = urls.parts(F.col(url))
    each = rows.select(key, url, parts["host"].alias("_host"), parts["path"].alias("_path")).filter("_host <> ''")
    each = each.withColumn("host", F.explode(urls.suffix_keys(F.col("_host")))).withColumn("prefix", F.explode(prefixes(F.col("_path"))))
    fits = each.join(services.select(F.lower("host").alias("host"), F.regexp_replace("prefix", "/+$", "").alias("prefix"), "kind", "score"), ["host", "prefix"])
    best = F.min_by(F.struct("host", "prefix", "kind", "score"), F.struct(-F.length("host"), -F.length("prefix"), F.col("kind"), F.col("score")))
    return fits.groupBy(key, url).agg(best.alias("b")).select(key, url, "b.*")


def service_findings(rows: DataFrame, services: DataFrame, key: str, url: str) -> DataFrame:
    """key, url, rule, severity, score: `url.abused_service` for links into a service of the table."""
    found = service_of(rows, services, key, url)
    return found.select(key, url, F.lit("url.abused_service").alias("rule"), F.lit(1).alias("severity"), "score")


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table above and, as if they were services, every page's domain, its hosts' own folders and two levels of some."""
    p = urls.parts(F.col("url"))
    pages = src.table(spark, sf_dir, "pages").select(p["host"].alias("h"), F.split(p["path"], "/").alias("s"))
    domain = pages.select(urls.registrable(F.col("h")).alias("host"), F.lit("").alias("prefix"), F.lit("domain").alias("kind"), F.lit(1).alias("score"))
    folder = pages.select(F.col("h").alias("host"), F.concat(F.lit("/"), F.get("s", F.lit(1))).alias("prefix"), F.lit("folder").alias("kind"), F.lit(2).alias("score"))
    deep = pages.filter(F.length("h") % 3 == 0).select(urls.registrable(F.col("h")).alias("host"), F.concat(F.lit("/"), F.get("s", F.lit(1)), F.lit("/"), F.get("s", F.lit(2))).alias("prefix"), F.lit("deep").alias("kind"), F.lit(3).alias("score"))
    return own_table(spark).unionByName(domain.unionByName(folder).unionByName(deep).filter("prefix is not null").distinct())


_P = urls._parts_sql("url")


@R.add(
    f"""WITH p AS (SELECT page_id, url, {_P['host']} AS h, {_P['path']} AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS s, regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS d FROM p),
t AS (SELECT DISTINCT d AS host, '' AS prefix, 'domain' AS kind, 1 AS score FROM s UNION SELECT h, rtrim('/' || s[2], '/'), 'folder', 2 FROM s WHERE s[2] IS NOT NULL
  UNION SELECT d, rtrim('/' || s[2] || '/' || s[3], '/'), 'deep', 3 FROM s WHERE length(h) % 3 = 0 AND s[2] IS NOT NULL AND s[3] IS NOT NULL),
j AS (SELECT page_id, url, host, prefix, kind, score, row_number() OVER (PARTITION BY page_id, url ORDER BY length(host) DESC, length(prefix) DESC, kind, score) AS k
  FROM s JOIN t ON (s.h = t.host OR ends_with(s.h, '.' || t.host)) AND (t.prefix = '' OR rtrim(s.path, '/') = t.prefix OR starts_with(s.path, t.prefix || '/')))
SELECT page_id, url, host, prefix, kind, CAST(score AS INTEGER) AS score FROM j WHERE k = 1"""
)
def url_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest service of every page's URL; none of the pages lies under a host of the fixed table."""
    return service_of(src.table(spark, sf_dir, "pages"), _services(spark, sf_dir), "page_id", "url")
