"""URL findings told once per rule and place, with what was seen first as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.functions import urls
from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()


def told_once(found: DataFrame, key: str, most_domains: int = 20, most_urls: int = 5) -> DataFrame:
    """key, artifact, rule, score, severity, best_url, n_domains, n_urls, domains, urls of found(key, artifact, position, url, domain, rule, severity, score).

    One row per rule and artifact (null: the message itself): the best score and the first URL that has it, all domains and URLs
    counted, the first of each listed in the order of their first position. Repeats become one row before they are ranked, and
    only what is listed is gathered, so that a rule which fires on very many URLs of one place stays bounded.
    """
    place = [key, "artifact", "rule"]
    found = found.withColumn("artifact", F.coalesce("artifact", F.lit("\0")))
    per_url = found.groupBy(*place, "url").agg(F.min("position").alias("position"), F.min_by("domain", "position").alias("domain"), F.max(F.struct("score", "severity", (-F.col("position")).alias("p"))).alias("b"))

    def listed(what: str, most: int) -> DataFrame:
        first = per_url.filter(F.col(what) != "").groupBy(*place, what).agg(F.min("position").alias("position"))
        ranked = first.withColumn("k", F.row_number().over(W.partitionBy(*place).orderBy("position", what))).filter(F.col("k") <= most)
        return ranked.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", what))), lambda x: x[what]).alias(f"{what}s"))

    best = per_url.groupBy(*place).agg(F.max(F.struct("b.score", "b.severity", F.col("b.p").alias("p"), "url")).alias("best"), F.count(F.lit(1)).alias("n_urls"), F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("n_domains"))
    out = best.join(listed("domain", most_domains), place, "left").join(listed("url", most_urls), place, "left")
    none = F.array().cast("array<string>")
    return out.select(key, F.nullif("artifact", F.lit("\0")).alias("artifact"), "rule", "best.score", "best.severity", F.col("best.url").alias("best_url"), "n_domains", "n_urls", F.coalesce("domains", none).alias("domains"), F.coalesce("urls", none).alias("urls"))


@R.add(
    f"""WITH {urls._RULES_SQL}, f AS (SELECT page_id % 4 AS mail, CASE WHEN page_id % 3 > 0 THEN 'a' || CAST(page_id % 3 AS VARCHAR) END AS artifact, page_id AS position, url, regexp_extract(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '([^.]+[.][^.]+)$', 1) AS domain, rule, severity, score FROM hits),
u AS (SELECT mail, artifact, rule, url, min(position) AS position, arg_min(domain, position) AS domain, max(score) AS score, max(severity) AS severity FROM f GROUP BY ALL),
d AS (SELECT mail, artifact, rule, domain, min(position) AS position FROM u GROUP BY ALL), dl AS (SELECT mail, artifact, rule, count(*) AS n_domains, (list(domain ORDER BY position, domain))[1:3] AS domains FROM d GROUP BY ALL),
ul AS (SELECT mail, artifact, rule, count(*) AS n_urls, max(score) AS score, max(severity) AS severity, (list(url ORDER BY score DESC, position))[1] AS best_url, (list(url ORDER BY position, url))[1:5] AS urls FROM u GROUP BY ALL)
SELECT ul.mail, ul.artifact, ul.rule, score, severity, best_url, n_domains, n_urls, array_to_string(domains, ' ') AS domains, array_to_string(urls, ' ') AS urls FROM ul JOIN dl ON ul.mail = dl.mail AND ul.artifact IS NOT DISTINCT FROM dl.artifact AND ul.rule = dl.rule"""
)
def url_rules_told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as links of four mails and their two attachments; three domains are listed."""
    k = F.col("page_id")
    pages = src.table(spark, sf_dir, "pages").select(k, "url")
    found = urls.findings(pages, "page_id", "url").withColumn("domain", urls.registrable(urls.parts(F.col("url"))["host"]))
    rows = found.select((k % 4).alias("mail"), F.when(k % 3 > 0, F.concat(F.lit("a"), (k % 3).cast("string"))).alias("artifact"), k.alias("position"), "url", "domain", "rule", "severity", "score")
    return told_once(rows, "mail", most_domains=3).withColumns({"domains": F.array_join("domains", " "), "urls": F.array_join("urls", " ")})
