"""Rules that come as rows: byte patterns of families, and brands with the names and domains that are theirs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from posthound.functions import urls
from posthound.operators import deception
from posthound.operators.messages import FREEMAIL, domain_of
from posthound.plans.registry import Registry
from posthound.session import written
from posthound.sources import adapters as src

R = Registry()

# --- pattern rules from a table --------------------------------------------------------------------------------------------------

RULE_COLUMNS = "rule string, family string, score int, need int, kinds array<string>, most long, patterns array<string>"
#: More rules than these are an error: each becomes an expression of the plan.
MOST_RULES = 2000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all JSON files under a folder, one object a line; the last file by name counts where a rule comes twice.

    `need` patterns of a rule must be found (null: one). `kinds` are the beginnings of the types it applies to (null: all),
    `most` the largest size in bytes (null: any). Rules without a name or a pattern are left out.
    """
    rows = spark.read.schema(RULE_COLUMNS).json(path).withColumn("file", F.col("_metadata.file_name"))
    rest = [c.split(" ")[0] for c in RULE_COLUMNS.split(", ")[1:]]
    rows = rows.filter("rule is not null and size(patterns) > 0")
    return rows.groupBy("rule").agg(F.max(F.struct("file", *rest)).alias("r")).select("rule", *[f"r.{c}" for c in rest])


def rule_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, line, problem: what `read_rules` leaves out, so that no rule is lost unseen: lines that are no rule as JSON, rules
    without a name or a pattern, and those that a later file replaces."""
    schema = f"{RULE_COLUMNS}, _corrupt_record string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rest = [c.split(" ")[0] for c in RULE_COLUMNS.split(", ")]
    rows = written(rows.select("*", F.col("_metadata.file_name").alias("file")), "rule-lines")
    bad = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("rule").isNull(), "no name").when(~F.coalesce(F.size("patterns") > 0, F.lit(False)), "no pattern")
    told = rows.select("file", "rule", F.coalesce("_corrupt_record", F.to_json(F.struct(*rest))).alias("line"), bad.alias("problem"))
    last = told.filter("problem is null").groupBy("rule").agg(F.max("file").alias("last"))
    replaced = told.filter("problem is null").join(last, "rule").filter("file < last").select("file", "line", F.concat(F.lit("replaced by "), "last").alias("problem"))
    return told.filter("problem is not null").select("file", "line", "problem").unionByName(replaced)


def bounded_rules(rules: DataFrame, most: int = MOST_RULES) -> list[Row]:
    """The rules by name; more than `most` are an error."""
    held = rules.orderBy("rule").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rules")
    return held


def scan(rows: DataFrame, rules: Sequence[Row], key: str = "id", data: str = "data", kind: str | None = None, prefix: str = "yara") -> DataFrame:
    """key, rule, family, score of each rule that fits rows(key, data binary or string, kind).

    Patterns are lower-case regular expressions over bytes, one character a byte. Each is sought in the lower-cased bytes and in
    those without zeros, as which UTF-16 text of ASCII letters reads. Null data fits no rule.
    """
    raw = F.decode(F.col(data).cast("binary"), "ISO-8859-1")
    found = rows.select(key, (F.col(kind) if kind else F.lit("")).alias("kind"), F.length(F.col(data).cast("binary")).alias("size"), F.lower(raw).alias("text"))
    found = found.filter("text is not null").withColumn("wide", F.when(F.instr("text", "\0") > 0, F.translate("text", "\0", "")))
    hits = []
    for r in rules:
        seen = [(F.col("text").rlike(p) | F.coalesce(F.col("wide").rlike(p), F.lit(False))).cast("int") for p in r["patterns"]]
        fits = sum(seen[1:], seen[0]) >= (r["need"] or 1)
        if r["most"] is not None:
            fits = (F.col("size") <= r["most"]) & fits
        if r["kinds"]:
            ours = F.lit(False)
            for k in r["kinds"]:
                ours = ours | F.coalesce(F.col("kind"), F.lit("")).startswith(k)
            fits = ours & fits
        hits.append(F.when(fits, F.struct(F.lit(f"{prefix}.{r['rule']}").alias("rule"), F.lit(r["family"]).cast("string").alias("family"), F.lit(r["score"] or 0).alias("score"))))
    hits = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<struct<rule: string, family: string, score: int>>")
    return found.select(key, F.explode(hits).alias("f")).select(key, "f.*")


# --- brands -----------------------------------------------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named_brands(heads: DataFrame, brands: DataFrame, longest: int = 4) -> DataFrame:
    """id, brand: the brands that the shown name of heads(id, from_addr, from_display) claims from a domain that is not theirs.

    brands(brand, phrases array<string>, domains array<string>). A phrase of up to `longest` words fits whole words in order.
    Runs of words are joined with phrases, so any number of brands will do.
    """
    words = _words(F.col("from_display"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    runs = F.when(F.size(words) > 0, F.array_distinct(runs))
    said = heads.select("id", domain_of(F.col("from_addr")).alias("sender"), F.explode(runs).alias("phrase"))
    known = brands.select("brand", F.explode("phrases").alias("p")).select("brand", F.array_join(_words(F.col("p")), " ").alias("phrase")).filter("phrase <> ''").distinct()
    claimed = said.join(known, "phrase").select("id", "sender", "brand").distinct()
    own = brands.select("brand", F.explode("domains").alias("domain")).select("brand", F.lower("domain").alias("domain")).distinct()
    theirs = claimed.select("id", "brand", F.explode(urls.suffix_keys(F.col("sender"))).alias("domain")).join(own, ["brand", "domain"]).select("id", "brand").distinct()
    return claimed.select("id", "brand").join(theirs, ["id", "brand"], "left_anti")


def brand_findings(heads: DataFrame, brands: DataFrame, company_names: tuple[str, ...] = (), company: tuple[str, ...] = ()) -> DataFrame:
    """id, rule, severity, score, category of heads(id, from_addr, from_display, reply_to): names and domains of others.

    A shown brand (60 from free mail, else 45), a shown name of the company from outside (60 or 40), and a sender's or answer
    address's domain that imitates a brand's (65).
    """
    spark = heads.sparkSession
    sender = domain_of(F.col("from_addr"))
    free = heads.select("id", sender.isin(*FREEMAIL).alias("free"))
    shown = named_brands(heads, brands).select("id").distinct().select("id", F.lit("headers.display_name_brand").alias("rule"), F.lit(45).alias("else"))
    if company_names:
        us = spark.createDataFrame([("company", list(company_names), list(company))], "brand string, phrases array<string>, domains array<string>")
        shown = shown.unionByName(named_brands(heads, us).select("id", F.lit("headers.display_name_company").alias("rule"), F.lit(40).alias("else")))
    score = F.when(F.col("free"), 60).otherwise(F.col("else"))
    shown = shown.join(free, "id").select("id", "rule", score.alias("score"))
    hosts = heads.select("id", F.explode(F.array_distinct(F.array(sender, domain_of(F.col("reply_to"))))).alias("host")).filter("host <> ''")
    like = deception.imitations(hosts, brands.select(F.explode("domains").alias("target")).select(F.lower("target").alias("target")))
    like = hosts.join(like.select("host"), "host").select("id").distinct().select("id", F.lit("headers.lookalike_brand").alias("rule"), F.lit(65).alias("score"))
    return shown.unionByName(like).select("id", "rule", F.when(F.col("score") >= 60, 3).otherwise(2).alias("severity"), "score", F.lit("spoofing").alias("category"))


def imitating_urls(seen: DataFrame, brands: DataFrame, company: tuple[str, ...] = (), key: str = "mail") -> DataFrame:
    """key, url, rule, score of seen(key, url): hosts that imitate the company, else those that imitate a brand.

    70, or 65 where the imitated domain is only a part of a longer host. Hosts of the company's or the brand's own do neither.
    """
    rows = seen.select(key, "url", F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1).alias("host")).filter("host <> ''")
    hosts = rows.select("host").distinct()
    spark = seen.sparkSession
    ours = spark.createDataFrame([(d.lower(),) for d in company], "target string")
    first = deception.imitations(hosts, ours).select("host", "kind", F.lit("url.lookalike_domain").alias("rule"))
    known = hosts.select("host", F.explode(urls.suffix_keys(F.col("host"))).alias("target")).join(ours, "target").select("host")
    rest = hosts.join(first.select("host").union(known).distinct(), "host", "left_anti")
    then = deception.imitations(rest, brands.select(F.explode("domains").alias("target")).select(F.lower("target").alias("target"))).select("host", "kind", F.lit("url.lookalike_brand").alias("rule"))
    return rows.join(first.unionByName(then), "host").select(key, "url", "rule", F.when(F.col("kind") == "subdomain", 65).otherwise(70).alias("score"))


def known_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a brand of its name and one domain."""
    name = F.col("n_name")
    return src.table(spark, sf_dir, "nation").select(name.alias("brand"), F.array(F.concat(F.lit("The "), name), name).alias("phrases"), F.array(F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit(".example"))).alias("domains"))


# --- queries ----------------------------------------------------------------------------------------------------------------------

_RULES = (
    ("tracked_page", "Tracker", 40, 2, None, None, ["track\\(", "<script"]),
    ("spanish_page", None, 5, 1, ["text/html"], None, ['lang="es"']),
    ("short_page", None, 1, 1, None, 4000, ["<article>"]),
    ("never", "None", 95, 3, None, None, ["<html", "<body"]),
    ("pictures_only", None, 10, 1, ["image/"], None, ["<html"]),
)


@R.add(
    """WITH p AS (SELECT page_id, lower(html) AS t, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL)
SELECT page_id, 'yara.tracked_page' AS rule, 'Tracker' AS family, 40 AS score FROM p WHERE contains(t, 'track(') AND contains(t, '<script')
UNION ALL SELECT page_id, 'yara.spanish_page', NULL, 5 FROM p WHERE contains(t, 'lang="es"')
UNION ALL SELECT page_id, 'yara.short_page', NULL, 1 FROM p WHERE contains(t, '<article>') AND n <= 4000"""
)
def rule_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(_RULES), RULE_COLUMNS)
    pages = src.table(spark, sf_dir, "pages").select("page_id", "html", F.lit("text/html").alias("kind"))
    return scan(pages, bounded_rules(rules), "page_id", "html", "kind")


@R.add(
    """WITH h AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) || ' - Support' WHEN 1 THEN 'Team of the ' || n_name WHEN 2 THEN n_name || 'x' END AS shown, n_name,
  CASE c_custkey % 3 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'mail.' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || '.example' ELSE 'other.example' END AS sender FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, ' ' || trim(regexp_replace(lower(coalesce(shown, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS padded FROM h)
SELECT DISTINCT w.id, b.n_name AS brand FROM w JOIN nation b ON contains(w.padded, ' ' || trim(regexp_replace(lower(b.n_name), '[^a-z0-9]+', ' ', 'g')) || ' ')
WHERE NOT ends_with('.' || w.sender, '.' || lower(regexp_replace(b.n_name, '[^A-Za-z0-9]', '', 'g')) || '.example')"""
)
def shown_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("n_name")
    shown = F.when(k % 4 == 0, F.concat(F.lower(name), F.lit(" - Support"))).when(k % 4 == 1, F.concat(F.lit("Team of the "), name)).when(k % 4 == 2, F.concat(name, F.lit("x")))
    own = F.concat(F.lit("a@mail."), F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit(".example"))
    sender = F.when(k % 3 == 0, "a@gmail.com").when(k % 3 == 1, own).otherwise("a@other.example")
    rows = src.table(spark, sf_dir, "customer").join(src.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named_brands(rows.select(k.alias("id"), sender.alias("from_addr"), shown.alias("from_display")), known_brands(spark, sf_dir))
