"""URLs as Column expressions: parts, normalising, unwrapping, extraction from text, and rules on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()

#: Small dimension tables of our own; a deployment passes larger ones.
SUFFIXES = ("com", "net", "org", "io", "example", "com.ar", "co.uk", "com.br")
SHORTENERS = ("short.example", "lnk.example", "tny.example")
FREE_HOSTS = ("example.org", "pages.example", "sites.example")
RISKY_EXTENSIONS = ("exe", "scr", "js", "vbs", "hta", "lnk", "iso", "bat", "msi", "jar")
DANGEROUS_SCHEMES = ("javascript", "vbscript", "data", "file", "ms-msdt", "search-ms")
SAFE_PORTS = {"http": ("80", "8080"), "https": ("443", "8443")}


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parts(url: Column) -> dict[str, Column]:
    """scheme, userinfo, host, port, path, query, fragment as lower-level pieces; absent ones are empty."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    return {
        "scheme": scheme,
        "userinfo": F.regexp_extract(authority, r"^(.*)@", 1),
        "host": F.lower(F.regexp_extract(host_port, r"^([^:]*)", 1)),
        "port": F.regexp_extract(host_port, r":([0-9]+)$", 1),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(url, r"#(.*)$", 1),
    }


def _parts_sql(u: str) -> dict[str, str]:
    s = "[A-Za-z][A-Za-z0-9+.-]*"
    authority = f"regexp_extract({u}, '^{s}://([^/?#]*)', 1)"
    host_port = f"regexp_replace({authority}, '^.*@', '')"
    return {
        "scheme": f"lower(regexp_extract({u}, '^({s}):', 1))",
        "userinfo": f"regexp_extract({authority}, '^(.*)@', 1)",
        "host": f"lower(regexp_extract({host_port}, '^([^:]*)', 1))",
        "port": f"regexp_extract({host_port}, ':([0-9]+)$', 1)",
        "path": f"regexp_extract({u}, '^{s}://[^/?#]*([^?#]*)', 1)",
        "query": f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)",
        "fragment": f"regexp_extract({u}, '#(.*)$', 1)",
    }


def normalise(url: Column) -> Column:
    """A clickable form: shares to file:, `//` to https:, `www.` to http:, backslashes to slashes, scheme and host in small letters."""
    def clickable(url: Column) -> Column:
        return F.when(url.rlike(r"^\\\\[^\\]"), F.concat(F.lit("file:"), F.replace(url, F.lit("\\"), F.lit("/")))).when(url.rlike(r"^[A-Za-z]:\\"), F.concat(F.lit("file:///"), F.replace(url, F.lit("\\"), F.lit("/")))).when(
            url.startswith("//"), F.concat(F.lit("https:"), url)
        ).when(url.rlike(r"(?i)^www\."), F.concat(F.lit("http://"), url)).otherwise(url)

    def split(url: Column) -> Column:
        return once(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}[^/\\?#]*)", 1), lambda head: slashed(head, url.substr(F.length(head) + 1, F.length(url)), url))

    def slashed(head: Column, rest: Column, url: Column) -> Column:
        return F.when(head != "", F.concat(F.lower(F.replace(head, F.lit("\\"), F.lit("/"))), F.replace(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1))).otherwise(url)

    return once(once(F.trim(url), clickable), split)


URL_IN_TEXT = r"(?i)\b((?:https?|ftp)://[^\s<>\"'`{}|\\^]+|www\.[A-Za-z0-9-]+\.[^\s<>\"'`{}|\\^]+)"


def in_text(text: Column, most: int = 1000) -> Column:
    """Distinct URLs of a text in order, without trailing punctuation and unbalanced closing brackets."""

    def trimmed(u: Column) -> Column:
        u = F.regexp_replace(u, r"[.,;:!?'\"]+$", "")
        return F.when(u.endswith(")") & ~u.contains("("), F.regexp_replace(u, r"[)\].,;:!?]+$", "")).otherwise(u)

    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(URL_IN_TEXT), 1), trimmed)), 1, most)


def unwrap(url: Column, hops: int = 3) -> Column:
    """The target of a rewritten link: the first of the parameters url, u, q, target that holds an address."""
    def hop(url: Column) -> Column:
        inner = F.regexp_extract(url, r"(?i)[?&](?:url|u|q|target)=(https?(?:%3a|:)[^&#]+)", 1)
        return once(inner, lambda x: F.when(x != "", F.coalesce(F.try_url_decode(x), url)).otherwise(url))

    for _ in range(hops):
        url = once(url, hop)
    return url


def registrable(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest known public suffix with one label more; the last two labels of other hosts."""
    labels = F.split(host, r"\.")
    out = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        n = s.count(".") + 2
        out = F.when(host.endswith("." + s) & (F.size(labels) >= n), F.array_join(F.slice(labels, -n, n), ".")).otherwise(out)
    return out


def suffix_keys(host: Column) -> Column:
    """All dot-suffixes of a host, so that "equals or ends in" becomes an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules(p: dict[str, Column]) -> list[Column]:
    """Findings of one URL: struct(rule, severity, score) or null for each rule."""
    found = lambda cond, rule, severity, score: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(score).alias("score")))
    labels = F.split(p["host"], r"\.")
    extension = F.lower(F.regexp_extract(p["path"], r"\.([A-Za-z0-9]{1,5})$", 1))
    odd_port = (p["port"] != "") & ~((p["scheme"] == "http") & p["port"].isin(*SAFE_PORTS["http"])) & ~((p["scheme"] == "https") & p["port"].isin(*SAFE_PORTS["https"]))
    return [
        found(p["scheme"].isin(*DANGEROUS_SCHEMES), "url.dangerous_scheme", 3, 75),
        found(p["userinfo"] != "", "url.userinfo_trick", 3, 70),
        found(p["host"].rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "url.ip_literal", 2, 35),
        found(extension.isin(*RISKY_EXTENSIONS), "url.risky_download", 2, 45),
        found(registrable(p["host"]).isin(*FREE_HOSTS), "url.free_hosting", 1, 15),
        found(p["host"].isin(*SHORTENERS), "url.shortener", 1, 10),
        found((F.length(p["host"]) > 75) | (F.size(labels) - 2 >= 5) | (F.length(p["host"]) - F.length(F.replace(p["host"], F.lit("-"), F.lit(""))) >= 4), "url.long_hostname", 1, 10),
        found(odd_port, "url.nonstandard_port", 2, 20),
    ]


def findings(urls: DataFrame, key: str, url: str) -> DataFrame:
    """key, url, rule, severity, score: a row per URL and rule that fires."""
    rows = urls.withColumns({f"_{k}": v for k, v in parts(F.col(url)).items()})
    p = {k: F.col(f"_{k}") for k in ("scheme", "userinfo", "host", "port", "path", "query", "fragment")}
    hits = F.filter(F.array(*rules(p)), lambda x: x.isNotNull())
    return rows.select(key, url, F.explode(hits).alias("f")).select(key, url, "f.rule", "f.severity", "f.score")


def grouped(found: DataFrame, key: str, most_urls: int = 5) -> DataFrame:
    """Findings of one rule as one: the best score and the first URLs in order."""
    urls = F.slice(F.array_sort(F.collect_set("url")), 1, most_urls)
    return found.groupBy(key, "rule").agg(F.max("score").alias("score"), F.max("severity").alias("severity"), F.count_distinct("url").alias("n_urls"), F.array_join(urls, " ").alias("urls"))


_PAGES = ", ".join(f"{v} AS {k}" for k, v in _parts_sql("url").items())


@R.add(f"SELECT page_id, {_PAGES} FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in parts(F.col("url")).items()])


#: Odd forms besides the pages' own URLs, each a prefix of a page's host.
_ODD = (("//{}/a\\b", "https://{}/a/b"), ("www.{}/x?y=\\z", "http://www.{}/x?y=\\z"), ("\\\\{}\\share", "file://{}/share"), ("HTTP:\\\\{}\\p", "http://{}/p"))


@R.add(
    "WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages) "
    + " UNION ALL ".join(f"SELECT page_id, {i} AS form, '{b.split('{}')[0]}' || h || '{b.split('{}')[1]}' AS url FROM h" for i, (a, b) in enumerate(_ODD))
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    forms = F.array(*[F.struct(F.lit(i).alias("form"), F.concat(F.lit(a.split("{}")[0]), host, F.lit(a.split("{}")[1])).alias("raw")) for i, (a, _) in enumerate(_ODD)])
    return src.table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("f")).select("page_id", "f.form", normalise(F.col("f.raw")).alias("url"))


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_P = _parts_sql("url")
_RULES_SQL = f"""p AS (SELECT page_id, url, {_PAGES} FROM pages),
hits AS (
  SELECT page_id, url, 'url.dangerous_scheme' AS rule, 3 AS severity, 75 AS score FROM p WHERE scheme IN {_IN(DANGEROUS_SCHEMES)}
  UNION ALL SELECT page_id, url, 'url.userinfo_trick', 3, 70 FROM p WHERE userinfo <> ''
  UNION ALL SELECT page_id, url, 'url.ip_literal', 2, 35 FROM p WHERE regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$')
  UNION ALL SELECT page_id, url, 'url.risky_download', 2, 45 FROM p WHERE lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,5}})$', 1)) IN {_IN(RISKY_EXTENSIONS)}
  UNION ALL SELECT page_id, url, 'url.free_hosting', 1, 15 FROM p WHERE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) IN {_IN(FREE_HOSTS)}
  UNION ALL SELECT page_id, url, 'url.shortener', 1, 10 FROM p WHERE host IN {_IN(SHORTENERS)}
  UNION ALL SELECT page_id, url, 'url.long_hostname', 1, 10 FROM p WHERE length(host) > 75 OR len(string_split(host, '.')) - 2 >= 5 OR length(host) - length(replace(host, '-', '')) >= 4
  UNION ALL SELECT page_id, url, 'url.nonstandard_port', 2, 20 FROM p WHERE port <> '' AND NOT (scheme = 'http' AND port IN ('80', '8080')) AND NOT (scheme = 'https' AND port IN ('443', '8443')))"""


@R.add(f"WITH {_RULES_SQL} SELECT page_id, url, rule, severity, score FROM hits")
def url_rules_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(src.table(spark, sf_dir, "pages"), "page_id", "url")


@R.add(f"WITH {_RULES_SQL}, b AS (SELECT page_id % 10 AS bucket, * FROM hits) SELECT bucket, rule, max(score) AS score, max(severity) AS severity, count(DISTINCT url) AS n_urls, array_to_string(list_slice(list_sort(list(DISTINCT url)), 1, 5), ' ') AS urls FROM b GROUP BY bucket, rule")
def url_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.table(spark, sf_dir, "pages").withColumn("bucket", F.col("page_id") % 10)
    return grouped(findings(pages, "bucket", "url"), "bucket")


_SUFFIX_DIM = (("example.com", "big"), ("blog.example.com", "never"), ("example.org", "free"), ("net", "tld"))


@R.add(
    f"WITH d(suffix, tag) AS (VALUES {', '.join(map(str, _SUFFIX_DIM))}), p AS (SELECT page_id, {_P['host']} AS host FROM pages) SELECT page_id, host, suffix, tag FROM p JOIN d ON p.host = d.suffix OR p.host LIKE '%.' || d.suffix"
)
def url_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(list(_SUFFIX_DIM), "suffix string, tag string")
    rows = src.table(spark, sf_dir, "pages").select("page_id", parts(F.col("url"))["host"].alias("host"))
    return rows.withColumn("suffix", F.explode(suffix_keys(F.col("host")))).join(F.broadcast(dim), "suffix").select("page_id", "host", "suffix", "tag")


@R.add(f"SELECT regexp_extract({_P['host']}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").groupBy(registrable(parts(F.col("url"))["host"]).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@R.add()
def url_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", F.explode(in_text(F.concat(F.lit("see ("), F.col("url"), F.lit("), then www.a.example/b.")))).alias("url"))
