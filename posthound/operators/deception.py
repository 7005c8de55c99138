"""Links that show one place and lead to another, addresses inside addresses, and hosts that imitate known domains, by equi-joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthound.functions import urls
from posthound.operators.lookalike import AFFIXES, CONFUSABLE, osa_distance, skeleton
from posthound.plans.registry import Registry
from posthound.session import written
from posthound.sources import adapters as src

R = Registry()

def embedded(url: Column, most: int = 2) -> Column:
    """Whole http(s) addresses among the values of a URL's parameters."""
    values = F.transform(F.split(urls.parts(url)["query"], "&"), lambda p: F.trim(F.coalesce(F.try_url_decode(F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + F.lit(1), F.length(p))).otherwise("")), F.lit(""))))
    return F.slice(F.filter(values, lambda v: v.rlike(r"(?i)^https?://")), 1, most)


@R.add(
    """SELECT page_id, array_to_string(list_slice(list_filter([CASE WHEN page_id % 2 = 0 THEN 'https://inner.example/' || CAST(page_id AS VARCHAR) ELSE 'plain' END, url, 'http://third.example/'], lambda v: regexp_matches(v, '^https?://')), 1, 2), ' ') AS inner_urls FROM pages"""
)
def url_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https%3A%2F%2Finner.example%2F"), F.col("page_id").cast("string"))).otherwise("plain")
    outer = F.concat(F.lit("https://r.example/go?a="), first, F.lit("&b="), F.url_encode("url"), F.lit("&c=http://third.example/#x"))
    return src.table(spark, sf_dir, "pages").select("page_id", F.array_join(embedded(outer), " ").alias("inner_urls"))


def bare_domain(suffixes: tuple[str, ...] = urls.SUFFIXES) -> str:
    """Pattern of a domain under a known public suffix, or an IPv4 address, that stands by itself in a text: no part of a mail address, a path or a longer name."""
    label = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
    ends = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-s.count("."), s)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}@._/:\\-])((?:{label}\.)+(?:{ends})|(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})(?![\p{{L}}\p{{N}}@-]|\.[\p{{L}}\p{{N}}])"


def shown_domain(text: Column) -> Column:
    """The host that a link's visible text shows: that of its first web address, else its first domain under a known suffix; null without one."""
    web = F.filter(urls.in_text(text), lambda u: u.rlike("(?i)^(http|www)"))
    address = urls.parts(urls.normalise(F.get(web, F.lit(0))))["host"]
    domain = F.lower(F.regexp_extract(text, bare_domain(), 1))
    return F.coalesce(F.when(address != "", address), F.when(domain != "", domain))


def deceptive_links(links: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """url.deceptive_link findings of links(key, url, shown): the text promises a domain that is neither the link's own nor its
    unwrapped target's, and the target is not trusted. Behind a shortener the finding weighs less."""
    rows = links.select("key", "url", "shown", shown_domain(F.col("shown")).alias("promised"), urls.parts(urls.normalise(F.col("url")))["host"].alias("own"), urls.parts(urls.unwrap(urls.normalise(F.col("url"))))["host"].alias("real"))
    other = lambda c: urls.registrable(F.col(c)) != urls.registrable(F.col("promised"))
    fires = rows.filter(F.col("promised").isNotNull() & (F.col("real") != "") & other("own") & other("real") & ~urls.registrable(F.col("real")).isin(*trusted, ""))
    short = F.col("real").isin(*urls.SHORTENERS)
    return fires.select("key", "url", F.lit("url.deceptive_link").alias("rule"), F.when(short, 2).otherwise(3).alias("severity"), F.when(short, 40).otherwise(65).alias("score"), "promised", "real")


@R.add(
    f"""WITH l AS (SELECT page_id AS key, CASE WHEN page_id % 6 = 5 THEN 'https://short.example/' || CAST(page_id AS VARCHAR) ELSE url END AS url, page_id % 6 AS k FROM pages), h AS (SELECT *, {urls._parts_sql("url")["host"]} AS host FROM l)
SELECT key, url, 'url.deceptive_link' AS rule, CASE WHEN k = 5 THEN 2 ELSE 3 END AS severity, CASE WHEN k = 5 THEN 40 ELSE 65 END AS score, CASE WHEN k = 1 THEN 'www.bank.example' ELSE 'bank.example' END AS promised, host AS real FROM h WHERE k IN (1, 2, 5)"""
)
def deceptive_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth link each: its own host, another www. host, another address, plain words, a mail address, another behind a shortener."""
    k = F.col("page_id") % 6
    url = F.when(k == 5, F.concat(F.lit("https://short.example/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    shown = F.when(k == 0, F.concat(F.lit("see "), urls.parts(url)["host"])).when(k == 1, "go to (www.bank.example) now").when(k.isin(2, 5), "https://Bank.Example/login").when(k == 3, "open the report").otherwise("write me@bank.example")
    return deceptive_links(src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), url.alias("url"), shown.alias("shown")))


@F.pandas_udf(T.StringType())
def unicode_label(label: pd.Series) -> pd.Series:
    """A label of xn-- in its own letters; others, and broken ones, as they are."""

    def decoded(x):
        try:
            return x[4:].encode().decode("punycode") if x and x.startswith("xn--") else x
        except UnicodeError:
            return x

    return label.map(decoded)


def idn_findings(rows: DataFrame, key: str, url: str) -> DataFrame:
    """key, url, rule, severity, score: `url.idn_homograph` for hosts with a label of xn-- that reads like another name.

    A label does if, in its own letters, it mixes Latin with other alphabets, or if its skeleton is plain ASCII though it is not.
    An honest name in one alphabet, with accents or without, does not.
    """
    hosts = rows.select(key, url, urls.parts(F.col(url))["host"].alias("_host")).filter(F.col("_host").contains("xn--"))
    labels = hosts.select("_host").distinct().withColumn("label", F.explode(F.split("_host", r"\."))).filter(F.col("label").startswith("xn--"))
    own = labels.withColumn("name", F.lower(unicode_label(F.col("label")))).filter(F.col("name") != F.col("label"))
    mixed = F.col("name").rlike("[a-z]") & F.col("name").rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]")
    posing = ~F.col("name").rlike(r"^\p{ASCII}*$") & skeleton(F.col("name")).rlike(r"^\p{ASCII}*$")
    bad = own.filter(mixed | posing).select("_host").distinct()
    return hosts.join(bad, "_host").select(key, url, F.lit("url.idn_homograph").alias("rule"), F.lit(3).alias("severity"), F.lit(60).alias("score"))


#: Labels with the letters that they stand for: Cyrillic a in paypal, all Cyrillic cop, German, Spanish, Cyrillic of its own, broken.
_LABELS = tuple("xn--" + x.encode("punycode").decode() for x in ("p\u0430ypal", "\u0441\u043e\u0440", "m\u00fcnchen", "se\u00f1or", "\u0436\u0443\u043a")) + ("xn--\u00e9",)


@R.add(
    f"""SELECT page_id, 'http://' || [{", ".join(f"'{x}'" for x in _LABELS)}][page_id % 6 + 1] || '.' || {urls._parts_sql("url")["host"]} || '/' AS url, 'url.idn_homograph' AS rule, 3 AS severity, 60 AS score FROM pages WHERE page_id % 6 < 2"""
)
def idn_homograph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six international labels before the pages' hosts, two of which pose as other names."""
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), F.col("page_id") % 6)
    url = F.concat(F.lit("http://"), label, F.lit("."), urls.parts(F.col("url"))["host"], F.lit("/"))
    return idn_findings(src.table(spark, sf_dir, "pages").select("page_id", url.alias("url")), "page_id", "url")


def _shorter(names: Column) -> Column:
    """All strings that lack one character of one of names."""
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))), lambda i: F.concat(n.substr(F.lit(1), i - 1), n.substr(i + F.lit(1), F.length(n)))))))


KINDS = ("tld_swap", "homoglyph", "typo", "affix", "subdomain")


def imitations(hosts: DataFrame, targets: DataFrame) -> DataFrame:
    """host, target, kind: which of targets(target) each host imitates, the first kind of KINDS, then the target that sorts first.

    Any number of targets: each kind is a join on a key (name, skeleton, name without up to two characters, name without an
    affix, run of labels). Hosts of a target's own are left out. Short names allow no typo, those up to six letters one, longer ones two.
    """
    own = F.substring_index("target", ".", 1)
    reach = F.when(F.length(own) <= 3, 0).when(F.length(own) <= 6, 1).otherwise(2)
    known = targets.select("target").distinct().select("target", own.alias("own"), skeleton(own).alias("skeleton"), reach.alias("reach"), F.size(F.split("target", r"\.")).alias("labels"))
    longest = known.agg(F.max(F.length("own"))).first()[0] or 0
    rows = hosts.select("host").distinct().withColumn("domain", urls.registrable(F.col("host"))).withColumn("label", F.substring_index("domain", ".", 1))
    plain = rows.filter(~F.col("label").startswith("xn--")).withColumn("name", F.col("label"))
    rows = plain.unionByName(rows.filter(F.col("label").startswith("xn--")).withColumn("name", unicode_label(F.col("label"))))
    rows = rows.select("host", "domain", "name")
    suffixes = rows.select("host", F.explode(urls.suffix_keys(F.col("host"))).alias("target"))
    rows = written(rows.join(suffixes.join(known.select("target"), "target").select("host").distinct(), "host", "left_anti"), "hosts")
    known = written(known, "targets")

    def typos(names: DataFrame, name: str, reach: Column) -> DataFrame:
        once = _shorter(F.array(name))
        keys = F.when(reach == 1, F.concat(F.array(name), once)).when(reach == 2, F.concat(F.array(name), once, _shorter(once))).otherwise(F.array().cast("array<string>"))
        return names.withColumn("key", F.explode(F.array_distinct(keys)))

    # Pairs that share a key are few; written, they keep the long distance expression out of a plan with all the joins.
    near = typos(rows.filter(F.length("name") <= longest + 2), "name", F.lit(2)).join(typos(known, "own", F.col("reach")), "key").select("host", "target", "name", "own", "reach").distinct()
    near = written(near.filter(F.levenshtein("name", "own") <= 2 * F.col("reach")), "near")
    cut = lambda n, w: F.array(F.regexp_extract(n, f"^(.+?)-?{w}$", 1), F.regexp_extract(n, f"^{w}-?(.+)$", 1))
    bare = rows.withColumn("own", F.explode(F.array_distinct(F.flatten(F.array(*[cut(F.col("name"), w) for w in AFFIXES])))))
    labels = F.split("host", r"\.")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.when(i + n - 1 < F.size(labels), F.array_join(F.slice(labels, i, n), ".")))))
    found = [
        rows.join(known, rows["name"] == known["own"]).select("host", "target", F.lit(0).alias("kind")),
        rows.withColumn("skeleton", skeleton(F.col("name"))).join(known, "skeleton").select("host", "target", F.lit(1).alias("kind")),
        near.filter(osa_distance(F.col("name"), F.col("own"), 2) <= F.col("reach")).select("host", "target", F.lit(2).alias("kind")),
        bare.join(known, "own").select("host", "target", F.lit(3).alias("kind")),
        rows.select("host", F.explode(runs).alias("target")).join(known.select("target"), "target").select("host", "target", F.lit(4).alias("kind")),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("host").agg(F.min(F.struct("kind", "target")).alias("b"))
    return best.select("host", "b.target", F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("b.kind")).alias("kind"))


_OWN = "lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g'))"
_SKELETON = f"replace(replace(replace(translate(lower({{0}}), '{CONFUSABLE[0]}', '{CONFUSABLE[1]}'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd')"
_FORMS = ("{0}.example", "mail.{0}.example", "{0}.net", "{1}.example", "{2}.example", "{0}-login.example", "secure{0}.org", "{0}.example.evil.net", "x{0}y{0}.example")


@R.add(
    f"""WITH t AS (SELECT n_nationkey AS k, {_OWN} AS own, {_OWN} || '.example' AS target FROM nation),
h AS (SELECT CASE f WHEN 0 THEN own || '.example' WHEN 1 THEN 'mail.' || own || '.example' WHEN 2 THEN own || '.net' WHEN 3 THEN translate(own, 'oe', '03') || '.example' WHEN 4 THEN substr(own, 1, 1) || substr(own, 3, 1) || substr(own, 2, 1) || substr(own, 4) || '.example'
  WHEN 5 THEN own || '-login.example' WHEN 6 THEN 'secure' || own || '.org' WHEN 7 THEN own || '.example.evil.net' ELSE 'x' || own || 'y' || own || '.example' END AS host FROM t, range(9) r(f)),
d AS (SELECT DISTINCT host, regexp_extract(host, '([^.]+)[.][^.]+$', 1) AS name, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain FROM h),
p AS (SELECT host, target, CASE WHEN name = own THEN 0 WHEN {_SKELETON.format('name')} = {_SKELETON.format('own')} THEN 1
   WHEN length(own) > 3 AND damerau_levenshtein(name, own) <= CASE WHEN length(own) <= 6 THEN 1 ELSE 2 END THEN 2
   WHEN list_contains(list_transform([{', '.join(f"'{w}'" for w in AFFIXES)}], lambda w: name IN (own || '-' || w, w || '-' || own, own || w, w || own)), true) THEN 3
   WHEN contains('.' || host, '.' || target || '.') THEN 4 END AS kind FROM d, t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE d.domain = o.target OR ends_with(d.host, '.' || o.target)))
SELECT host, arg_min(target, (kind, target)) AS target, [{', '.join(f"'{k}'" for k in KINDS)}][min(kind) + 1] AS kind FROM p WHERE kind IS NOT NULL GROUP BY host"""
)
def brand_imitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine forms of each nation's name against all of them."""
    own = F.lower(F.regexp_replace("n_name", "[^A-Za-z]", ""))
    swapped = F.concat(own.substr(1, 1), own.substr(3, 1), own.substr(2, 1), own.substr(4, 99))
    said = {"{0}": own, "{1}": F.translate(own, "oe", "03"), "{2}": swapped}

    def form(text: str) -> Column:
        import re

        return F.concat(*[said.get(x, F.lit(x)) for x in re.split(r"(\{[0-9]\})", text) if x])

    nations = src.table(spark, sf_dir, "nation")
    hosts = nations.select(F.explode(F.array(*[form(t) for t in _FORMS])).alias("host"))
    return imitations(hosts, nations.select(F.concat(own, F.lit(".example")).alias("target")))
