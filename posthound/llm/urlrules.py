"""URL filters by association rules, in DataFrame operations only.

FP-growth mines the URL token combinations of labelled pages; rules `tokens -> blocked` with enough confidence and support stay.
A page is held against them through an inverted index: each rule is filed under its rarest token, and a page's tokens fetch
the rules filed under them. Explicit host and path rules go first.

Tokens that lie in the same labelled pages are one item of the mining, named after the one that sorts first: every rule over them
says the same, and a URL family that shares many tokens does not double the itemsets with each. A page holds an item if it holds one
of its tokens, so that the pages that rules fit stay the same. An item that is a rule by itself goes into no longer one: what that would
block is blocked already, and families of bad words do not double the itemsets either. Itemsets still grow with items that are no
rule alone and meet in `min_support` of the pages.

Cases: a null url, or one without `://`, has empty host and path and no token, and is allowed; a label row without a page, or
one whose quality and toxic are both null, trains nothing; repeated pages are judged alike, row by row; empty tables give no rule or no
row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthound.llm.common import sized
from posthound.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKED = "label=block"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as written: what lies after the first `://` up to `/`, `?` or `#`; then up to `?` or `#`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, the last two labels together, path words without digits, names of query parameters."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    site = F.concat(F.lit("site="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}]+"), lambda x: x != "")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(query, lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tagged = F.concat(F.transform(labels, lambda x: F.concat(F.lit("host="), x)), F.transform(words, lambda x: F.concat(F.lit("path="), x)), F.transform(keys, lambda x: F.concat(F.lit("key="), x)))
    return F.when(F.size(labels) > 0, F.array_distinct(F.concat(tagged, F.array(site)))).otherwise(F.array().cast("array<string>"))


def merge_equal(labelled: DataFrame, least: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """labelled(tokens, blocked) over items that are no rule by themselves, and items(token, name, bad, n, alone): tokens that
    occur in the same rows are one item, of which n rows, bad of them blocked; alone: enough of those are blocked.

    Tokens that fewer than `least` blocked rows hold can be in no rule and go.
    """
    keyed = labelled.select(F.xxhash64(F.array_sort("tokens")).alias("id"), "tokens", "blocked")
    rows = written(keyed.groupBy("id").agg(F.first("tokens").alias("tokens"), F.count_if("blocked").alias("bad"), F.count(F.lit(1)).alias("n")), "baskets")
    # Two sums over the hashes of a token's rows stand for the set of rows.
    marks = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    held = written(rows.select("id", "bad", "n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), *marks).filter(F.col("bad") >= least), "frequent")
    names = held.groupBy("s0", "s1").agg(F.min("token").alias("name"))
    items = written(held.join(names, ["s0", "s1"]).select("token", "name", "bad", "n", (F.col("bad") / F.col("n") >= min_confidence).alias("alone")), "items")
    kept = rows.select("id", F.explode("tokens").alias("token")).join(sized(items.filter("not alone").select("token", "name")), "token").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("tokens"))
    return keyed.select("id", "blocked").join(kept, "id", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "blocked"), items


def mine(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """rule(key, tokens, confidence, support) over items, and items(token, name), from labelled(tokens, blocked); support: at least
    min_support and min_rows rows. No rule holds an item that is a rule by itself."""
    spark = labelled.sparkSession
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "key string, tokens array<string>, confidence double, support double"), spark.createDataFrame([], "token string, name string")
    least = min(1.0, max(min_support, min_rows / n))
    labelled, items = merge_equal(labelled, least * n, min_confidence)
    single = items.filter("alone").groupBy("name").agg(F.first("bad").alias("bad"), F.first("n").alias("n"))
    single = single.select(F.col("name").alias("key"), F.array("name").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(n)).alias("support"))
    baskets = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    counts = labelled.select(F.explode("tokens").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.select("*", F.explode("tokens").alias("key")).join(counts, "key").groupBy("tokens").agg(F.min(F.struct("n", "key")).alias("m"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return single.unionByName(filed.select(F.col("m.key").alias("key"), "tokens", "confidence", "support")), items.select("token", "name")


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    name = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return name, verdict


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = 0.002, min_rows: int = 10, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the best mined rule that fits, where no explicit one does). Null ids stay null.

    labels(doc_id, quality, toxic): a page is blocked in training if its row says quality 0 or toxic 1.
    """
    host, path = host_path(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    bad = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("blocked"))
    mined, items = mine(written(pages.join(bad, "page_id").select("tokens", "blocked"), "labelled"), min_support, min_rows, min_confidence)
    mined = written(mined, "rules")
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": name, "said": verdict})
    open_urls = pages.filter("said is null and size(tokens) > 0").select(F.col("url").alias("u"), "tokens").distinct()
    hits = (
        open_urls.select("u", F.explode("tokens").alias("token"))
        .join(sized(items), "token")
        .groupBy("u")
        .agg(F.collect_set("name").alias("tokens"))
        .select("u", "tokens", F.explode("tokens").alias("key"))
        .join(mined.select("key", F.col("tokens").alias("need"), "confidence"), "key")
        .filter(F.size(F.array_except("need", "tokens")) == 0)
        .groupBy("u")
        .agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.array_join("need", " ").alias("need"))).alias("best"))
        .select("u", F.col("best.need").alias("mined"))
    )
    out = pages.join(hits, pages["url"] == hits["u"], "left")
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.when(F.col("said").isNull(), F.col("mined")).alias("mined"))
