"""Authentication results of whole messages: the header that counts, its neighbours of the same server, and forwarding chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.operators.messages import _COMP, _DMARC, _SERVERS, _SPF, METHODS, _pick, _pick_sql
from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()
#: Header names and what they are called here.
SOURCES = {"authentication-results": "result", "arc-authentication-results": "chain", "received-spf": "spf"}
#: Results that a Received-SPF header may begin with.
SPF_WORDS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror")
FACTS = (*METHODS, "policy", "header_from", "mail_from")


def _uncommented(value: Column, levels: int = 4) -> Column:
    """Without comments in brackets, nested up to `levels`."""
    for _ in range(levels):
        value = F.regexp_replace(value, r"\([^()]*\)", " ")
    return value


def _said(text: Column, name: str) -> Column:
    """The first value of `name=value` in a header, lower-case and unquoted; null if absent or empty."""
    found = F.lower(F.regexp_extract(text, rf'(?i)(?:^|[;\s]){name}(?:/[0-9]+)?\s*=\s*"?([^\s;"]+)', 1))
    return F.when(found != "", found)


def parsed(headers: DataFrame) -> DataFrame:
    """One row per authentication header of headers(id, position, name, value), with what it says; absent facts are null.

    of is result, chain (with its instance) or spf. A header without a server name, as some services write it, has authserv null.
    dkim: pass if any signature passed, else fail if any failed, else the first result.
    """
    kinds = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    rows = headers.select("id", "position", F.element_at(kinds, F.lower("name")).alias("of"), F.coalesce("value", F.lit("")).alias("raw")).filter("of is not null")
    chain = F.col("of") == "chain"
    step = r"(?i)^\s*i\s*=\s*([0-9]{1,9})\s*(?:;|$)"
    rows = rows.withColumn("t", _uncommented(F.col("raw")))
    rows = rows.withColumn("instance", F.when(chain, F.regexp_extract("t", step, 1).try_cast("int"))).withColumn("t", F.when(chain, F.regexp_replace("t", step, "")).otherwise(F.col("t")))
    t, first = F.col("t"), F.split("t", ";")[0]
    server = F.lower(F.regexp_extract(first, r"^\s*(\S+)", 1))
    domain = lambda s: F.coalesce(_said(s, r"header\.d"), F.substring_index(_said(s, r"header\.i"), "@", -1))
    mentions = F.filter(F.split(t, ";"), lambda s: F.lower(s).contains("dkim"))
    rows = rows.withColumn("signed", F.filter(F.transform(mentions, lambda s: F.struct(_said(s, "dkim").alias("result"), domain(s).alias("domain"))), lambda x: x["result"].isNotNull()))
    results = F.col("signed.result")
    dkim = F.when(F.array_contains(results, "pass"), "pass").when(F.array_contains(results, "fail"), "fail").otherwise(F.get(results, F.lit(0)))
    domains = F.array_distinct(F.filter(F.col("signed.domain"), lambda d: d.isNotNull() & (d != "")))
    action = F.coalesce(_said(t, "action"), _said(t, r"policy\.applied-disposition"))
    policy = F.when(action.isin("none", "quarantine", "reject"), action).when(action.isin("oreject", "pct.reject"), "reject").when(action == "pct.quarantine", "quarantine")
    published = F.lower(F.regexp_extract("raw", r"(?i)(?:^|[\s(;])p\s*=\s*(none|quarantine|reject)\b", 1))
    word = F.lower(F.regexp_extract(t, r"^\s*([A-Za-z]+)", 1))
    own = F.col("of") != "spf"
    return rows.select(
        "id", "position", "of", "instance",
        F.when(own & ~first.contains("=") & (server != ""), server).alias("authserv"),
        F.when(own, _said(t, "spf")).when(word.isin(*SPF_WORDS), word).alias("spf"),
        F.when(own, dkim).alias("dkim"), F.when(own, _said(t, "dmarc")).alias("dmarc"), F.when(own, _said(t, "compauth")).alias("compauth"),
        F.when(own, F.coalesce(policy, F.when(published != "", published))).alias("policy"),
        F.when(own, _said(t, r"header\.from")).alias("header_from"), F.when(own, _said(t, r"smtp\.mailfrom")).alias("mail_from"),
        F.when(own, domains).otherwise(F.array().cast("array<string>")).alias("domains"),
    )


def is_trusted(server: Column, trusted: tuple[str, ...]) -> Column:
    """Whether a server is named, or lies below a name that begins with `*.`; `*` alone names nobody."""
    names = [n for n in (x.strip().lower().rstrip(".") for x in trusted) if n not in ("", "*", "*.")]
    server = F.regexp_replace(F.coalesce(server, F.lit("")), r"\.+$", "")
    out = server.isin(*[n for n in names if not n.startswith("*.")]) if any(not n.startswith("*.") for n in names) else F.lit(False)
    for n in names:
        if n.startswith("*."):
            out = out | (server.endswith(n[1:]) & (F.length(server) > len(n) - 1))
    return out


def merged(rows: DataFrame) -> DataFrame:
    """Results that one server wrote as several headers, one below the other, as one row at the place of the first.

    The first header that tells a fact counts, but one signature that passed makes dkim pass. Any other header between two
    parts them; headers without a server name, and those of chains, stay by themselves.
    """
    alone = (F.col("of") != "result") | F.col("authserv").isNull()
    key = F.when(alone, F.concat(F.lit("\n"), F.col("position").cast("string"))).otherwise(F.col("authserv"))
    rows = rows.withColumn("_key", key)
    run = F.col("position") - F.row_number().over(W.partitionBy("id", "of", "_key").orderBy("position"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    domains = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "domains"))), lambda x: x["domains"]))).alias("domains")
    facts = [F.when(F.bool_or(F.col(c) == "pass"), "pass").otherwise(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("position")))).alias(c) if c == "dkim" else first(c) for c in FACTS]
    grouped = rows.withColumn("_run", run).groupBy("id", "of", "_key", "_run")
    return grouped.agg(F.min("position").alias("position"), F.max("instance").alias("instance"), F.first("authserv").alias("authserv"), *facts, domains).drop("_key", "_run")


def collected_each(headers: DataFrame, policies: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per message with any authentication header and per policy: id, policy_name and what `collected` gives for the servers it names.

    Headers are read, shuffled and merged once; the policies differ in one aggregation only.
    """
    rows = merged(parsed(headers))
    here, own = F.col("position"), [c for c in ("of", "authserv", *FACTS, "domains")]
    chain = F.struct(F.lit(1).alias("a"), (-F.coalesce("instance", F.lit(0))).alias("b"), here.alias("c"))
    topmost = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), here.alias("c"))
    anyone = F.when(F.col("of") == "result", topmost).when(F.col("of") == "chain", chain)
    best = []
    for i, trusted in enumerate(policies.values()):
        named = (F.col("of") != "spf") & is_trusted(F.col("authserv"), trusted)
        best.append(F.min_by(F.struct(*own, named.alias("named")), F.when(named, topmost) if trusted else anyone).alias(f"x{i}"))
    rest = F.min_by("spf", F.when(F.col("of") == "spf", here)).alias("received")
    one = rows.groupBy("id").agg(*best, F.bool_or(F.col("of") != "spf").alias("has_auth"), rest)
    each = F.array(*[F.struct(F.lit(name).alias("policy_name"), F.lit(bool(trusted)).alias("strict"), F.col(f"x{i}").alias("x")) for i, (name, trusted) in enumerate(policies.items())])
    one = one.select("id", "has_auth", "received", F.inline(each))
    spf = F.coalesce("x.spf", F.when(~F.col("strict"), F.col("received")))
    of = F.coalesce("x.of", F.when(~F.col("strict") & F.col("received").isNotNull(), "spf"))
    told = [F.coalesce(spf if c == "spf" else F.col(f"x.{c}"), F.lit("")).alias(c) for c in FACTS]
    return one.select("id", "policy_name", F.coalesce(of, F.lit("")).alias("of"), F.coalesce("x.authserv", F.lit("")).alias("authserv"), "has_auth", F.coalesce("x.named", F.lit(False)).alias("trusted_auth"), *told, F.coalesce("x.domains", F.array().cast("array<string>")).alias("domains"))


def collected(headers: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """One row per message with any authentication header: of, authserv, has_auth, trusted_auth and the facts that count ('' if absent).

    headers(id, position, name, value) hold every header of a message by its place from the top. With servers named, the topmost
    result or chain that one of them wrote counts, else nothing does. With none named, the topmost result counts; without one
    the chain of the greatest instance; spf falls back on the topmost Received-SPF. trusted_auth is true for named servers only.
    """
    return collected_each(headers, {"": trusted}).drop("policy_name")


_NAMES, _SIGNED = ("Authentication-Results", "authentication-results", "Authentication-Results", "ARC-Authentication-Results", "Received-SPF"), ("pass", "fail", "none", "")
_PICKS = {"name": ("event_id // 3 + user_id", _NAMES), "authserv": ("event_id // 2", ("MX.Corp.Example", *_SERVERS[1:])), "spf": ("event_id + user_id", _SPF), "d1": ("event_id // 5 + user_id", _SIGNED), "d2": ("event_id // 7", _SIGNED), "dmarc": ("event_id // 2 + user_id", _DMARC), "compauth": ("user_id", _COMP), "policy": ("user_id // 2", ("none", "reject", ""))}


@R.add(
    f"""WITH h AS (SELECT event_id // 5 AS id, event_id % 5 AS position, user_id % 9 + 1 AS instance, {", ".join(f"{_pick_sql(by, *v)} AS {k}" for k, (by, v) in _PICKS.items())} FROM events),
k AS (SELECT id, position, CASE WHEN name = 'Received-SPF' THEN 'spf' WHEN name LIKE 'ARC%' THEN 'chain' ELSE 'result' END AS of, instance, lower(authserv) AS authserv, nullif(spf, '') AS spf, nullif(dmarc, '') AS dmarc, nullif(compauth, '') AS compauth,
  CASE WHEN dmarc <> '' THEN nullif(policy, '') END AS policy, CASE WHEN 'pass' IN (d1, d2) THEN 'pass' WHEN 'fail' IN (d1, d2) THEN 'fail' ELSE nullif(d1 || CASE WHEN d1 = '' THEN d2 ELSE '' END, '') END AS dkim,
  list_distinct(list_filter([CASE WHEN d1 <> '' THEN 'a.example' END, CASE WHEN d2 <> '' THEN 'b' || CAST(position AS VARCHAR) || '.example' END], lambda x: x IS NOT NULL)) AS domains FROM h),
p AS (SELECT *, CASE WHEN of = 'result' AND authserv <> '' AND lag(of) OVER w = 'result' AND lag(authserv) OVER w = authserv AND lag(position) OVER w = position - 1 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY id ORDER BY position)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY position) AS run FROM p),
m AS (SELECT id, run, any_value(of) AS of, min(position) AS position, max(instance) AS instance, any_value(authserv) AS authserv, arg_min(spf, position) FILTER (spf IS NOT NULL) AS spf, arg_min(dmarc, position) FILTER (dmarc IS NOT NULL) AS dmarc,
  arg_min(compauth, position) FILTER (compauth IS NOT NULL) AS compauth, arg_min(policy, position) FILTER (policy IS NOT NULL) AS policy,
  CASE WHEN bool_or(dkim = 'pass') THEN 'pass' ELSE arg_min(dkim, position) FILTER (dkim IS NOT NULL) END AS dkim, len(list_distinct(flatten(list(domains)))) AS n_domains FROM g GROUP BY id, run),
named AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS k FROM m WHERE of <> 'spf' AND authserv = 'mx.corp.example'),
any_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY of = 'chain', CASE WHEN of = 'chain' THEN -instance END, position) AS k FROM m WHERE of <> 'spf'),
i AS (SELECT id, bool_or(of <> 'spf') AS has_auth, (list(spf ORDER BY position) FILTER (of = 'spf'))[1] AS received FROM m GROUP BY id)
SELECT i.id, 'named' AS mode, coalesce(of, '') AS of, coalesce(authserv, '') AS authserv, has_auth, of IS NOT NULL AS trusted_auth, coalesce(spf, '') AS spf, coalesce(dkim, '') AS dkim, coalesce(dmarc, '') AS dmarc, coalesce(compauth, '') AS compauth, coalesce(policy, '') AS policy, CAST(coalesce(n_domains, 0) AS INTEGER) AS n_domains
FROM i LEFT JOIN named n ON i.id = n.id AND k = 1
UNION ALL SELECT i.id, 'any', coalesce(of, CASE WHEN received IS NOT NULL THEN 'spf' ELSE '' END), coalesce(authserv, ''), has_auth, FALSE, coalesce(spf, received, ''), coalesce(dkim, ''), coalesce(dmarc, ''), coalesce(compauth, ''), coalesce(policy, ''), CAST(coalesce(n_domains, 0) AS INTEGER)
FROM i LEFT JOIN any_ a ON i.id = a.id AND k = 1"""
)
def auth_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five headers a message, written from the events' numbers: three kinds, three servers, two signatures; with and without named servers."""
    k = F.col("event_id")
    rows = src.table(spark, sf_dir, "events").select((F.expr("event_id div 5")).alias("id"), (k % 5).alias("position"), (F.col("user_id") % 9 + 1).cast("string").alias("i"), *[_pick(F.expr(by.replace("//", "div")), *v).alias(n) for n, (by, v) in _PICKS.items()])
    said = lambda m, c, *more: F.when(F.col(c) != "", F.concat(F.lit(f"{m}="), F.col(c), *more))
    signed = [said("DKIM", "d1", F.lit(" (2048 (bit) key; dkim=pass) header.d=a.example")), said("dkim", "d2", F.lit(" header.i=@b"), F.col("position").cast("string"), F.lit(".example"))]
    dmarc = said("dmarc", "dmarc", F.when(F.col("policy") != "", F.concat(F.lit(" action="), F.col("policy"))).otherwise(F.lit("")), F.lit(" header.from=a.example"))
    chain, received = F.col("name").startswith("ARC"), F.col("name") == "Received-SPF"
    value = F.concat_ws("; ", F.when(chain, F.concat(F.lit("i="), "i")), F.when(F.col("authserv") != "", F.col("authserv")), said("spf", "spf", F.lit(" smtp.mailfrom=x")), *signed, dmarc, said("compauth", "compauth"))
    value = F.when(received, F.concat(F.initcap("spf"), F.lit(" (mx: spf=pass) client-ip=1"))).otherwise(value)
    headers = rows.select("id", "position", "name", value.alias("value"))
    out = collected_each(headers, {"named": ("*.corp.example",), "any": ()})
    return out.select("id", F.col("policy_name").alias("mode"), "of", "authserv", "has_auth", "trusted_auth", *METHODS, "policy", F.size("domains").alias("n_domains"))
