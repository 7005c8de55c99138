"""Rules on messages: authentication results, headers, wording; all as Column expressions over literal or parsed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.operators.files import told
from posthound.operators.lookalike import lookalike_kind
from posthound.plans.registry import Registry
from posthound.session import small_batches
from posthound.sources import adapters as src

R = Registry()
FREEMAIL = ("gmail.com", "outlook.com", "yahoo.com", "proton.me")
METHODS = ("spf", "dkim", "dmarc", "compauth")


def parse_auth(value: Column, trusted: tuple[str, ...]) -> dict[str, Column]:
    """authserv, trusted, and the result of each method in one Authentication-Results value ('' if absent).

    A header is trusted only if a server that is named in `trusted` wrote it; with none named, no header is.
    """
    value = F.regexp_replace(value, r"\([^()]*\)", " ")
    server = F.lower(F.trim(F.substring_index(value, ";", 1)))
    server = F.regexp_extract(server, r"^([^\s;]+)", 1)
    out = {"authserv": F.when(server.contains("="), F.lit("")).otherwise(server)}
    out["trusted"] = out["authserv"].isin(*trusted) if trusted else F.lit(False)
    for m in METHODS:
        out[m] = F.lower(F.regexp_extract(value, rf"(?i)(?:^|[;\s]){m}\s*=\s*([A-Za-z]+)", 1))
    return out


def domain_of(address: Column) -> Column:
    address = F.lower(F.coalesce(address, F.lit("")))
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def _found(cond: Column, rule: str, severity: int, score: int, category: str = "spoofing") -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(score).alias("score"), F.lit(category).alias("category")))


def header_findings(rows: DataFrame, company: tuple[str, ...]) -> DataFrame:
    """id, rule, severity, score, category of rows(id, from_addr, from_display, reply_to, return_path, spf, dkim, dmarc, compauth, has_auth, trusted_auth)."""
    c = F.col
    display = F.lower(F.coalesce("from_display", F.lit("")))
    # Each step by itself, so that none is worked out anew for every rule.
    rows = rows.withColumns({"_sender": domain_of(c("from_addr")), "_reply": domain_of(c("reply_to")), "_path": domain_of(c("return_path")), "_shown": F.regexp_extract(display, r"([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})", 1)})
    sender, reply, path, shown = c("_sender"), c("_reply"), c("_path"), c("_shown")
    own = sender.isin(*company)
    unsure = c("dmarc").isin("none", "", "temperror", "permerror") & c("spf").isin("fail", "softfail") & (c("dkim") != "pass")
    spoof = own & ((c("dmarc") == "fail") | unsure)
    passed, failed = c("dmarc") == "pass", c("dmarc") == "fail"
    none = (c("spf") == "") & (c("dkim") == "") & (c("dmarc") == "") & (c("compauth") == "")
    open_ = ~spoof & ~failed & ~passed
    kind = lambda d: F.when(d != "", lookalike_kind(d, company)).otherwise(F.lit(None))
    found = [
        _found(c("has_auth") & ~c("trusted_auth"), "headers.no_trusted_auth_results", 0, 0),
        _found(none & ~c("has_auth"), "headers.no_auth_results", 0, 0),
        _found(spoof, "headers.own_domain_spoof", 3, 70),
        _found(~spoof & failed, "headers.dmarc_fail", 2, 40),
        _found(open_ & c("spf").isin("fail", "hardfail"), "headers.spf_fail", 2, 30),
        _found(open_ & (c("spf") == "softfail"), "headers.spf_softfail", 1, 10),
        _found(open_ & (c("dkim") == "fail") & ~own, "headers.dkim_fail", 1, 15),
        _found(open_ & (c("compauth") == "fail") & ~own, "headers.compauth_fail", 1, 15),
        _found((shown != "") & (shown != sender) & ~sender.endswith(F.concat(F.lit("."), shown)), "headers.display_name_spoof", 3, 65),
        _found((reply != "") & (reply != sender) & reply.isin(*FREEMAIL), "headers.reply_to_mismatch", 2, 35),
        _found((path != "") & (path != sender) & ~passed, "headers.return_path_mismatch", 1, 10),
        _found(~own & (kind(sender).isNotNull() | (~reply.isin(*company) & kind(reply).isNotNull())), "headers.lookalike_domain", 3, 70),
    ]
    # explode_outer of a plain array, as in files.told.
    return rows.select("id", F.explode_outer(F.array(*found)).alias("f")).filter("f is not null").select("id", "f.*")


#: Wording that the content rules look for; alternatives of one regular expression each.
URGENCY = r"urgent|immediately|within 24 hours|last notice|asap|final warning"
CREDENTIALS = r"verify your account|confirm your password|sign in to|account (?:is )?suspended|unusual sign-in"
INVOICE = r"invoice|payment receipt|purchase order|remittance|overdue"
BANK_CHANGE = r"(?:new|changed|updated) bank (?:account|details)|change of bank"
PRETEXT = r"are you at your desk|quick favou?r|confidential matter|wire transfer"
GIFT = r"gift cards?|itunes card|steam card"
PASSWORD_HINT = r"(?:password|passcode|clave|senha|contraseña)\s*(?:is|es|:|=)\s*(\S{3,40})"
WORDINGS = {"hot": URGENCY, "bank": BANK_CHANGE, "cred": CREDENTIALS, "bill": INVOICE, "pre": PRETEXT, "gift": GIFT}


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))


def phrase(text: Column, words: str) -> Column:
    return text.rlike(rf"(^|[^a-z0-9])({words})([^a-z0-9]|$)")


#: Fits wherever one of WORDINGS or PASSWORD_HINT fits the text that normal() makes, and more: any letter case, any space, without edges.
_SPACE = r"[\s\x0B\pZ]"
LOOSE = "(?i)" + "|".join([*(w.replace(" ", f"{_SPACE}+") for w in WORDINGS.values()), rf"(?:password|passcode|clave|senha|contraseña){_SPACE}*(?:is|es|:|=)"])


def wordings(rows: DataFrame) -> DataFrame:
    """rows(subject, body, ...) with what their wording shows (hot, bank, cred, bill, pre, gift, hint) in place of their texts; most rows that show nothing are left out.

    Arrow looks for all wordings in one pass over a batch; only where it finds any, texts are made plain and asked for each.
    """
    small_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c not in ("subject", "body")]
    rows = rows.select(*rest, F.concat_ws(" ", "subject", "body").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.match_substring_regex(batch.column("_t"), LOOSE))

    some = rows.mapInArrow(run, rows.schema).withColumn("_t", normal(F.col("_t")))
    t = F.col("_t")
    return some.select(*rest, *[phrase(t, w).alias(n) for n, w in WORDINGS.items()], t.rlike(PASSWORD_HINT).alias("hint"))


def wording_findings(rows: DataFrame) -> DataFrame:
    """id, rule, score of rows(id, attachments, risky, has_urls, and what wordings() gives)."""
    c = F.col
    hot = c("hot").cast("int")
    lure = F.when(c("pre") & c("gift"), 40).when(c("gift"), 15).otherwise(10) + 5 * hot
    scored = lambda cond, rule, score: F.when(cond, F.struct(F.lit(rule).alias("rule"), score.cast("int").alias("score")))
    found = [
        scored(c("hint") & (c("risky") > 0), "content.password_protected_lure", F.lit(65)),
        scored(c("hint") & (c("risky") == 0) & (c("attachments") > 0), "content.password_hint", F.lit(15)),
        scored(c("bank"), "content.bec_bank_change", 45 + 5 * hot),
        scored(c("pre") | c("gift"), "content.bec_lure", lure),
        scored(c("cred"), "content.credential_lure", F.least(F.lit(40), 15 + 10 * hot + F.when(c("has_urls"), 5).otherwise(0))),
        scored(c("bill"), "content.invoice_lure", F.when(c("risky") > 0, 30).when(c("attachments") > 0, 15).otherwise(10) + 5 * hot),
    ]
    return told(rows, "id", [*found, scored(c("hot") & F.coalesce(*found).isNull(), "content.urgency", F.lit(5))])


def content_findings(rows: DataFrame) -> DataFrame:
    """id, rule, score of rows(id, subject, body, attachments, risky, has_urls)."""
    return wording_findings(wordings(rows.select("id", "subject", "body", "attachments", "risky", "has_urls")))


def password_hint(text: Column) -> Column:
    """The hinted password with all but its first two characters masked; '' without a hint."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + PASSWORD_HINT, 1)
    return F.when(word != "", F.rpad(F.substring(word, 1, 2), F.length(word), "*")).otherwise(F.lit(""))


def _pick(by: Column, *values: str) -> Column:
    """The value whose place is `by` modulo their number."""
    return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))


def _pick_sql(by: str, *values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({by}) % {len(values)} + 1]"


_SERVERS, _SPF, _DKIM, _DMARC, _COMP = ("mx.corp.example", "evil.example", ""), ("pass", "fail", "softfail", "none", ""), ("pass", "fail", ""), ("pass", "fail", "none", ""), ("", "fail")


@R.add(
    f"""SELECT event_id AS id, {_pick_sql("user_id", *_SERVERS)} AS authserv, user_id % 3 = 0 AS trusted, {_pick_sql("event_id", *_SPF)} AS spf, {_pick_sql("event_id // 5", *_DKIM)} AS dkim, {_pick_sql("event_id // 15", *_DMARC)} AS dmarc, {_pick_sql("event_id", *_COMP)} AS compauth FROM events"""
)
def auth_results_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header of every event: three servers (or none), and each method with its remarks, or absent."""
    k, div = F.col("event_id"), lambda n: F.expr(f"event_id div {n}")
    said = lambda m, v, more: F.when(v != "", F.concat(F.lit(f"{m}="), v, F.lit(" "), more))
    notes = F.concat(F.lit("(sender no. "), k.cast("string"), F.lit("; spf=none) smtp.mailfrom=a"), k.cast("string"), F.lit(".example"))
    methods = [said("SPF", _pick(k, *_SPF), notes), said("dkim", _pick(div(5), *_DKIM), F.lit("header.d=a.example")), said("dmarc", _pick(div(15), *_DMARC), F.lit("(p=none)")), said("compauth", _pick(k, *_COMP), F.lit("reason=001"))]
    server = _pick(F.col("user_id"), *_SERVERS)
    value = F.concat_ws("; ", F.when(server != "", server), *methods)
    return src.table(spark, sf_dir, "events").select(k.alias("id"), value.alias("value")).select("id", *[c.alias(n) for n, c in parse_auth(F.col("value"), ("mx.corp.example",)).items()])


_SENDERS = ("boss@corp.example", "news@shop.example", "it@c0rp.example", "x@partner.example", "")
_SHOWN, _REPLY, _PATH = ("Boss", "it@corp.example", "", "Shop of shop.example"), ("", "help@gmail.com", "boss@corp.example"), ("", "boss@corp.example", "b@mailer.example")
_DOMAIN = lambda a: f"CASE WHEN contains({a}, '@') THEN split_part({a}, '@', 2) ELSE '' END"


@R.add(
    f"""WITH r AS (SELECT event_id AS id, {_pick_sql("event_id", *_SENDERS)} AS f, {_pick_sql("event_id // 5", *_SHOWN)} AS shown, {_pick_sql("event_id // 20", *_REPLY)} AS reply, {_pick_sql("event_id // 3", *_PATH)} AS path,
  {_pick_sql("user_id", *_SPF)} AS spf, {_pick_sql("user_id // 5", *_DKIM)} AS dkim, {_pick_sql("event_id // 7", *_DMARC)} AS dmarc, {_pick_sql("event_id // 2", *_COMP)} AS compauth, event_id % 3 > 0 AS has_auth, event_id % 3 = 1 AS trusted FROM events),
d AS (SELECT *, {_DOMAIN("f")} AS sender, {_DOMAIN("reply")} AS rd, {_DOMAIN("path")} AS pd, regexp_extract(lower(shown), '([a-z0-9-]+([.][a-z0-9-]+)*[.][a-z]{{2,}})', 1) AS said FROM r),
e AS (SELECT *, sender = 'corp.example' AND (dmarc = 'fail' OR dmarc IN ('none', '') AND spf IN ('fail', 'softfail') AND dkim <> 'pass') AS spoof FROM d),
o AS (SELECT *, NOT spoof AND dmarc NOT IN ('pass', 'fail') AS open_ FROM e)
SELECT id, 'headers.no_trusted_auth_results' AS rule, 0 AS score FROM o WHERE has_auth AND NOT trusted
UNION ALL SELECT id, 'headers.no_auth_results', 0 FROM o WHERE NOT has_auth AND spf || dkim || dmarc || compauth = ''
UNION ALL SELECT id, 'headers.own_domain_spoof', 70 FROM o WHERE spoof
UNION ALL SELECT id, 'headers.dmarc_fail', 40 FROM o WHERE NOT spoof AND dmarc = 'fail'
UNION ALL SELECT id, 'headers.spf_fail', 30 FROM o WHERE open_ AND spf = 'fail'
UNION ALL SELECT id, 'headers.spf_softfail', 10 FROM o WHERE open_ AND spf = 'softfail'
UNION ALL SELECT id, 'headers.dkim_fail', 15 FROM o WHERE open_ AND dkim = 'fail' AND sender <> 'corp.example'
UNION ALL SELECT id, 'headers.compauth_fail', 15 FROM o WHERE open_ AND compauth = 'fail' AND sender <> 'corp.example'
UNION ALL SELECT id, 'headers.display_name_spoof', 65 FROM o WHERE said <> '' AND said <> sender AND NOT ends_with(sender, '.' || said)
UNION ALL SELECT id, 'headers.reply_to_mismatch', 35 FROM o WHERE rd = 'gmail.com' AND rd <> sender
UNION ALL SELECT id, 'headers.return_path_mismatch', 10 FROM o WHERE pd <> '' AND pd <> sender AND dmarc <> 'pass'
UNION ALL SELECT id, 'headers.lookalike_domain', 70 FROM o WHERE sender = 'c0rp.example'"""
)
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of every event: senders, shown names, answer addresses and results in all combinations that the events' numbers give."""
    k, u, div = F.col("event_id"), F.col("user_id"), lambda c, n: F.expr(f"{c} div {n}")
    rows = src.table(spark, sf_dir, "events").select(
        k.alias("id"), _pick(k, *_SENDERS).alias("from_addr"), _pick(div("event_id", 5), *_SHOWN).alias("from_display"), _pick(div("event_id", 20), *_REPLY).alias("reply_to"), _pick(div("event_id", 3), *_PATH).alias("return_path"),
        _pick(u, *_SPF).alias("spf"), _pick(div("user_id", 5), *_DKIM).alias("dkim"), _pick(div("event_id", 7), *_DMARC).alias("dmarc"), _pick(div("event_id", 2), *_COMP).alias("compauth"), (k % 3 > 0).alias("has_auth"), (k % 3 == 1).alias("trusted_auth"),
    )
    return header_findings(rows, ("corp.example",)).select("id", "rule", "score")


_SUBJECTS = ("Invoice overdue", "We have a new bank account", "Quick favor", "verify your account", "lunch", "Please: asap", "gift cards")
_ENDS = (" Please pay immediately", " the password is Zx81!", "", " within 24 hours", " clave: 1234")
_SAYS = lambda words: f"regexp_matches(t, '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"
_TURNS = f"""SELECT conv_id * 1000 + turn AS id, lower(regexp_replace({_pick_sql("conv_id", *_SUBJECTS)} || ' ' || coalesce(text, '') || {_pick_sql("turn + conv_id // 7", *_ENDS)}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS t, turn % 3 AS files, turn % 2 AS risky, conv_id % 2 = 0 AS urls FROM conversations"""


@R.add(
    f"""WITH r AS (SELECT id, t, files, least(files, risky) AS risky, urls, CASE WHEN {_SAYS(URGENCY)} THEN 1 ELSE 0 END AS hot, regexp_matches(t, '{PASSWORD_HINT}') AS hint, {_SAYS(BANK_CHANGE)} AS bank, {_SAYS(CREDENTIALS)} AS cred, {_SAYS(INVOICE)} AS bill, {_SAYS(PRETEXT)} AS pre, {_SAYS(GIFT)} AS gift FROM ({_TURNS})),
h AS (SELECT id, 'content.password_protected_lure' AS rule, 65 AS score FROM r WHERE hint AND risky > 0 UNION ALL SELECT id, 'content.password_hint', 15 FROM r WHERE hint AND risky = 0 AND files > 0
  UNION ALL SELECT id, 'content.bec_bank_change', 45 + 5 * hot FROM r WHERE bank UNION ALL SELECT id, 'content.bec_lure', CASE WHEN pre AND gift THEN 40 WHEN gift THEN 15 ELSE 10 END + 5 * hot FROM r WHERE pre OR gift
  UNION ALL SELECT id, 'content.credential_lure', least(40, 15 + 10 * hot + CASE WHEN urls THEN 5 ELSE 0 END) FROM r WHERE cred
  UNION ALL SELECT id, 'content.invoice_lure', CASE WHEN risky > 0 THEN 30 WHEN files > 0 THEN 15 ELSE 10 END + 5 * hot FROM r WHERE bill)
SELECT id, rule, CAST(score AS INTEGER) AS score FROM h UNION ALL SELECT id, 'content.urgency', 5 FROM r WHERE hot > 0 AND id NOT IN (SELECT id FROM h)"""
)
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a message, with one of seven subjects and one of five endings."""
    files, end = F.col("turn") % 3, _pick(F.expr("turn + conv_id div 7"), *_ENDS)
    rows = src.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _pick(F.col("conv_id"), *_SUBJECTS).alias("subject"), F.concat(F.coalesce("text", F.lit("")), end).alias("body"), files.alias("attachments"), F.least(files, F.col("turn") % 2).alias("risky"), (F.col("conv_id") % 2 == 0).alias("has_urls"))
    return content_findings(rows)


@R.add("SELECT conv_id, turn, regexp_matches(lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '(^|[^a-z0-9])(the|and then|la clave|password)([^a-z0-9]|$)') AS hit FROM conversations")
def content_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", phrase(normal(F.col("text")), "the|and then|la clave|password").alias("hit"))


@R.add("SELECT doc_id AS id, substr(w, 1, 2) || repeat('*', length(w) - 2) AS hint FROM (SELECT doc_id, 'Q' || CAST(doc_id * 7919 AS VARCHAR) || '!' AS w FROM documents WHERE doc_id % 2 = 0)", name="password_hint")
def password_hint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document ends in a password; the hint keeps two characters of it."""
    said = F.concat(F.substring("source", 1, 3), F.lit(": the Password is Q"), (F.col("doc_id") * 7919).cast("string"), F.lit("! bye"))
    rows = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, said).otherwise(F.col("source")).alias("body"))
    return rows.select("id", password_hint(F.col("body")).alias("hint")).filter("hint <> ''")
