"""Text functions over Column expressions: defanging, redaction, neutralising, entropy and obfuscation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.operators.dml import clean, clip
from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()

EMAIL = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
IPV4 = r"\b([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\b"
BEARER = r"(?i)(bearer|basic) +[A-Za-z0-9._~+/=-]{8,}"
ASSIGNED = r"(?i)(password|passwd|secret|token|api_?key)( *[:=] *)[\"']?[^ \"']{4,}[\"']?"


def defang(text: Column) -> Column:
    """URLs, addresses and dotted hosts made inert: hxxp, [@], [.]."""
    text = F.regexp_replace(text, r"(?i)\bhttp(s?)://", "hxxp$1://")
    text = F.regexp_replace(text, EMAIL, "$1[@]$2")
    return F.regexp_replace(text, r"([A-Za-z0-9-])\.([A-Za-z0-9-])", "$1[.]$2")


_DEFANG_SQL = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\bhttp(s?)://', 'hxxp\1://', 'g'), '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '\1[@]\2', 'g'), '([A-Za-z0-9-])\.([A-Za-z0-9-])', '\1[.]\2', 'g')"


def redact(text: Column) -> Column:
    """Secrets, credentials, addresses and IPs masked, as logs show them."""
    text = F.regexp_replace(text, BEARER, "$1 ***")
    text = F.regexp_replace(text, ASSIGNED, "$1$2***")
    text = F.regexp_replace(text, EMAIL, "***@$2")
    return F.regexp_replace(text, IPV4, "$1.$2.*.*")


#: Words that would set off other scanners when a report quotes them.
LOUD = ("powershell", "cmd.exe", "wscript", "mshta", "rundll32", "frombase64string", "createobject", "javascript:", "vbscript:", "eval(")


def neutralise(text: Column, blob: int = 120) -> Column:
    """Loud words split by a middle dot and long base64-like runs cut; a second pass changes nothing."""
    for word in LOUD:
        cut = len(word) // 2
        quoted = lambda s: "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
        text = F.regexp_replace(text, f"(?i)({quoted(word[:cut])})({quoted(word[cut:])})", "$1·$2")
    return F.regexp_replace(text, f"([A-Za-z0-9+/]{{40}})[A-Za-z0-9+/=]{{{blob - 40},}}", "$1…")


def entropy_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, entropy: Shannon entropy in bits of each row's text; empty and null texts 0. Nothing is exploded or shuffled."""
    text = F.coalesce(F.col(text), F.lit(""))
    total = F.length(text)
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: total - F.length(F.replace(text, c, F.lit(""))))
    weighted = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * F.log2(n))
    return rows.select(key, F.when(total > 0, F.round(F.log2(F.greatest(total, F.lit(1))) - weighted / total, 6)).otherwise(F.lit(0.0)).alias("entropy"))


def obfuscation(text: Column) -> dict[str, Column]:
    """Shares and counts that tell obfuscated script from prose."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.round((F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n, 6)
    return {
        "chars": F.length(text).cast("long"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "symbol_share": share(r"[^A-Za-z0-9 \n\t]"),
        "space_share": share(r"[ \n\t]"),
        "escapes": F.regexp_count(text, F.lit(r"\\x[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}")).cast("long"),
        "concats": F.regexp_count(text, F.lit(r"[\"'] *[+&] *[\"']")).cast("long"),
        "long_runs": F.regexp_count(text, F.lit(r"[A-Za-z0-9+/=]{60,}")).cast("long"),
        "longest_line": F.array_max(F.transform(F.split(text, "\n"), F.length)).cast("long"),
    }


def _share_sql(pattern: str) -> str:
    return f"round(CAST(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')) AS DOUBLE) / greatest(length(t), 1), 6)"


def printable_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")) / n).otherwise(F.lit(1.0))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


DOCS = "documents"


@R.add(f"SELECT doc_id, {_DEFANG_SQL.format('text')} AS text FROM documents")
def defang_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, DOCS).select("doc_id", defang(F.col("text")).alias("text"))


@R.add(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer|basic) +[A-Za-z0-9._~+/=-]{8,}', '\1 ***', 'g'),
 '(?i)(password|passwd|secret|token|api_?key)( *[:=] *)["'']?[^ "'']{4,}["'']?', '\1\2***', 'g'), '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '***@\2', 'g'),
 '\b([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\b', '\1.\2.*.*', 'g') AS text FROM documents"""
)
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, DOCS).select("doc_id", redact(F.col("text")).alias("text"))


@R.add(
    f"""SELECT doc_id, length(t) AS chars, {_share_sql("[0-9]")} AS digit_share, {_share_sql("[A-Z]")} AS upper_share, {_share_sql(r"[^A-Za-z0-9 \n\t]")} AS symbol_share, {_share_sql(r"[ \n\t]")} AS space_share,
 len(regexp_extract_all(t, '\\\\x[0-9a-fA-F]{{2}}|%[0-9a-fA-F]{{2}}')) AS escapes, len(regexp_extract_all(t, '["''] *[+&] *["'']')) AS concats, len(regexp_extract_all(t, '[A-Za-z0-9+/=]{{60,}}')) AS long_runs,
 list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS longest_line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def obfuscation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, DOCS).select("doc_id", *[c.alias(n) for n, c in obfuscation(F.col("text")).items()])


@R.add(
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), k AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL)
SELECT d.doc_id, coalesce(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6), 0) AS entropy FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
)
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_rows(src.table(spark, sf_dir, DOCS), "doc_id", "text")


@R.add("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return src.table(spark, sf_dir, DOCS).select("doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@R.add("SELECT sha256(text) AS sha256, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text) HAVING count(*) >= 2")
def doc_hash_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, DOCS).withColumn("sha256", F.sha2("text", 256))
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).filter("n >= 2")


@R.add("SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) AS t FROM documents)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, DOCS).select("doc_id", clip(F.trim(F.regexp_replace(clean(F.col("text")), r"[ \n\t]+", " ")), 80).alias("snippet"))


@R.add()
def neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", neutralise(F.col("html")).alias("html"))
