"""Rules on attachments: magic types, names against contents, archives, shared script indicators, generic pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.plans.registry import Registry
from posthound.session import spread
from posthound.sources import adapters as src

R = Registry()
#: Leading bytes in hexadecimal and the type they tell; earlier rows win.
MAGIC = (
    ("4D5A", "exe/pe"),
    ("7F454C46", "exe/elf"),
    ("504B0304", "archive/zip"),
    ("526172211A07", "archive/rar"),
    ("377ABCAF271C", "archive/7z"),
    ("1F8B", "archive/gzip"),
    ("425A68", "archive/bzip2"),
    ("FD377A585A00", "archive/xz"),
    ("4D534346", "archive/cab"),
    ("25504446", "pdf"),
    ("D0CF11E0A1B11AE1", "office/ole"),
    ("7B5C727466", "office/rtf"),
    ("4C0000000114020000000000C000000000000046", "lnk"),
    ("E4525C7B8CD8A74DAEB15378D02996D3", "office/onenote"),
    ("89504E47", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("47494638", "image/gif"),
    ("789F3E22", "mail/tnef"),
)
DANGEROUS = {"exe": 60, "scr": 65, "com": 60, "pif": 65, "bat": 55, "cmd": 55, "ps1": 55, "vbs": 60, "js": 55, "jse": 60, "wsf": 60, "hta": 65, "lnk": 60, "msi": 50, "jar": 45, "cpl": 60, "dll": 50}
DISK_IMAGES = ("iso", "img", "vhd", "vhdx", "udf")
DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "jpg", "jpeg", "png", "gif", "csv")
EXECUTABLE_TYPES = ("exe/pe", "exe/elf", "lnk")
BIDI = "[‪-‮⁦-⁩]"


def magic_type(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 24))
    out = F.lit(None).cast("string")
    for sign, kind in reversed(MAGIC):
        out = F.when(head.startswith(sign), F.lit(kind)).otherwise(out)
    text = F.lower(F.trim(F.try_to_binary(F.hex(F.substring(data, 1, 512)), F.lit("hex")).cast("string")))
    sniffed = (
        F.when(text.rlike(r"^(﻿)?<\s*(!doctype html|html|head|body|script)"), "text/html")
        .when(text.rlike(r"^(﻿)?(<\?xml[^>]*>\s*)?<svg"), "image/svg")
        .when(text.startswith("<?xml"), "text/xml")
        .when(text.rlike(r"^(from|received|return-path|mime-version|subject|to|date|message-id): "), "mail/eml")
        .when(F.length(data) == 0, "empty")
        .otherwise(F.lit("unknown"))
    )
    return F.coalesce(out, sniffed)


def extension(name: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def filetype_findings(rows: DataFrame) -> DataFrame:
    """id, rule, score of rows(id, mail, parent, filename, detected_type, depth, encrypted, note, and declared: the type its sender named, if known); names first, then contents."""
    name, kind = F.coalesce("filename", F.lit("")), F.coalesce("detected_type", F.lit("unknown"))
    # Each step by itself, so that none is worked out anew for every rule.
    rows = rows.withColumns({"_ext": extension(name), "_inner": extension(F.regexp_replace(F.lower(name), r"\s*\.[^.]*$", ""))})
    ext, inner = F.col("_ext"), F.col("_inner")
    rows = rows.withColumn("_bad", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for e in DANGEROUS.items() for x in e]), ext), F.lit(0)))
    bad_score = F.col("_bad")
    rtlo = name.rlike(BIDI)
    rows = rows.withColumn("_rtlo", rtlo)
    rtlo = F.col("_rtlo")
    double = ~rtlo & ((bad_score > 0) | ext.isin(*DISK_IMAGES)) & (inner.isin(*DOCUMENTS) | name.rlike(r"\s{5,}\.[^.]*$"))
    executable = (bad_score > 0) | kind.isin(*EXECUTABLE_TYPES)
    rows = rows.withColumn("_double", double)
    double = F.col("_double")
    in_archive = ~rtlo & ~double & (F.col("depth") > 0) & executable
    plain = ~rtlo & ~double & ~in_archive & (bad_score > 0)
    note = F.coalesce("note", F.lit(""))
    executable_type = kind.isin(*EXECUTABLE_TYPES)
    declared = F.lower("declared").rlike(r"^(image|audio|video|text)/|^application/(pdf|msword|rtf)") if "declared" in rows.columns else F.lit(False)
    mismatch = ext.isin(*DOCUMENTS) & kind.isin(*EXECUTABLE_TYPES)
    scored = lambda cond, rule, score: F.when(cond, F.struct(F.lit(rule).alias("rule"), (F.lit(score) if isinstance(score, int) else score).cast("int").alias("score")))
    found = [
        scored(rtlo, "filetype.rtlo", 80),
        scored(double, "filetype.double_extension", 75),
        scored(in_archive, "filetype.executable_in_archive", 65),
        scored(plain, "filetype.dangerous_extension", bad_score),
        scored(ext.isin(*DISK_IMAGES), "filetype.disk_image", 45),
        scored(mismatch, "filetype.type_mismatch", 80),
        scored(ext.isin(*DOCUMENTS) & kind.startswith("archive/") & ~ext.isin("docx", "xlsx", "pptx"), "filetype.type_mismatch", 40),
        scored((ext == "") & kind.isin(*EXECUTABLE_TYPES), "filetype.hidden_executable", 40),
        scored(declared & executable_type & ~mismatch, "filetype.content_type_mismatch", 30),
        scored(F.col("encrypted"), "filetype.encrypted_archive", 35),
        scored(note.contains("limit"), "filetype.extraction_limit", 30),
        scored((note != "") & ~note.contains("limit"), "filetype.extraction_note", 0),
        scored((F.col("depth") == 0) & kind.isin("text/html", "image/svg"), "filetype.html_attachment", 10),
    ]
    out = told(rows, "id", found)
    children = rows.filter(F.col("parent").isNotNull()).groupBy("mail", "parent").agg(F.count(F.lit(1)).alias("n"), F.bool_and(executable).alias("only"))
    # Not broadcast: Spark takes rows that were exploded from a small table for few.
    archives = rows.select("mail", "id").join(children.filter("only and n <= 5").select("mail", F.col("parent").alias("id"), "n").hint("merge"), ["mail", "id"])
    return out.unionByName(archives.select("id", F.lit("filetype.archive_only_executable").alias("rule"), F.when(F.col("n") == 1, 70).otherwise(60).alias("score")))


def tree_order(rows: DataFrame) -> DataFrame:
    """rows(mail, id) with `place`: children right after their parents, by the path that ids are."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("mail").orderBy(F.split("id", "/"))))


# --- pattern rules -------------------------------------------------------------------------------------------------------------

#: group: (score, patterns, matches needed). Wording of our own for techniques that public write-ups name.
INDICATORS: dict[str, tuple[int, tuple[str, ...], int]] = {
    "downloader": (80, (r"downloadstring|downloadfile|invoke-webrequest|urldownloadtofile|xmlhttp|bitsadmin", r"start-process|shellexecute|\binvoke-expression\b|\biex\b|wscript\.shell|\.run\b"), 2),
    "amsi_bypass": (85, (r"amsi(utils|initfailed|scanbuffer)",), 1),
    "defender_tamper": (80, (r"set-mppreference|disablerealtimemonitoring|add-mppreference",), 1),
    "shadow_delete": (85, (r"vssadmin\s+delete|shadowcopy\s+delete|bcdedit\s+/set",), 1),
    "credential_theft": (85, (r"sekurlsa|lsass\.dmp|login data\b|mimikatz",), 1),
    "reverse_shell": (80, (r"/dev/tcp/|nc\s+-e|net\.sockets\.tcpclient",), 1),
    "reflective_load": (70, (r"\[reflection\.assembly\]::load|assembly\.load\b",), 1),
    "lolbin": (70, (r"\b(mshta|regsvr32|rundll32|certutil|installutil|msbuild)(\.exe)?\b\s+\S*(http|/i:|,|-urlcache|javascript)",), 1),
    "privilege_escalation": (70, (r"fodhelper|eventvwr\.exe|seimpersonate",), 1),
    "powershell_encoded": (65, (r"-e(nc|ncodedcommand)?\s+[a-z0-9+/=]{20,}",), 1),
    "powershell_stealth": (45, (r"-w(indowstyle)?\s+hidden", r"-nop(rofile)?\b", r"-ep\s+bypass|-executionpolicy\s+bypass"), 1),
    "embedded_pe": (85, (r"tvqqaamaaaa|4d5a90000300",), 1),
    "persistence": (45, (r"currentversion\\run|schtasks\s+/create|new-scheduledtask",), 1),
    "dynamic_exec": (35, (r"\beval\s*\(|\bexecute\s*\(|new\s+function\s*\(",), 1),
    "com_objects": (30, (r"createobject\s*\(|activexobject\s*\(",), 1),
}


def pattern_findings(rows: DataFrame, key: str, text: str, prefix: str, rules: dict[str, tuple[int, tuple[str, ...], int]] = INDICATORS, more: tuple[Column, ...] = ()) -> DataFrame:
    """key, rule, score: each rule whose patterns match often enough in the lower-cased text; more are further findings, structs or null."""
    rows = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low, hits = F.col("_low"), list(more)
    for name, (score, patterns, least) in rules.items():
        n = sum((low.rlike(p).cast("int") for p in patterns[1:]), low.rlike(patterns[0]).cast("int"))
        hits.append(F.when(n >= least, F.struct(F.lit(f"{prefix}.{name}").alias("rule"), F.lit(score).alias("score"))))
    return told(rows, key, hits)


def told(rows: DataFrame, key: str, hits: list[Column]) -> DataFrame:
    """key, rule, score of those of hits (structs or null) that are not null.

    explode_outer of a plain array: Spark would work out explode's array twice, once to see if it is empty, and a filter() over it
    without generated code.
    """
    return rows.select(key, F.explode_outer(F.array(*hits)).alias("f")).filter("f is not null").select(key, "f.rule", "f.score")


FILES = (
    ("m", "a", None, "invoice‮fdp.exe", "exe/pe", 0, False, None),
    ("m", "b", None, "scan.pdf.exe", "exe/pe", 0, False, None),
    ("m", "c.zip", None, "c.zip", "archive/zip", 0, True, "limit: ratio"),
    ("m", "c.zip/run.js", "c.zip", "run.js", "text/plain", 1, False, None),
    ("m", "d", None, "disk.iso", "unknown", 0, False, None),
    ("m", "e", None, "report.pdf", "exe/pe", 0, False, None),
    ("m", "f", None, "page.html", "text/html", 0, False, None),
    ("m", "g", None, "blob", "exe/pe", 0, False, None),
    ("m", "h", None, "ok.docx", "archive/zip", 0, False, None),
    ("m", "i", None, "setup.exe", "exe/pe", 0, False, None),
)


def _mailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attachments above in one mail for every customer."""
    kinds = "parent string, filename string, detected_type string, depth int, encrypted boolean, note string"
    held = F.array(*[F.struct(F.lit(i).alias("part"), *[F.lit(v).cast(k.split(" ")[1]).alias(k.split(" ")[0]) for v, k in zip(rest, kinds.split(", "), strict=True)]) for _, i, *rest in FILES])
    mail = F.col("c_custkey").cast("string")
    own = lambda c: F.concat(mail, F.lit("/"), F.col(c))
    rows = spread(src.table(spark, sf_dir, "customer").select("c_custkey"), src.PER_TASK, "c_custkey").select("c_custkey", F.explode(held).alias("f"))
    return rows.select(mail.alias("mail"), own("f.part").alias("id"), own("f.parent").alias("parent"), "f.filename", "f.detected_type", "f.depth", "f.encrypted", "f.note")


@R.add(
    """SELECT CAST(c_custkey AS VARCHAR) || '/' || t.id AS id, rule, score FROM customer, (VALUES ('a', 'filetype.rtlo', 80), ('b', 'filetype.double_extension', 75), ('c.zip', 'filetype.encrypted_archive', 35), ('c.zip', 'filetype.extraction_limit', 30), ('c.zip', 'filetype.archive_only_executable', 70),
 ('c.zip/run.js', 'filetype.executable_in_archive', 65), ('d', 'filetype.disk_image', 45), ('e', 'filetype.type_mismatch', 80), ('f', 'filetype.html_attachment', 10), ('g', 'filetype.hidden_executable', 40), ('i', 'filetype.dangerous_extension', 60)) t(id, rule, score)"""
)
def filetype_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filetype_findings(_mailed(spark, sf_dir))


@R.add("SELECT CAST(c_custkey AS VARCHAR) || '/' || t.id AS id, CAST(place AS INTEGER) AS place FROM customer, (VALUES ('b', 2), ('a', 1), ('c.zip', 3), ('c.zip/run.js', 4), ('d', 5), ('e', 6), ('f', 7), ('g', 8), ('h', 9), ('i', 10)) t(id, place)")
def artifact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_order(_mailed(spark, sf_dir).select("mail", "id")).select("id", "place")


@R.add("SELECT page_id, CASE WHEN starts_with(lower(html), '<!doctype html') THEN 'text/html' ELSE 'unknown' END AS kind FROM pages", name="magic_type")
def magic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", magic_type(F.col("html").cast("binary")).alias("kind"))


SCRIPTS = (
    (1, "IEX (New-Object Net.WebClient).DownloadString('hxxp')"),
    (2, "powershell -w hidden -nop -enc QUJDREVGR0hJSktMTU5PUFFSU1RVVg=="),
    (3, "var a = new ActiveXObject('x'); eval(b)"),
    (4, "nothing here"),
    (5, "vssadmin delete shadows"),
    (6, "certutil -urlcache -f"),
)


@R.add(
    "SELECT c_custkey * 10 + t.id AS id, rule, score FROM customer, (VALUES (1, 'script.downloader', 80), (2, 'script.powershell_encoded', 65), (2, 'script.powershell_stealth', 45), (3, 'script.dynamic_exec', 35), (3, 'script.com_objects', 30), (5, 'script.shadow_delete', 85), (6, 'script.lolbin', 70)) t(id, rule, score)"
)
def indicator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_findings(src.over(spark, sf_dir, SCRIPTS), "id", "text", "script")


@R.add("SELECT page_id, 'html.tracker' AS rule, 5 AS score FROM pages WHERE regexp_matches(lower(html), 'track\\(') AND regexp_matches(lower(html), '<script')")
def pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_findings(src.table(spark, sf_dir, "pages"), "page_id", "html", "html", {"tracker": (5, (r"track\(", r"<script"), 2)})
