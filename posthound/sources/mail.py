"""Raw messages to rows: headers, bodies, links and the tree of attachments, with bounded recursive extraction.

One Arrow batch of raw messages goes in, one struct per message comes out; relations are cut from it with native operators.
A message that cannot be read gives a row with its errors, never an exception.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from email import message_from_bytes, policy
from email.header import decode_header
from email.utils import getaddresses
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from posthound.operators.files import magic_type
from posthound.plans.registry import Registry
from posthound.session import small_batches
from posthound.sources import adapters as src

R = Registry()
#: Bytes of an attachment that travel on to the scanners.
MAX_SCANNED = 8 << 20
#: Characters of pages, or characters and bytes of mails, that a task gathers before it hands on what it read of them; and mails at most.
BATCH_CHARS, BATCH_ROWS = 2_000_000, 5_000
ARTIFACT = "struct<id:string,parent:string,filename:string,depth:int,size:bigint,sha256:string,md5:string,encrypted:boolean,listing_only:boolean,note:string,data:binary>"
PARSED = f"message_id string, subject string, from_addr string, from_display string, reply_to string, recipients array<string>, return_path string, headers array<struct<name:string,value:string>>, body_text string, body_html string, artifacts array<{ARTIFACT}>, errors array<string>"


@dataclass
class Budget:
    """What the extraction of one message may use, shared by all its containers."""

    bytes: int = 300 << 20
    count: int = 500
    depth: int = 4
    ratio: int = 200
    floor: int = 1 << 20
    seen: set = field(default_factory=set)

    def take(self, n: int) -> bool:
        if self.count <= 0 or n > self.bytes:
            return False
        self.count, self.bytes = self.count - 1, self.bytes - n
        return True


class Links(HTMLParser):
    """Visible text, links with their texts, and a few features of a page."""

    QUIET = {"script", "style", "template", "noscript", "title"}
    SOURCES = {"a": "href", "area": "href", "link": "href", "form": "action", "base": "href", "object": "data", "body": "background"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str, str, str]] = []
        self.quiet = self.forms = self.passwords = self.scripts = self.iframes = 0
        self.refresh = ""
        self.open: list | None = None

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.quiet += tag in self.QUIET
        self.forms += tag == "form"
        self.scripts += tag == "script"
        self.iframes += tag == "iframe"
        self.passwords += tag == "input" and own.get("type", "").lower() == "password"
        if tag == "meta" and own.get("http-equiv", "").lower() == "refresh":
            m = re.search(r"url\s*=\s*['\"]?([^'\";]+)", own.get("content", ""), re.I)
            self.refresh = m[1].strip() if m else ""
            if self.refresh:
                self.links.append((self.refresh, "refresh", ""))
        for name in {self.SOURCES.get(tag), "src"}:
            if name and own.get(name, "").strip():
                self.links.append((own[name].strip(), tag, ""))
                if tag == "a":
                    self.open = [len(self.links) - 1, []]

    def handle_endtag(self, tag):
        if tag in self.QUIET and self.quiet:
            self.quiet -= 1
        if tag == "a" and self.open:
            at, shown = self.open
            self.links[at] = (*self.links[at][:2], " ".join("".join(shown).split()))
            self.open = None

    def handle_data(self, data):
        if not self.quiet:
            self.text.append(data)
            if self.open:
                self.open[1].append(data)


def read_html(html: str | None) -> Links:
    reader = Links()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader


def decode_words(value: str | None) -> str:
    """RFC 2047 words, leniently: unknown charsets fall back to UTF-8, then Windows-1252, then Latin-1."""
    out = []
    try:
        for part, charset in decode_header(value or ""):
            if isinstance(part, str):
                out.append(part)
                continue
            for name in (charset, "utf-8", "cp1252", "latin-1"):
                try:
                    out.append(part.decode(name))
                    break
                except (LookupError, UnicodeDecodeError, TypeError):
                    continue
    except ValueError:
        return value or ""
    return "".join(out)


def _members(name: str, data: bytes, passwords: list[str], budget: Budget) -> Iterator[tuple[str, bytes | None, bool, str]]:
    """(label, bytes or None if only listed, encrypted, note) of one container's members; nothing for other files."""
    limit = max(budget.floor, budget.ratio * len(data))
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            total = 0
            for info in z.infolist():
                if info.is_dir():
                    continue
                locked = bool(info.flag_bits & 1)
                total += info.file_size
                if total > min(limit, budget.bytes):
                    yield info.filename, None, locked, "limit: size"
                    continue
                for word in [None, *passwords] if locked else [None]:
                    try:
                        yield info.filename, z.read(info, pwd=word.encode() if word else None), locked, ""
                        break
                    except (RuntimeError, zipfile.BadZipFile, NotImplementedError, OSError):
                        continue
                else:
                    yield info.filename, None, locked, "password"
    elif data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00":
        opener = gzip.GzipFile if data[:2] == b"\x1f\x8b" else bz2.BZ2File if data[:3] == b"BZh" else lzma.LZMAFile
        with opener(io.BytesIO(data)) as f:
            out = f.read(min(limit, budget.bytes) + 1)
        label = re.sub(r"\.(gz|bz2|xz|tgz)$", "", name.rsplit("/", 1)[-1], flags=re.I) or "data"
        yield label, None if len(out) > min(limit, budget.bytes) else out, False, "limit: ratio" if len(out) > min(limit, budget.bytes) else ""
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile():
                    f = t.extractfile(m)
                    yield (m.name, f.read() if f and m.size <= min(limit, budget.bytes) else None, False, "" if m.size <= limit else "limit: size")
    elif data[:6] in (b"Rar!\x1a\x07", b"7z\xbc\xaf\x27\x1c"):
        yield "contents", None, False, "unsupported"


def expand(name: str, data: bytes, parent: str | None, depth: int, passwords: list[str], budget: Budget) -> Iterator[dict]:
    """An attachment and, right after it, what it contains, depth first."""
    label = name.replace("\\", "/").replace("..", "_").lstrip("/") or "unnamed"
    own = f"{parent}/{label}" if parent else label
    k = 2
    while own in budget.seen:
        own, k = f"{parent + '/' if parent else ''}{label}~{k}", k + 1
    budget.seen.add(own)
    row = {"id": own, "parent": parent, "filename": name, "depth": depth, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "md5": hashlib.md5(data).hexdigest(), "encrypted": False, "listing_only": False, "note": "", "data": data[:MAX_SCANNED]}
    yield row
    if depth >= budget.depth:
        return
    try:
        for inner, content, locked, note in _members(name, data, passwords, budget):
            row["encrypted"] = row["encrypted"] or locked
            if note and note not in row["note"]:
                row["note"] = "; ".join(filter(None, [row["note"], note]))
            if content is not None and budget.take(len(content)):
                yield from expand(inner, content, own, depth + 1, passwords, budget)
            else:
                yield {"id": f"{own}/{inner}", "parent": own, "filename": inner, "depth": depth + 1, "size": 0, "sha256": "", "md5": "", "encrypted": locked, "listing_only": True, "note": note or "limit: count", "data": b""}
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, ValueError, RuntimeError) as e:
        row["note"] = "; ".join(filter(None, [row["note"], f"broken: {type(e).__name__}"]))


PASSWORD_WORD = re.compile(r"(?:password|passcode|clave|senha|contraseña)\s*(?:is|es|:|=)?\s*[\"']?([^\s\"']{3,40})", re.I)


def parse_message(raw: bytes | None) -> dict:
    out: dict = {n: "" for n in ("message_id", "subject", "from_addr", "from_display", "reply_to", "return_path", "body_text", "body_html")}
    out |= {"recipients": [], "headers": [], "artifacts": [], "errors": []}
    try:
        m = message_from_bytes(raw or b"", policy=policy.compat32)
        out["headers"] = [{"name": str(k), "value": decode_words(str(v))} for k, v in m.items()][:2000]
        first = lambda n: next((h["value"] for h in out["headers"] if h["name"].lower() == n), "")
        address = lambda v: [(d, a.lower()) for d, a in getaddresses([v]) if a] if v else []
        sender = address(first("from"))[:1]
        out |= {"message_id": first("message-id").strip(), "subject": first("subject"), "from_addr": sender[0][1] if sender else "", "from_display": sender[0][0] if sender else ""}
        out["reply_to"] = next((a for _, a in address(first("reply-to"))), "")
        out["return_path"] = next((a for _, a in address(first("return-path"))), "")
        out["recipients"] = [a for h in ("to", "cc") for _, a in address(first(h))][:500]
        files = []
        for part in m.walk():
            if part.is_multipart():
                continue
            data = part.get_payload(decode=True) or b""
            name, kind = part.get_filename(), part.get_content_type()
            if name is None and kind in ("text/plain", "text/html") and part.get_content_disposition() != "attachment":
                slot = "body_text" if kind == "text/plain" else "body_html"
                out[slot] += data.decode("utf-8", "replace") if not part.get_content_charset() else _decoded(data, part.get_content_charset())
            else:
                files.append((decode_words(name) or f"part{len(files)}", data))
        words = list(dict.fromkeys(PASSWORD_WORD.findall(f"{out['subject']} {out['body_text']} {' '.join(read_html(out['body_html']).text)}")))[:20] if files else []
        budget = Budget()
        for name, data in files:
            if budget.take(len(data)):
                out["artifacts"] += list(expand(name, data, None, 0, words, budget))
    except Exception as e:  # a broken message is a row, not a failed job
        out["errors"].append(f"{type(e).__name__}: {e}"[:300])
    return out


def _decoded(data: bytes, charset: str) -> str:
    for name in (charset, "utf-8", "cp1252"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def parse(messages: DataFrame, key: str = "remote_id", raw: str = "raw") -> DataFrame:
    """key and the parsed columns of messages(key, raw)."""
    small_batches(messages.sparkSession)
    out = f"{key} {dict(messages.dtypes)[key]}, {PARSED}"
    schema = to_arrow_schema(_parse_datatype_string(out), timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k, r in zip(*batch.columns, strict=True):
                rows.append({key: k.as_py()} | parse_message(r.as_py()))
                size += len(rows[-1]["body_text"]) + len(rows[-1]["body_html"]) + sum(len(a["data"]) for a in rows[-1]["artifacts"])
                if size > BATCH_CHARS or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return messages.select(key, raw).mapInArrow(run, out)


def artifacts(parsed: DataFrame, key: str = "remote_id") -> DataFrame:
    """One row per attachment at any depth, with its detected type; position is depth-first order."""
    rows = parsed.select(key, F.posexplode("artifacts").alias("position", "a")).select(key, "position", "a.*")
    return rows.withColumn("detected_type", magic_type(F.col("data")))


def header_only(messages: DataFrame, most: int, raw: str = "raw") -> DataFrame:
    """Oversize messages cut to their headers, marked truncated, with their size."""
    text = F.col(raw)
    size = F.octet_length(text)
    at = F.least(*[F.when(F.position(F.lit(b), text.cast("string")) > 0, F.position(F.lit(b), text.cast("string"))).otherwise(F.lit(2**31 - 1)) for b in ("\r\n\r\n", "\n\n")])
    cut = F.encode(F.substring(text.cast("string"), 1, 65536).substr(F.lit(1), F.least(at, F.lit(65536))), "utf-8")
    return messages.withColumns({"truncated": size > most, "original_size": size.cast("long"), raw: F.when(size > most, cut).otherwise(text)})


def read_directory(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A folder of .eml files as messages(remote_id, received_at, raw)."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").option("latestFirst", "false") if stream else spark.read
    rows = reader.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.concat(name, F.lit("@"), F.unix_micros("modificationTime").cast("string")).alias("remote_id"), F.col("modificationTime").alias("received_at"), F.col("content").alias("raw"))


def _samples() -> list[tuple[str, bytes]]:
    from email.message import EmailMessage

    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("run.exe", b"M" + b"Z" + b"\0" * 60)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("note.txt", "hello")
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = "Jörg <A@Shop.Example>", "b@corp.example, c@corp.example", "Factura ñ", "<1@shop>"
    m.set_content("see https://shop.example/x, password: abc123")
    m.add_alternative("<p>Hi <a href='https://evil.example/a'>shop.example</a></p><script>x()</script>", subtype="html")
    m.add_attachment(outer.getvalue(), maintype="application", subtype="zip", filename="docs.zip")
    return [("1", m.as_bytes()), ("2", b""), ("3", b"Subject: =?utf-8?q?caf=C3=A9?=\n\nplain\n"), ("4", b"\xff\xfe broken")]


def document_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remote_id, raw: every document as the text of a plain mail."""
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("From: Writer <s"), k, F.lit("@Shop.example>\r\nTo: a@corp.example, b"), k, F.lit("@corp.example\r\nSubject: doc "), k, F.lit(" of "), "source", F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    return src.table(spark, sf_dir, "documents").select(k.alias("remote_id"), F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("raw"))


@R.add("SELECT CAST(doc_id AS VARCHAR) AS remote_id, 'doc ' || doc_id || ' of ' || source AS subject, 's' || doc_id || '@shop.example' AS from_addr, 0 AS n_artifacts, 2 AS n_to FROM documents")
def mime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(document_mails(spark, sf_dir)).select("remote_id", "subject", "from_addr", F.size("artifacts").alias("n_artifacts"), F.size("recipients").alias("n_to"))


@R.add("SELECT n_nationkey, t.id, detected_type, depth FROM nation, (VALUES ('docs.zip', 'archive/zip', 0), ('docs.zip/inner.zip', 'archive/zip', 1), ('docs.zip/inner.zip/run.exe', 'exe/pe', 2), ('docs.zip/note.txt', 'unknown', 1)) t(id, detected_type, depth)")
def zip_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail with an archive in an archive, once for every nation."""
    mails = src.table(spark, sf_dir, "nation").select("n_nationkey", F.lit(bytearray(_samples()[0][1])).alias("raw"))
    return artifacts(parse(mails, "n_nationkey"), "n_nationkey").select("n_nationkey", "id", "detected_type", "depth")


def html_facts(pages: DataFrame, key: str, html: str, also: tuple[str, ...] = ()) -> DataFrame:
    """key, text, links (url, source, shown: all that differ), forms, passwords, scripts, iframes, refresh of each page, and its columns `also`."""
    small_batches(pages.sparkSession)
    kind, names = dict(pages.dtypes), [key, "text", "links", "forms", "passwords", "scripts", "iframes", "refresh"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size, first = [], 0, 0
            for i, (k, h) in enumerate(zip(pdf[key], pdf[html], strict=True)):
                r = read_html(h)
                rows.append((k, " ".join(" ".join(r.text).split()), list(dict.fromkeys(r.links)), r.forms, r.passwords, r.scripts, r.iframes, r.refresh))
                size += len(h or "")
                if size > BATCH_CHARS or i + 1 == len(pdf):
                    out = pd.DataFrame(rows, columns=names)
                    yield out.assign(**{c: pdf[c].iloc[first : i + 1].to_numpy() for c in also})
                    rows, size, first = [], 0, i + 1

    carried = "".join(f", {c} {kind[c]}" for c in also)
    return pages.select(key, html, *[c for c in also if c not in (key, html)]).mapInPandas(run, f"{key} {kind[key]}, text string, links array<struct<url:string,source:string,shown:string>>, forms int, passwords int, scripts int, iframes int, refresh string{carried}")


@R.add("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) > 0 AS BOOLEAN) AS has_links, CAST(len(regexp_extract_all(html, '<script')) AS INTEGER) AS scripts FROM pages")
def html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = html_facts(src.table(spark, sf_dir, "pages"), "page_id", "html")
    return facts.select("page_id", F.exists("links", lambda x: x["source"] == "a").alias("has_links"), "scripts")


@R.add()
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_facts(src.table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.source", "l.shown")


@R.add()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_facts(src.table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "text")
