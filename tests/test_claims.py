"""Rule tables, claims of brands and what pages and documents carry, on odd values."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from posthound.operators import claims, documents, files, scripts

BRANDS = [("Acme", ["Acme", "Acme Pay"], ["acmepay.example"]), ("Other", ["Other Co"], ["otherco.example"])]


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame(BRANDS, "brand string, phrases array<string>, domains array<string>")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rules_of_files_and_wide_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rule": "r", "score": 1, "patterns": ["old"]}) + "\n" + json.dumps({"rule": "none", "patterns": []}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"rule": "r", "family": "F", "score": 95, "need": 2, "kinds": ["exe/"], "most": 100, "patterns": ["alpha", "b[e3]ta"]}) + "\n")
    rules = claims.bounded_rules(claims.read_rules(spark, str(tmp_path)))
    assert [(r.rule, r.score, r.need) for r in rules] == [("r", 95, 2)]
    both = "ALPHA b3ta"
    data = [(1, both.encode(), "exe/pe"), (2, both.encode("utf-16le"), "exe/pe"), (3, b"alpha", "exe/pe"), (4, both.encode(), "pdf"), (5, None, "exe/pe"), (6, both.encode() + b"x" * 100, "exe/pe"), (7, both.encode(), None), (8, b"\xff\x00", "exe/pe")]
    found = claims.scan(spark.createDataFrame([(i, None if d is None else bytearray(d), k) for i, d, k in data], "id int, data binary, kind string"), rules, kind="kind")
    assert rows(found) == [(1, "yara.r", "F", 95), (2, "yara.r", "F", 95)]
    assert claims.scan(spark.createDataFrame([(1, bytearray(b"x"))], "id int, data binary"), []).count() == 0
    with pytest.raises(ValueError):
        claims.bounded_rules(spark.range(3).select(F.col("id").cast("string").alias("rule")), 2)


def test_names_and_domains_of_brands(spark, brands):
    heads = [
        (1, "x@gmail.com", "ACME-Pay Support", None),
        (2, "x@mail.acmepay.example", "Acme Pay", None),
        (3, "x@shop.example", "acme", None),
        (4, "x@shop.example", "Acmeans", None),
        (5, "x@acrnepay.example", "Someone", None),
        (6, "x@shop.example", None, "y@acmepay-login.example"),
        (7, None, None, None),
        (8, "x@shop.example", "Our House board", None),
        (9, "x@our.example", "Our House", None),
    ]
    df = spark.createDataFrame(heads, "id int, from_addr string, from_display string, reply_to string")
    found = claims.brand_findings(df, brands, ("Our House",), ("our.example",)).select("id", "rule", "score")
    assert rows(found) == [
        (1, "headers.display_name_brand", 60),
        (3, "headers.display_name_brand", 45),
        (5, "headers.lookalike_brand", 65),
        (6, "headers.lookalike_brand", 65),
        (8, "headers.display_name_company", 40),
    ]
    links = [(1, "https://acrnepay.example/x"), (2, "https://acmepay.example/"), (3, "http://u@our.example.evil.net/"), (4, "https://0ur.example"), (5, "mailto:x@y"), (6, None), (7, "https://www.our.example/")]
    seen = spark.createDataFrame(links, "mail int, url string")
    assert rows(claims.imitating_urls(seen, brands, ("our.example",)).drop("url")) == [(1, "url.lookalike_brand", 70), (3, "url.lookalike_domain", 65), (4, "url.lookalike_domain", 70)]
    assert claims.imitating_urls(seen.limit(0), brands.limit(0)).count() == 0


def test_what_pages_carry(spark):
    program = base64.b64encode(b"MZ" + b"\0" * 61).decode()
    pages = [
        (1, f"<script>var a = atob('{program}'); b.download = 'x'</script>"),
        (2, f"<p>{program}</p>"),
        (3, "<p>" + base64.b64encode(b"only plain words, of no harm").decode() + "</p>"),
        (4, "<script>fetch('https://api.telegram.org/bot1/sendMessage')</script>"),
        (5, "<script>eval(unescape('x'))</script>"),
        (6, "<script>" + "\\x41" * 60 + " _0xabcd1" * 5 + "</script>"),
        (7, "\\x41" * 60),
        (8, None),
        (9, ""),
    ]
    found = scripts.html_findings(spark.createDataFrame(pages, "id int, html string"), "id", "html")
    assert rows(found) == [(1, "html.smuggling_payload", 85), (2, "html.embedded_payload", 70), (4, "html.exfil_channel", 65), (5, "html.obfuscated_script", 60), (6, "html.obfuscated_script", 45)]


def sheet(names: str, formula: str) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<definedNames>{names}</definedNames>")
        z.writestr("xl/macrosheets/sheet1.xml", f"<f>{formula}</f>")
    return bytearray(out.getvalue())


def test_macro_sheets_and_programs(spark):
    auto = '<definedName name="_xlnm.Auto_Open" hidden="1">x</definedName>'
    books = [(1, sheet(auto, "EXEC(&quot;x&quot;)")), (2, sheet("", "CALL(1)")), (3, sheet(auto, "SUM(1)")), (4, bytearray())]
    found = documents.office_findings(documents.features(spark.createDataFrame(books, "id int, data binary"), "office"))
    assert rows(found) == [(1, "office.xlm.autoexec", 80), (2, "office.xlm.suspicious", 50), (3, "office.xlm.macros", 40)]
    head = documents.samples()["pe"][0][1]
    rat = b"WSAStartup TcpClient IsDebuggerPresent BitBlt"
    programs = [(1, head + rat), (2, head + rat[:20]), (3, head + b"api.telegram.org"), (4, head + b"Login Data wallet.dat smtp.gmail.com")]
    found = documents.pe_findings(documents.features(spark.createDataFrame([(i, bytearray(d)) for i, d in programs], "id int, data binary"), "pe"), F.lit("2024-01-01").cast("timestamp"))
    assert [r for r in rows(found) if r[1] not in ("pe.executable_attachment", "pe.unsigned")] == [(1, "pe.rat_traits", 75), (3, "pe.exfil_channel", 45), (4, "pe.stealer_behavior", 85)]


def test_declared_types_and_notes(spark):
    parts = [("m", "a", None, "a.bin", "exe/pe", 0, False, "nested too deep", "image/png"), ("m", "b", None, "b.pdf", "exe/pe", 0, False, None, "application/pdf"), ("m", "c", None, "c", "pdf", 0, False, "size limit", None)]
    found = files.filetype_findings(spark.createDataFrame(parts, "mail string, id string, parent string, filename string, detected_type string, depth int, encrypted boolean, note string, declared string"))
    assert rows(found) == [("a", "filetype.content_type_mismatch", 30), ("a", "filetype.extraction_note", 0), ("b", "filetype.type_mismatch", 80), ("c", "filetype.extraction_limit", 30)]
