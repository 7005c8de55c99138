"""Document and program formats: bounded readers that turn bytes into features, and rules as Column expressions over them.

The readers run as Arrow batches (binary parsing has no native operator); a broken file gives features with `broken` set.
"""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.operators.files import EXECUTABLE_TYPES, magic_type
from posthound.plans.registry import Registry
from posthound.sources import adapters as src

R = Registry()
MAX_INFLATED = 20 << 20

# --- readers -------------------------------------------------------------------------------------------------------------------


def pdf_features(data: bytes) -> dict:
    """Counts of the names that matter, with #xx escapes read and streams inflated within a bound."""
    names = re.findall(rb"/[A-Za-z0-9#_.+-]{1,60}", data)
    escaped = sum(b"#" in n for n in names)
    text, room = [data], MAX_INFLATED
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        if room <= 0:
            break
        try:
            out = zlib.decompressobj().decompress(m[1], room)
        except zlib.error:
            continue
        room -= len(out)
        text.append(out)
    whole = b"\n".join(text)
    plain = [re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), n) for n in re.findall(rb"/[A-Za-z0-9#_.+-]{1,60}", whole)]
    n = Counter(plain)
    end = data.rfind(b"%%EOF")
    files = [f.decode("latin-1") for f in re.findall(rb"/(?:F|UF)\s*\(([^()]{1,200})\)", whole)]
    return {
        "javascript": n[b"/JavaScript"] + n[b"/JS"],
        "autorun": n[b"/OpenAction"] + n[b"/AA"],
        "launch": n[b"/Launch"],
        "embedded": n[b"/EmbeddedFile"] + n[b"/EmbeddedFiles"],
        "richmedia": n[b"/RichMedia"],
        "submit": n[b"/SubmitForm"],
        "encrypted": n[b"/Encrypt"],
        "remote_goto": n[b"/GoToR"] + n[b"/GoToE"],
        "escaped_names": escaped,
        "uris": [u.decode("latin-1") for u in dict.fromkeys(re.findall(rb"/URI\s*\(([^()]{1,2000})\)", whole))][:200],
        "filenames": files[:50],
        "appended": max(0, len(data) - end - 6) if end >= 0 else 0,
        "broken": not data.startswith(b"%PDF") or end < 0,
    }


def lnk_features(data: bytes) -> dict:
    """Target, arguments and icon of a shell link."""
    out = {"target": "", "arguments": "", "icon": "", "trailing": 0, "broken": True}
    if len(data) < 76 or data[:4] != b"\x4c\0\0\0":
        return out
    flags = struct.unpack_from("<I", data, 20)[0]
    at = 76
    try:
        if flags & 1:
            at += 2 + struct.unpack_from("<H", data, at)[0]
        if flags & 2:
            size, _, info, _, local = struct.unpack_from("<IIIII", data, at)
            if info & 1 and local:
                out["target"] = data[at + local : data.index(b"\0", at + local)].decode("latin-1")
            at += size
        wide = bool(flags & 0x80)
        for bit, name in ((4, "name"), (8, "relative"), (16, "folder"), (32, "arguments"), (64, "icon")):
            if flags & bit:
                n = struct.unpack_from("<H", data, at)[0]
                raw = data[at + 2 : at + 2 + n * (1 + wide)]
                at += 2 + n * (1 + wide)
                value = raw.decode("utf-16le" if wide else "latin-1", "replace")
                if name in out:
                    out[name] = value
                elif name == "relative" and not out["target"]:
                    out["target"] = value
        while at + 4 <= len(data):
            n = struct.unpack_from("<I", data, at)[0]
            at += max(n, 4)
            if n < 4:
                break
        out["trailing"], out["broken"] = max(0, len(data) - at), False
    except (struct.error, ValueError):
        pass
    return out


def shannon(data: bytes) -> float:
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


#: Capability and the import or text names that show it (names of public system interfaces).
CAPABILITIES = {
    "injection": (b"VirtualAllocEx", b"WriteProcessMemory", b"CreateRemoteThread", b"NtUnmapViewOfSection", b"SetThreadContext"),
    "keylogging": (b"SetWindowsHookEx", b"GetAsyncKeyState", b"GetKeyState"),
    "stealing": (b"CryptUnprotectData", b"Login Data", b"logins.json", b"wallet.dat"),
    "anti_analysis": (b"IsDebuggerPresent", b"CheckRemoteDebuggerPresent", b"VBoxService", b"vmtoolsd"),
    "control": (b"WSAStartup", b"TcpClient", b"GetStream", b"client_id"),
    "plugin": (b"Plugin.Run", b"LoadPlugin", b"savePlugin"),
    "capture": (b"capCreateCaptureWindow", b"CopyFromScreen", b"BitBlt"),
    "stay": (b"CurrentVersion\\Run", b"schtasks"),
    "exfil": (b"api.telegram.org", b"discord.com/api/webhooks", b"smtp.gmail.com", b"ftp://", b"SmtpClient"),
    "ransom": (b"vssadmin delete", b"CryptEncrypt", b"wbadmin delete", b"bcdedit /set"),
}


def pe_features(data: bytes) -> dict:
    """Machine, section count and entropy, signature, overlay and capabilities of a program."""
    out: dict = {"machine": 0, "sections": 0, "max_entropy": 0.0, "timestamp": 0, "signed": False, "dotnet": False, "overlay": 0, "inner_pe": False, "broken": True} | {k: 0 for k in CAPABILITIES}
    for k, words in CAPABILITIES.items():
        out[k] = sum(w in data or w.decode().encode("utf-16le") in data for w in words)
    try:
        if data[:2] != b"MZ":
            return out
        at = struct.unpack_from("<I", data, 60)[0]
        if data[at : at + 4] != b"PE\0\0":
            return out
        out["machine"], out["sections"], out["timestamp"] = struct.unpack_from("<HHI", data, at + 4)
        optional = struct.unpack_from("<H", data, at + 20)[0]
        magic = struct.unpack_from("<H", data, at + 24)[0]
        folders = at + 24 + (112 if magic == 0x20B else 96)
        if optional >= folders - at - 24 + 8 * 15:
            out["signed"] = struct.unpack_from("<I", data, folders + 8 * 4 + 4)[0] > 0
            out["dotnet"] = struct.unpack_from("<I", data, folders + 8 * 14 + 4)[0] > 0
        end = 0
        for i in range(min(out["sections"], 96)):
            size, start = struct.unpack_from("<II", data, at + 24 + optional + 40 * i + 16)
            out["max_entropy"] = max(out["max_entropy"], shannon(data[start : start + min(size, 1 << 20)]))
            end = max(end, start + size)
        out["overlay"] = max(0, len(data) - end) if end else 0
        out["inner_pe"] = b"This program cannot be run" in data[max(end, at + 512) :]
        out["broken"] = False
    except struct.error:
        pass
    return out


AUTO = re.compile(r"\b(auto_?open|document_open|workbook_open|auto_?close|document_close|autoexec)\b", re.I)
DANGER = re.compile(r"\b(shell|createobject|wscript|powershell|urldownloadtofile|xmlhttp|callbyname|environ)\b", re.I)


#: Names that run a macro sheet on opening, and functions of its formulas that start or load programs.
XLM_AUTO = re.compile(r"<definedName\b[^>]*name=\"(_xlnm\.)?auto_(open|close|activate)", re.I)
XLM_CALLS = re.compile(r"\b(exec|call|register|run|formula\.fill|fopen|fwrite|urldownloadtofile)\s*\(", re.I)


def office_features(data: bytes) -> dict:
    """Macros, automatic names, external templates, DDE, embedded objects and equation or moniker exploits in office files."""
    out: dict = {"kind": "unknown", "macros": False, "auto": False, "danger": False, "external": [], "dde": False, "objects": 0, "activex": False, "equation": False, "xlm": False, "xlm_auto": False, "xlm_calls": False, "moniker": False, "encrypted": False, "broken": False}
    texts: list[str] = []
    if data[:4] == b"PK\x03\x04":
        out["kind"] = "ooxml"
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                room = MAX_INFLATED
                for info in z.infolist():
                    name = info.filename.lower()
                    out["macros"] |= name.endswith("vbaproject.bin")
                    out["activex"] |= "/activex/" in name
                    out["objects"] += "/embeddings/" in name
                    if info.file_size > room or not name.endswith((".xml", ".rels", ".bin")):
                        continue
                    room -= info.file_size
                    part = z.read(info)
                    texts.append(part.decode("latin-1"))
                    if "/macrosheets/" in name:
                        out["xlm"] = True
                        out["xlm_calls"] |= bool(XLM_CALLS.search(texts[-1]))
                    out["xlm_auto"] |= name.endswith("workbook.xml") and bool(XLM_AUTO.search(texts[-1]))
                    if name.endswith(".rels"):
                        for tag in re.findall(r"<Relationship\b[^>]*>", part.decode("utf-8", "replace")):
                            if 'TargetMode="External"' in tag and (m := re.search(r'Target="([^"]*)"', tag)):
                                kind = re.search(r'Type="[^"]*/([A-Za-z]+)"', tag)
                                out["external"].append(f"{kind[1] if kind else ''} {m[1]}")
        except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError, zlib.error):
            out["broken"] = True
    elif data[:5] == b"{\\rtf":
        out["kind"] = "rtf"
        raw = data.decode("latin-1")
        hexed = re.sub(r"[^0-9a-fA-F]", "", "".join(re.findall(r"\\objdata\b([^{}\\]*)", raw)))
        texts += [raw, bytes.fromhex(hexed[: len(hexed) // 2 * 2]).decode("latin-1")]
        out["objects"] = raw.count("\\object")
    elif data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        out["kind"] = "ole"
        texts += [data.decode("latin-1"), data.replace(b"\0", b"").decode("latin-1")]
        out["macros"] = "VBA" in texts[1] or "_VBA_PROJECT" in texts[1]
        out["encrypted"] = "EncryptedPackage" in texts[1]
        out["objects"] = texts[1].count("ObjectPool")
    whole = "\n".join(texts)
    out["auto"], out["danger"] = bool(AUTO.search(whole)), bool(DANGER.search(whole))
    out["dde"] = bool(re.search(r"\bDDE(AUTO)?\b\s", whole))
    out["equation"] = "Equation.3" in whole or "equation.3" in whole
    out["moniker"] = "\xe0\xc9\xea\x79\xf9\xba\xce\x11\x8c\x82\x00\xaa\x00\x4b\xa9\x0b" in whole
    out["external"] = out["external"][:50]
    return out


def onenote_features(data: bytes) -> dict:
    """Embedded files of a notebook: how many, and the first bytes of each."""
    guid, heads = bytes.fromhex("e716e3bd65261145a4c48d4d0b7a9eac"), []
    for m in re.finditer(re.escape(guid), data):
        if len(heads) == 1000:
            break
        try:
            n = struct.unpack_from("<Q", data, m.start() + 16)[0]
        except struct.error:
            break
        heads.append(data[m.start() + 36 : m.start() + 36 + min(n, 512)])
    names = [w.decode("utf-16le", "replace") for w in re.findall(rb"(?:[\x20-\x7e]\0){3,80}\.\0(?:[a-zA-Z0-9]\0){2,4}", data)]
    return {"objects": heads, "names": names[:200]}


READERS = {
    "pdf": (pdf_features, "javascript int, autorun int, launch int, embedded int, richmedia int, submit int, encrypted int, remote_goto int, escaped_names int, uris array<string>, filenames array<string>, appended long, broken boolean"),
    "lnk": (lnk_features, "target string, arguments string, icon string, trailing long, broken boolean"),
    "pe": (pe_features, "machine int, sections int, max_entropy double, timestamp long, signed boolean, dotnet boolean, overlay long, inner_pe boolean, broken boolean, " + ", ".join(f"{k} int" for k in CAPABILITIES)),
    "office": (office_features, "kind string, macros boolean, auto boolean, danger boolean, external array<string>, dde boolean, objects int, activex boolean, equation boolean, xlm boolean, xlm_auto boolean, xlm_calls boolean, moniker boolean, encrypted boolean, broken boolean"),
    "onenote": (onenote_features, "objects array<binary>, names array<string>"),
}


def features(rows: DataFrame, reader: str, key: str = "id", data: str = "data") -> DataFrame:
    """key and the reader's features of rows(key, data)."""
    read, schema = READERS[reader]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{key: k} | read(bytes(d or b"")) for k, d in zip(pdf[key], pdf[data], strict=True)], columns=[key, *names])

    return rows.select(key, data).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {schema}")


# --- rules ---------------------------------------------------------------------------------------------------------------------

LOLBINS = r"(?i)(powershell|cmd|wscript|cscript|mshta|rundll32|regsvr32|certutil|bitsadmin|msiexec)(\.exe)?\b"
SCRIPT_NAME = r"(?i)\.(js|jse|vbs|vbe|wsf|hta|ps1|bat|cmd)$"


def _hits(rows: DataFrame, key: str, found: list[tuple[Column, str, int | Column]]) -> DataFrame:
    parts = [F.when(cond, F.struct(F.lit(rule).alias("rule"), (F.lit(s) if isinstance(s, int) else s).cast("int").alias("score"))) for cond, rule, s in found]
    return rows.select(key, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("f")).select(key, "f.rule", "f.score")


def pdf_findings(f: DataFrame, key: str = "id") -> DataFrame:
    c = F.col
    unsafe = F.exists("filenames", lambda n: n.rlike(r"(?i)\.(docm|xlsm|pptm|xll|html?|svg|zip|rar|7z|one|rtf)$"))
    risky = F.exists("filenames", lambda n: n.rlike(r"(?i)\.(exe|scr|js|vbs|bat|lnk|iso|hta|cmd)$"))
    return _hits(
        f,
        key,
        [
            ((c("javascript") > 0) & (c("autorun") > 0), "pdf.javascript_autorun", 65),
            ((c("javascript") > 0) & (c("autorun") == 0), "pdf.javascript", 35),
            (c("launch") > 0, "pdf.launch", 75),
            ((c("embedded") > 0) & risky, "pdf.embedded_executable", 70),
            ((c("embedded") > 0) & ~risky & unsafe, "pdf.embedded_risky", 30),
            ((c("embedded") > 0) & ~risky & ~unsafe, "pdf.embedded_file", 0),
            (c("richmedia") > 0, "pdf.richmedia", 30),
            (c("remote_goto") > 0, "pdf.remote_goto", 40),
            (c("submit") > 0, "pdf.submit_form", 10),
            (c("escaped_names") >= 3, "pdf.name_obfuscation", 30),
            (c("appended") > 1024, "pdf.appended_payload", 30),
            (c("encrypted") > 0, "pdf.encrypted", 0),
            (c("broken"), "pdf.parse_error", 0),
        ],
    )


def lnk_findings(f: DataFrame, key: str = "id") -> DataFrame:
    c = F.col
    line = F.concat_ws(" ", "target", "arguments")
    return _hits(
        f,
        key,
        [
            (F.lit(True), "lnk.attachment", 60),
            (line.rlike(LOLBINS), "lnk.lolbin_target", 85),
            (c("target").rlike(SCRIPT_NAME), "lnk.script_target", 75),
            (line.rlike(r"\\\\[A-Za-z0-9.-]+\\"), "lnk.remote_target", 80),
            ((F.length("arguments") > 255) & c("arguments").rlike(r"\s{50,}") | c("arguments").contains("\n"), "lnk.hidden_arguments", 45),
            (c("icon").rlike(r"(?i)(winword|excel|acrord32|\.pdf|\.docx?)"), "lnk.deceptive_icon", 40),
            (c("trailing") > 1024, "lnk.appended_payload", 70),
        ],
    )


def pe_findings(f: DataFrame, now: Column, key: str = "id") -> DataFrame:
    c = F.col
    traits = [c(k) for k in ("control", "plugin", "capture", "stay", "keylogging", "anti_analysis")]
    kinds = sum(((t > 0).cast("int") for t in traits[1:]), (traits[0] > 0).cast("int"))
    rat = (kinds >= 3) & (sum(traits[1:], traits[0]) >= 4) & (c("control") > 0) & ((c("anti_analysis") > 0) | (c("plugin") > 0))
    return _hits(
        f,
        key,
        [
            (F.lit(True), "pe.executable_attachment", 40),
            (c("broken"), "pe.malformed", 25),
            (c("injection") >= 2, "pe.process_injection", 70),
            (c("keylogging") >= 1, "pe.keylogger", F.when(c("keylogging") >= 2, 60).otherwise(40)),
            (c("stealing") >= 2, "pe.stealer_behavior", F.when(c("exfil") > 0, 85).otherwise(75)),
            (rat, "pe.rat_traits", 75),
            ((c("anti_analysis") >= 2) & ~rat, "pe.anti_analysis", 35),
            ((c("exfil") > 0) & (c("stealing") < 2), "pe.exfil_channel", F.when(c("exfil") >= 2, 60).otherwise(45)),
            (c("ransom") >= 2, "pe.ransomware_traits", 70),
            (c("max_entropy") > 7.2, "pe.packed", 30),
            (c("inner_pe"), "pe.embedded_pe", 60),
            ((c("overlay") > 4096) & ~c("signed"), "pe.overlay", 25),
            (c("timestamp") > F.unix_timestamp(now) + 2 * 86400, "pe.timestamp_future", 10),
            (~c("signed"), "pe.unsigned", 0),
        ],
    )


def office_findings(f: DataFrame, key: str = "id") -> DataFrame:
    c = F.col
    template = F.exists("external", lambda x: x.rlike(r"(?i)^(attachedtemplate|frame|oleobject) (https?|ftp):"))
    follina = F.exists("external", lambda x: x.rlike(r"(?i)ms-msdt:|\.html!$"))
    return _hits(
        f,
        key,
        [
            (c("macros") & c("auto") & c("danger"), "office.vba.autoexec", 75),
            (c("macros") & ~c("auto") & c("danger"), "office.vba.suspicious", 40),
            (c("macros") & c("auto") & ~c("danger"), "office.vba.autorun", 40),
            (c("macros") & ~c("auto") & ~c("danger"), "office.vba.macros", 25),
            (c("xlm") & c("xlm_auto") & c("xlm_calls"), "office.xlm.autoexec", 80),
            (c("xlm") & ~c("xlm_auto") & c("xlm_calls"), "office.xlm.suspicious", 50),
            (c("xlm") & ~c("xlm_calls"), "office.xlm.macros", 40),
            (c("dde"), "office.dde", 75),
            (template, "office.remote_template", 75),
            (follina, "office.follina", 85),
            (F.exists("external", lambda x: x.rlike(r"(?i) (file:)?[/\\]{2}[A-Za-z0-9]")), "office.external_unc", 40),
            (c("equation"), "office.equation_editor", 70),
            (c("moniker"), "office.url_moniker", 80),
            (c("activex"), "office.activex", 25),
            (c("encrypted"), "office.encrypted", 35),
            ((c("objects") > 0) & ~c("equation"), "office.embedded_objects", 0),
            (c("broken"), "office.corrupted", 10),
        ],
    )


def onenote_findings(f: DataFrame, key: str = "id") -> DataFrame:
    kinds = F.transform("objects", magic_type)
    program = F.exists(kinds, lambda k: k.isin(*EXECUTABLE_TYPES))
    script = F.exists("objects", lambda o: F.lower(F.try_to_binary(F.hex(o), F.lit("hex")).cast("string")).rlike(r"wscript|powershell|createobject|@echo off|<script"))
    named = F.exists("names", lambda n: n.rlike(r"(?i)\.(exe|hta|js|vbs|bat|cmd|lnk|ps1|wsf)$"))
    page = F.exists(kinds, lambda k: k == "text/html") & ~script
    picture = F.exists(kinds, lambda k: k.startswith("image/"))
    rest = F.exists(kinds, lambda k: (k != "text/html") & ~k.startswith("image/")) & ~program & ~script
    return _hits(f, key, [(program, "onenote.embedded_pe", 85), (script, "onenote.embedded_script", 80), (named, "onenote.dangerous_filename", 70), (page, "onenote.embedded_html", 35), (rest, "onenote.embedded_file", 30), (picture, "onenote.embedded_image", 0), (F.size("objects") == 0, "onenote.file", 10)])


# --- inert samples, put together from pieces -----------------------------------------------------------------------------------


def samples() -> dict[str, list[tuple[int, bytes]]]:
    def rels(target: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/_rels/settings.xml.rels", f'<Relationships><Relationship Id="r1" Type="http://x/attachedTemplate" Target="{target}" TargetMode="External"/></Relationships>')
        return out.getvalue()

    macro = io.BytesIO()
    with zipfile.ZipFile(macro, "w") as z:
        z.writestr("word/vbaProject.bin", "Sub Auto" + "Open()\n She" + 'll "calc"')
    link = bytearray(76)
    link[:4] = b"\x4c\0\0\0"
    struct.pack_into("<I", link, 20, 0x80 | 8 | 32)
    text = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16le")
    head = bytearray(b"MZ" + b"\0" * 62)
    struct.pack_into("<I", head, 60, 64)
    program = bytes(head) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 0, 0) + b"\0" * 16 + struct.pack("<II", 64, 128) + b"\0" * 16
    return {
        "pdf": [
            (1, b"%PDF-1.4\n1 0 obj<</OpenAction 2 0 R/S/Java" + b"Script/JS(app.x)>>endobj\n%%EOF\n"),
            (2, b"%PDF-1.4\n<</S/URI/URI(https://a.example)>>\nstream\n" + zlib.compress(b"<</S/Launch>>") + b"\nendstream\n%%EOF"),
            (3, b"%PDF-1.4\n<</#4aava#53cript 1/J#53 2>>%%EOF"),
            (4, b"rubbish"),
        ],
        "lnk": [(1, bytes(link) + text("..\\cmd.exe") + text("/c x") + b"\0" * 4), (2, b"short")],
        "pe": [(1, program + b"\0" * 64), (2, program + b"\0" * 64 + b"VirtualAlloc" + b"Ex WriteProcess" + b"Memory"), (3, b"MZ")],
        "office": [(1, macro.getvalue()), (2, rels("https://evil.example/t.dotm")), (3, b"{\\rtf1 {\\object\\objdata " + b"Equation.3".hex().encode() + b"}}"), (4, b"PK\x03\x04x")],
        "onenote": [(1, bytes.fromhex("e716e3bd65261145a4c48d4d0b7a9eac") + struct.pack("<Q", 70) + b"\0" * 12 + program), (2, b"")],
    }


def _query(kind: str, found) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The samples of a kind, once for every supplier."""
        held = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bytearray(d)).alias("data")) for i, d in samples()[kind]])
        rows = src.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(held).alias("x"))
        return found(features(rows.select((F.col("s_suppkey") * 10 + F.col("x.i")).alias("id"), "x.data"), kind))

    R.add(_EXPECTED[kind].replace("SELECT * FROM (", "SELECT s_suppkey * 10 + t.id AS id, rule, score FROM supplier, (", 1), name=f"{kind}_scan")(run)


_EXPECTED = {
    "pdf": "SELECT * FROM (VALUES (1, 'pdf.javascript_autorun', 65), (2, 'pdf.launch', 75), (3, 'pdf.javascript', 35), (4, 'pdf.parse_error', 0)) t(id, rule, score)",
    "lnk": "SELECT * FROM (VALUES (1, 'lnk.attachment', 60), (1, 'lnk.lolbin_target', 85), (2, 'lnk.attachment', 60)) t(id, rule, score)",
    "pe": "SELECT * FROM (VALUES (1, 'pe.executable_attachment', 40), (1, 'pe.unsigned', 0), (2, 'pe.executable_attachment', 40), (2, 'pe.unsigned', 0), (2, 'pe.process_injection', 70), (3, 'pe.executable_attachment', 40), (3, 'pe.malformed', 25), (3, 'pe.unsigned', 0)) t(id, rule, score)",
    "office": "SELECT * FROM (VALUES (1, 'office.vba.autoexec', 75), (2, 'office.remote_template', 75), (3, 'office.equation_editor', 70), (4, 'office.corrupted', 10)) t(id, rule, score)",
    "onenote": "SELECT * FROM (VALUES (1, 'onenote.embedded_pe', 85), (2, 'onenote.file', 10)) t(id, rule, score)",
}
for _kind, _found in (("pdf", pdf_findings), ("lnk", lnk_findings), ("office", office_findings), ("onenote", onenote_findings), ("pe", lambda f: pe_findings(f, F.lit("2024-01-01").cast("timestamp")))):
    _query(_kind, _found)
