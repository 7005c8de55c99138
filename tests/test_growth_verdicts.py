"""Mails to verdicts: rules worked out once a mail, texts neither joined nor searched in vain, tasks that grow in number."""

import re

from posthound.operators import messages
from posthound.plans import analysis
from posthound.sources import mail
from tests.test_growth import plan_of

HEADS = "id int, from_addr string, from_display string, reply_to string, return_path string, spf string, dkim string, dmarc string, compauth string, has_auth boolean, trusted_auth boolean"
BODIES = "id int, subject string, body string, attachments int, risky int, has_urls boolean"


def test_header_rules_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "it@c0rp.example", "", "", "", "", "", "fail", "", True, True), (2, "a@cor.example", None, "x@cropp.example", "", "", "", "pass", "", True, True)], HEADS)
    found = messages.header_findings(rows, ("corp.example",))
    assert plan_of(found).count("headers.dmarc_fail") == 1
    assert {(r.id, r.rule) for r in found.collect()} == {(1, "headers.dmarc_fail"), (1, "headers.lookalike_domain"), (2, "headers.lookalike_domain")}


def test_wordings_are_asked_once_and_found_in_any_form(spark):
    odd = ["verify YOUR\x0b account", "clave :\n1234", "AſAP last\t\r\nnotice", "GIFT　CARDS", "the Key: inİoice", "contraseÑa=abcd", "İurgent", "re-invoice.", "xinvoice", "invoices", "Account is  suspended"]
    rows = spark.createDataFrame([(i, "s", t, 1, 0, False) for i, t in enumerate(odd)] + [(99, "Urgent", None, 0, 0, False)], BODIES)
    found = messages.content_findings(rows)
    assert plan_of(found).count("remittance") == 1
    got = {(r.id, r.rule.split(".")[1], r.score) for r in found.collect()}
    assert got == {(0, "credential_lure", 15), (1, "password_hint", 15), (2, "urgency", 5), (3, "bec_lure", 15), (5, "password_hint", 15), (6, "urgency", 5), (7, "invoice_lure", 15), (10, "credential_lure", 15), (99, "urgency", 5)}


def test_mails_without_files_are_not_searched_for_passwords(monkeypatch):
    monkeypatch.setattr(mail, "PASSWORD_WORD", None)
    assert mail.parse_message(b"From: a@b.example\r\nSubject: s\r\n\r\npassword: abc")["errors"] == []
    monkeypatch.undo()
    assert [a["id"] for a in mail.parse_message(mail._samples()[0][1])["artifacts"]] == ["docs.zip", "docs.zip/inner.zip", "docs.zip/inner.zip/run.exe", "docs.zip/note.txt"]


def test_parsed_mails_leave_a_task_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(mail, "BATCH_CHARS", 500)
    raw = spark.createDataFrame([(i, b"Subject: s%d\r\n\r\n" % i + b"x" * 400) for i in range(9)] + [(9, None)], "id long, raw binary").coalesce(1)
    parsed = mail.parse(raw, "id")
    assert "MapInArrow" in plan_of(parsed)
    assert {(r.id, r.subject, len(r.body_text)) for r in parsed.collect()} == {(i, f"s{i}", 400) for i in range(9)} | {(9, "", 0)}


def test_mails_and_findings_are_dealt_by_number(spark, monkeypatch):
    plans, write = {}, analysis.written
    monkeypatch.setattr(analysis, "written", lambda df, name: (plans.update({name: plan_of(df)}), write(df, name))[1])
    raw = spark.createDataFrame([(i, b"From: a@c0rp.example\r\nSubject: s\r\n\r\nurgent: www.b.example/x") for i in range(5)], "id long, raw binary")
    found, _, verdicts = analysis.analyse(raw, ("corp.example",))
    assert {(r.analysis_id, r.rule) for r in found.collect()} == {(i, r) for i in range(5) for r in ("headers.no_auth_results", "headers.lookalike_domain", "content.urgency")}
    assert {r.level for r in verdicts.collect()} == {"malicious"}
    assert "isFinalPlan=true" in plan_of(verdicts) and "Broadcast" not in plan_of(verdicts)
    assert all("REPARTITION_BY_NUM" in p for p in (plans["findings-headers"], plans["findings"], plan_of(verdicts)))
    text = re.search(r"MapInArrow", plans["findings-content"]).start()
    assert "Join" in plans["findings-content"][:text] and "Join" not in plans["findings-content"][text:].split("Exchange")[0]
