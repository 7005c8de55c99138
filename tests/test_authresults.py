"""Which authentication header counts, what it says, and what its neighbours add."""

import pytest

from posthound.operators import authresults
from posthound.plans import analysis

AR, ARC = "Authentication-Results", "ARC-Authentication-Results"


def told(spark, headers, trusted=()):
    rows = [(i, p, n, v) for i, hs in headers.items() for p, (n, v) in enumerate(hs)]
    return {r.id: r for r in authresults.collected(spark.createDataFrame(rows, "id int, position int, name string, value string"), trusted).collect()}


def test_split_results_are_merged_and_others_are_not(spark):
    split = [(AR, "mx.a; spf=fail smtp.mailfrom=q.example"), (AR, "MX.A; dkim=fail header.d=x.example"), (AR, "mx.a; dkim=pass header.i=@y.example; dmarc=pass header.from=x.example"), ("To", "b"), (AR, "mx.a; compauth=fail")]
    r = told(spark, {1: split, 2: [split[0], split[3], split[1]], 3: [(AR, "spf=fail"), (AR, "spf=pass; dkim=pass")], 4: [("To", "x")], 5: [(AR, None), ("X", None)]})
    assert (r[1].spf, r[1].dkim, r[1].dmarc, r[1].compauth, r[1].domains, r[1].mail_from, r[1].header_from) == ("fail", "pass", "pass", "", ["x.example", "y.example"], "q.example", "x.example")
    assert (r[2].spf, r[2].dkim) == ("fail", "") and (r[3].spf, r[3].dkim) == ("fail", "")
    assert 4 not in r and r[5].has_auth and r[5].spf == "" and not r[1].trusted_auth


def test_named_servers_and_forged_headers(spark):
    forged, own = (AR, "evil.example; dmarc=pass"), (AR, "mx1.corp.example; dmarc=fail action=oreject")
    h = {1: [forged, own], 2: [forged], 3: [(ARC, "i=2; mx2.corp.example; spf=pass"), own], 4: [("Received-SPF", "Pass (x)")], 5: [(AR, "corp.example; spf=pass")]}
    r = told(spark, h, ("*.Corp.Example.", "*", ""))
    assert (r[1].dmarc, r[1].policy, r[1].trusted_auth) == ("fail", "reject", True)
    assert (r[2].dmarc, r[2].has_auth, r[2].trusted_auth) == ("", True, False)
    assert (r[3].of, r[3].spf, r[3].dmarc) == ("chain", "pass", "")
    assert (r[4].spf, r[4].has_auth) == ("", False) and not r[5].trusted_auth
    assert told(spark, h, ("corp.example",))[5].trusted_auth


def test_chains_and_received_spf_without_named_servers(spark):
    chain = [(ARC, "i=1; a; spf=pass"), (ARC, "i=12; b; spf=fail; dkim=none"), (ARC, "i=2; c; spf=none")]
    r = told(spark, {1: chain, 2: [*chain, (AR, "d; dmarc=none")], 3: [("Received-SPF", "SoftFail (a (b) dkim=pass) x"), (AR, "d; dkim=pass")], 4: [("Received-SPF", "Rubbish")]})
    assert (r[1].of, r[1].authserv, r[1].spf) == ("chain", "b", "fail")
    assert (r[2].of, r[2].spf, r[2].dmarc) == ("result", "", "none")
    assert (r[3].of, r[3].spf, r[3].dkim) == ("result", "softfail", "pass") and (r[4].of, r[4].spf) == ("", "")


@pytest.mark.parametrize("value, want", [
    ("mx; dkim=none; dkim=fail; dkim=neutral", "fail"),
    ("mx; dkim=neutral; dkim=none", "neutral"),
    ("mx (c; dkim=pass); spf=pass", ""),
    ('mx; dkim="Pass"', "pass"),
    ("mx; dkim/1=pass", "pass"),
    ("mx; xdkim=pass", ""),
])
def test_signatures(spark, value, want):
    assert told(spark, {1: [(AR, value)]})[1].dkim == want


def test_a_message_counts_only_what_a_named_server_says(spark):
    text = b"Authentication-Results: evil.example; dmarc=pass\r\nAuthentication-Results: mx.corp.example; spf=fail\r\nAuthentication-Results: mx.corp.example; dmarc=fail\r\nFrom: boss@corp.example\r\n\r\nhello"
    raw = spark.createDataFrame([(1, text), (2, b"From: a@b.example\r\n\r\nhello")], "id long, raw binary")
    inputs = analysis.inputs_of(raw, ("corp.example",), ("mx.corp.example",))
    found, errors = analysis.run_analysers(inputs, {"headers": analysis.ANALYSERS["headers"]})
    assert errors.count() == 0
    assert {(r.analysis_id, r.rule) for r in found.collect()} == {(1, "headers.own_domain_spoof"), (2, "headers.no_auth_results")}


def test_policies_in_one_pass_equal_each_by_itself(spark):
    headers = [(AR, "mx.corp.example; spf=fail; dkim=pass header.d=a.example"), ("Received-SPF", "Pass (x)"), (AR, "mx2.other.example; dmarc=pass action=none"), (ARC, "i=1; mx.corp.example; dkim=fail header.i=@b.example")]
    rows = [(i, p, *headers[(i + p * (i + 1)) % 4]) for i in range(12) for p in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "id int, position int, name string, value string")
    policies = {"none": (), "corp": ("*.corp.example",), "other": ("mx2.other.example",), "nobody": ("x.example",)}
    each = {(r.policy_name, r.id): tuple(r[2:]) for r in authresults.collected_each(df, policies).collect()}
    assert len(each) == 12 * len(policies)
    for name, trusted in policies.items():
        assert {r.id: tuple(r[1:]) for r in authresults.collected(df, trusted).collect()} == {i: v for (n, i), v in each.items() if n == name}
    assert not any(v[3] for (n, _), v in each.items() if n in ("none", "nobody")) and any(v[3] for (n, _), v in each.items() if n == "corp")


def test_words_that_only_mention_a_signature_are_none(spark):
    r = told(spark, {1: [(AR, "mx.a; DKIM/1=Pass header.d=a.example; xdkim=fail; reason=dkim; dkim= ")], 2: [(AR, "mx.a; adkim=pass header.d=z.example")]})
    assert (r[1].dkim, r[1].domains, r[2].dkim, r[2].domains) == ("pass", ["a.example"], "", [])
