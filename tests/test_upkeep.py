"""State, formats, deceptive links and imitations on odd values."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from posthound.operators import deception, upkeep
from posthound.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 200])
def test_signatures_equal_the_library(spark, key):
    body = "ñ body \U0001f600"
    assert one(spark, upkeep.hmac_sha256(F.col("t"), key), t=body) == hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def test_lists_times_and_formats(spark):
    assert one(spark, upkeep.string_list(F.col("t")), t='["a", "b"]') == ["a", "b"]
    assert [one(spark, upkeep.string_list(F.col("t")), t=x) for x in ('{"a": 1}', "rubbish", None)] == [[], [], []]
    assert str(one(spark, upkeep.instant(F.col("t")), t="1700000000123")) == "2023-11-14 22:13:20.123000"
    assert str(one(spark, upkeep.instant(F.col("t")), t="2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert one(spark, upkeep.instant(F.col("t")), t="soon") is None
    shown = [one(spark, upkeep.shown_bytes(F.col("t").cast("long")), t=x) for x in ("0", "1", "1023", "1024", "1536000", None, "-5")]
    assert shown == ["0 bytes", "1 byte", "1023 bytes", "1,0 KB", "1,5 MB", "—", "0 bytes"]


def test_state_and_versions(spark):
    state = spark.createDataFrame([("n", "a", 1, "old"), ("n", "b", 1, None)], "namespace string, key string, seq int, value string")
    changes = spark.createDataFrame([("n", "a", 2, "new"), ("n", "a", 0, "late"), ("m", "a", 1, "x")], state.schema)
    assert sorted(tuple(r) for r in upkeep.upsert(state, changes).collect() if r.value) == [("m", "a", 1, "x"), ("n", "a", 2, "new")]
    rows = upkeep.with_columns_of(state, 1, {"key": "string", "added": "long"}, 2)
    assert rows.columns == ["key", "added"] and rows.filter("added is null").count() == 2
    with pytest.raises(ValueError):
        upkeep.with_columns_of(state, 3, {"key": "string"}, 2)


def test_shown_domains(spark):
    said = {"www.bank.example/x": "www.bank.example", "Pay at HTTPS://Bank.Example:8443!": "bank.example", "a@b.example": None, "report.pdf": None, "http://report.zip": "report.zip", "10.5.2024": None, "10.1.2.3": "10.1.2.3", "plain words": None, "": None, None: None, "ftp://x.example": None}
    assert {k: one(spark, deception.shown_domain(F.col("t")), t=k) for k in said} == said


def test_deceptive_links_spare_own_and_trusted_targets(spark):
    rows = [(1, "https://evil.example/", "bank.com"), (2, "https://m.bank.com/", "www.bank.com"), (3, "https://track.net/?url=https%3A%2F%2Fbank.com%2F", "bank.com"), (4, "https://ok.org/", "bank.com"), (5, None, None), (6, "https://x.io", "hello")]
    got = deception.deceptive_links(spark.createDataFrame(rows, "key int, url string, shown string"), ("ok.org",)).collect()
    assert [(r.key, r.promised, r.real, r.score) for r in got] == [(1, "bank.com", "evil.example", 65)]


def test_imitations_of_punycode_and_own_hosts(spark):
    hosts = [f"xn--{'pаypal'.encode('punycode').decode()}.com", "xn--mnchen-3ya.com", "paypal.com", "www.paypal.com", "paypal.net", "paypa1.com", "payapl.com", "paypal-login.org", "a.paypal.com.evil.io", "notpaypal.com.evil.io", "other.com", "xn--\u00e9.com", None]
    got = {r.host: r.kind for r in deception.imitations(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([("paypal.com",), ("ab.io",)], "target string")).collect()}
    assert got == {hosts[0]: "homoglyph", "paypal.net": "tld_swap", "paypa1.com": "homoglyph", "payapl.com": "typo", "paypal-login.org": "affix", "a.paypal.com.evil.io": "subdomain"}


def test_suppression_between_gaps(spark):
    times = [0, 10, 50, 61, 130, 131, 500, 10_000, 10_030, 10_059, 10_061]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)] + [("j", 99, 5), ("j", 100, 5)], "key string, id long, t long").select("key", "id", F.timestamp_seconds("t").alias("at"))
    sent, until = [], None
    for i, t in enumerate(times):
        if until is None or t >= until:
            sent.append(i)
            until = t + 60
    assert sorted(r.id for r in ingest.suppress(rows, 60).collect()) == sorted([*sent, 99])
