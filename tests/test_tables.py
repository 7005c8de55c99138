"""Operators over tables of rules, services and parents, against plain Python and against each other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from posthound.operators import ancestors, anchors, claims, deception, services
from posthound.plans import analysis
from posthound.sources import mail


def test_anchor_is_in_every_match():
    known = {"abc[0-9]+defgh": "defgh", "foo|foobar": "", "(abc)def": "def", "abcd?ef": "abc", r"a\.exe\b": "a.exe", "ab+c": "ab", "x{3}yz": "yz", "": "", "(?i)abc": "", "[]a]bcd": "bcd", "a.c": "a", r"\d\dword": "word", "(?:a|b)tail": "tail"}
    assert {p: anchors.anchor(p) for p in known} == known
    rng = random.Random(2)
    for _ in range(3000):
        p = "".join(rng.choice(["a", "b", "c", ".", "?", "*", "+", "|", "(", ")", "[ab]", r"\.", r"\w", "{2}", "^", "$"]) for _ in range(rng.randrange(1, 9)))
        try:
            rx = re.compile(p)
        except re.error:
            continue
        held = anchors.anchor(p)
        for _ in range(20):
            text = "".join(rng.choice("abc.") for _ in range(rng.randrange(0, 9)))
            if rx.search(text):
                assert held in text, (p, held, text)


def test_indexed_rules_find_what_a_plain_scan_finds(spark):
    rng = random.Random(3)
    words = ["alpha", "beta12", "gamma", "de.lta", "epsilon", "zeta"]
    rules = [(f"r{i}", "F" if i % 2 else None, i, rng.choice([None, 1, 2]), rng.choice([None, ["text/"], ["image/", "text/html"]]), rng.choice([None, 60]), [re.escape(rng.choice(words)) if rng.random() < 0.6 else rng.choice(["[a-z]{3}\\d", "al.ha", "x?", "gam+a", "^beta", "be|ze"]) for _ in range(rng.randrange(1, 4))]) for i in range(60)]
    table = spark.createDataFrame(rules, claims.RULE_COLUMNS)
    texts = [" ".join(rng.choice([*words, "Alpha", "x"]) for _ in range(rng.randrange(0, 14))).encode() for _ in range(40)]
    texts += [t.decode().encode("utf-16le") for t in texts[:10]] + [b"", None, b"\xc4lpha \xe4"]
    rows = spark.createDataFrame([(i, None if t is None else bytearray(t), rng.choice(["text/html", "image/png", None])) for i, t in enumerate(texts)], "id int, data binary, kind string")
    got = sorted(map(tuple, anchors.scan_table(rows, table, kind="kind").collect()), key=repr)
    assert got == sorted(map(tuple, claims.scan(rows, claims.bounded_rules(table), kind="kind").collect()), key=repr) and got
    assert anchors.scan_table(rows, table.limit(0), kind="kind").count() == 0


def test_the_plan_of_an_indexed_scan_does_not_grow_with_its_rules(spark):
    rows = spark.createDataFrame([(1, bytearray(b"some text of word77 here"))], "id int, data binary")
    sizes = []
    for n in (3, 3000):
        table = spark.createDataFrame([(f"r{i}", None, 1, 1, None, None, [f"word{i}\\b"]) for i in range(n)], claims.RULE_COLUMNS)
        found = anchors.scan_table(rows, table)
        sizes.append(len(re.sub(r"#\d+|[0-9a-f]{32}|\d+", "", found._jdf.queryExecution().optimizedPlan().toString()).splitlines()))
    assert found.collect()[0].rule == "yara.r77" and sizes[0] == sizes[1]


def test_services_take_the_longest_host_and_prefix(spark):
    table = spark.createDataFrame([("a.example", "", "host", 1), ("a.example", "/x", "short", 2), ("a.example", "/x/y/", "long", 3), ("b.a.example", "", "sub", 4), ("B.example", "/p", "case", 5), ("a.example", "/x", "also", 6)], "host string, prefix string, kind string, score int")
    urls = {"http://a.example/": "host", "http://a.example/xy": "host", "http://a.example/x?q": "also", "https://c.a.example/x/y/z": "long", "http://b.a.example/x/y": "sub", "http://b.example/p/": "case", "http://b.example/": None, "http://nota.example/": None, "mailto:x": None, None: None, "http://a.example": "host", "http://a.example//x": "also"}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    got = {r.url: r.kind for r in services.service_of(rows, table, "id", "url").collect()}
    assert got == {u: k for u, k in urls.items() if k}
    own = services.own_table(spark)
    assert own.count() == own.select("host", "prefix").distinct().count() >= 57
    seen = spark.createDataFrame([(1, "https://www.dropbox.com/scl/fi/x"), (2, "https://www.dropbox.com/about"), (3, "https://discord.com/api/webhooks/1/2")], "id int, url string")
    assert sorted((r.id, r.score) for r in services.service_findings(seen, own, "id", "url").collect()) == [(1, 20), (3, 30)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roots_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 120
    parent = {i: rng.choice([None, None, 10_000, *[rng.randrange(n)] * (4 + 8 * (seed > 1))]) for i in range(n)}
    if seed == 3:
        parent |= {i: i - 1 for i in range(1, n)} | {0: rng.choice([None, 0])}
    got = {r.id: (r.root, r.depth, r.in_cycle) for r in ancestors.roots(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}

    def walk(i):
        seen = [i]
        while parent[seen[-1]] in parent:
            nxt = parent[seen[-1]]
            if nxt in seen:
                cycle = seen[seen.index(nxt) :]
                return min(cycle), None, i in cycle
            seen.append(nxt)
        return seen[-1], len(seen) - 1, False

    assert got == {i: walk(i) for i in parent}
    assert ancestors.roots(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_honest_international_names_are_no_homographs(spark):
    names = {"münchen": False, "señor": False, "pаypal": True, "жук": False, "сор": True, "αpple": True}
    rows = spark.createDataFrame([(k, f"https://www.xn--{k.encode('punycode').decode()}.com/") for k in names], "k string, url string")
    assert {r.k for r in deception.idn_findings(rows, "k", "url").collect()} == {k for k, bad in names.items() if bad}
    assert deception.idn_findings(spark.createDataFrame([("a", None), ("b", "http://xn--é.com/"), ("c", "http://plain.com")], "k string, url string"), "k", "url").select(F.count(F.lit(1))).first()[0] == 0


def test_a_broken_analyser_costs_no_other_its_findings(spark):
    rows = spark.createDataFrame([(int(k), bytearray(raw)) for k, raw in mail._samples()], "id long, raw binary")
    brands = spark.createDataFrame([("Shop", ["shop"], ["shop.example"])], "brand string, phrases array<string>, domains array<string>")
    rules = spark.createDataFrame([("any", None, 5, 1, None, None, ["."])], claims.RULE_COLUMNS)
    whole = analysis.analyse(rows, ("corp.example",))[0]

    def no_plan(x):
        raise KeyError("no such table")

    def bad_rows(x):
        boom = F.when(F.col("id") == 1, F.raise_error(F.lit("bad message")).cast("int")).otherwise(F.lit(7))
        return x.parsed.select(F.col("id").alias("mail"), F.lit("own.rule").alias("rule"), boom.alias("score"))

    more = analysis.ANALYSERS | {"first": ("x", no_plan), "second": ("x", bad_rows)}
    found, _, levels, errors = analysis.analyse_all(rows, ("corp.example",), brands=brands, rules=rules, analysers=more)
    got = errors.collect()
    assert {(e.analyser, e.error) for e in got if e.analyser == "first"} == {("first", "KeyError")}
    second = [e for e in got if e.analyser == "second"]
    assert len(second) == 1 and second[0].share and "bad message" in second[0].message
    old = {(r.analysis_id, r.rule, r.artifact_id) for r in whole.collect()}
    new = {(r.analysis_id, r.rule, r.artifact_id) for r in found.collect()}
    assert old < new and {r for _, r, _ in new - old} >= {"own.rule", "yara.any"}
    assert 1 not in {i for i, r, _ in new if r == "own.rule"} and levels.count() == rows.count()
