"""Samples of counters and histograms, findings told once, rules that are left out."""

from posthound.operators import claims, urlgroups
from posthound.plans import metrics


def test_labels_are_escaped_and_nulls_are_counted(spark):
    rows = spark.createDataFrame([('a"b', 1), ("c\\d\ne", 2), (None, 1), (None, 1)], "x string, y int")
    got = metrics.counter(rows, "m", ("x", "y"))
    lines = {r.line for r in got.select(metrics.exposition(got).alias("line")).collect()}
    assert lines == {'m{x="a\\"b",y="1"} 1', 'm{x="c\\\\d\\ne",y="2"} 1', 'm{x="",y="1"} 2'}


def test_histogram_of_no_label(spark):
    rows = spark.createDataFrame([(100,), (101,), (5000,), (999_999,), (None,)], "ms long")
    got = {r.metric + r.labels: r.value for r in metrics.histogram(rows, "d", "ms", bounds=("0.1", "5")).collect()}
    assert got == {'d_bucket{le="0.1"}': "1", 'd_bucket{le="5"}': "3", 'd_bucket{le="+Inf"}': "4", "d_sum": "1005.200", "d_count": "4"}


def test_findings_are_told_once(spark):
    rows = [(1, None, p, f"u{p % 7}", f"d{p % 3}", "r", 1, 10 + (p == 4)) for p in range(20)] + [(1, "a", 3, "u", "", "r", 2, 5), (1, "a", 3, "u", "", "r", 2, 5)]
    df = spark.createDataFrame(rows, "mail int, artifact string, position int, url string, domain string, rule string, severity int, score int")
    got = {r.artifact: r for r in urlgroups.told_once(df, "mail", 2, 5).collect()}
    r = got[None]
    assert (r.score, r.best_url, r.n_urls, r.n_domains, r.domains, r.urls) == (11, "u4", 7, 3, ["d0", "d1"], ["u0", "u1", "u2", "u3", "u4"])
    assert (got["a"].domains, got["a"].urls, got["a"].n_domains) == ([], ["u"], 0)
    assert urlgroups.told_once(df.limit(0), "mail").count() == 0


def test_rules_that_are_left_out_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rule": "x", "patterns": ["p"]}\n{"rule": "y", "patterns": ["q"]}\nrubbish\n{"patterns": ["q"]}\n{"rule": "z"}\n')
    (tmp_path / "b.json").write_text('{"rule": "x", "patterns": ["r"]}\n')
    got = sorted((r.file, r.problem) for r in claims.rule_problems(spark, str(tmp_path)).collect())
    assert got == [("a.json", "no name"), ("a.json", "no pattern"), ("a.json", "replaced by b.json"), ("a.json", "unreadable")]
    assert {r.rule: r.patterns for r in claims.read_rules(spark, str(tmp_path)).collect()} == {"x": ["r"], "y": ["q"]}
