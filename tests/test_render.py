"""Alerts in each channel's markup, fitted to its length."""

import pytest

from posthound.plans import render

ROWS = [(1, 0, 0, "title", "", "a < b & *c*"), (1, 1, 1, "fact", "From", "x_y"), (1, 5, 9, "fact", "Finding", "first\n second"), (1, 9, 5, "code", "SHA-256", "a`b<"), (2, 0, 0, "title", "", None)]


def texts(spark, style, limit=1000, longest=100, rows=ROWS):
    lines = spark.createDataFrame(rows, "analysis_id int, place int, weight int, kind string, label string, text string")
    return {r.analysis_id: (r.text, r.dropped) for r in render.fitted(lines, render.STYLES[style], limit, longest).collect()}


def test_markup(spark):
    assert texts(spark, "text") == {1: ("a < b & *c*\nFrom: x_y\nFinding: first second\nSHA-256: a'b<", 0), 2: ("", 0)}
    assert texts(spark, "html")[1][0] == "<b>a &lt; b &amp; *c*</b>\n<b>From</b>: x_y\n<b>Finding</b>: first second\n<b>SHA-256</b>: <code>a'b&lt;</code>"
    assert texts(spark, "slack")[1][0] == "*a &lt; b &amp; *c**\n*From*: x_y\n*Finding*: first second\n*SHA-256*: `a'b&lt;`"
    assert texts(spark, "discord")[1][0] == "**a < b & \\*c\\***\n**From**: x\\_y\n**Finding**: first second\n**SHA-256**: `a'b<`"


@pytest.mark.parametrize("style", list(render.STYLES))
@pytest.mark.parametrize("limit", [124, 125, 150, 207, 208, 209, 400])
def test_the_weightiest_whole_lines_that_fit(spark, style, limit):
    rows = [(1, i, 40 - i, "fact", "L", "\U0001f600&" * 4 + str(i)) for i in range(20)] + [(2, 0, 0, "title", "", "&" * 300)]
    every = {r: t for r, (t, _) in texts(spark, style, 10_000, 10, rows).items()}[1].split("\n")
    got, dropped = texts(spark, style, limit, 10, rows)[1]
    units = (lambda t: len(t.encode("utf-16-le")) // 2) if style == "html" else len
    best = next(n for n in range(20, -1, -1) if (units("\n".join(every[20 - n:])) <= limit if n == 20 else units("\n".join(every[20 - n:]) + "\n") + render.NOTE <= limit))
    want = "\n".join(every[20 - best:]) + (f"\n… and {20 - best} more" if best < 20 else "")
    assert (got, dropped) == (want, 20 - best) and units(got) <= limit


def test_a_limit_that_no_line_is_sure_to_fit(spark):
    with pytest.raises(ValueError):
        texts(spark, "html", 100, 100)
