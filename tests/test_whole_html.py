"""Pages of any number of links are read whole."""

from collections import Counter

from posthound.operators import scripts
from posthound.sources import mail

#: Distinct links of a page, several times as many as html_facts once let through.
MANY = 2_500


def test_html_links_gives_every_link_of_a_page(spark, tmp_path):
    body = "".join(f"<a href='https://h{k % 7}.example/{k}'>item <b>{k}</b></a> <img src='/i{k}.png'>" for k in range(MANY))
    # The page's first links come again at its end: repeats count once, and take no place of others.
    again = "".join(f"<a href='https://h{k % 7}.example/{k}'>item {k}</a>" for k in range(50))
    pages = [(1, body + again + "<meta http-equiv=refresh content='0; url=/last'><form action='/in'></form>"), (2, "<a href=one>1</a>"), (3, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in mail.html_links(spark, str(tmp_path)).collect())
    want = [(1, f"https://h{k % 7}.example/{k}", "a", f"item {k}") for k in range(MANY)] + [(1, f"/i{k}.png", "img", "") for k in range(MANY)]
    assert got == Counter([*want, (1, "/last", "refresh", ""), (1, "/in", "form", ""), (2, "one", "a", "1")])


def test_html_findings_see_a_form_behind_any_number_of_links(spark):
    menu = "".join(f"<a href='/{k}'>{k}</a>" for k in range(MANY))
    ends = {1: "<form action='https://evil.example/p'><input type=password></form>", 2: "<form action='/in'><input type=password></form>", 3: "<form action='//evil.example/p'></form>"}
    pages = spark.createDataFrame([(k, menu + end) for k, end in ends.items()], "id int, text string")
    got = sorted(tuple(r) for r in scripts.html_findings(pages, "id", "text").collect())
    assert got == [(1, "html.credential_phishing", 70), (2, "html.password_form", 40)]
