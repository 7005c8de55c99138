"""Alerts as people read them: lines by importance, written in the markup of each channel and fitted to its length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.functions.text import _DEFANG_SQL, defang
from posthound.operators.dml import clip
from posthound.plans.registry import Registry
from posthound.plans.reports import _q
from posthound.sources import adapters as src

R = Registry()
#: Room that the line on what was left out needs.
NOTE = 24
LINE = "analysis_id", "place", "weight", "kind", "label", "text"


def _replaced(pairs: tuple[tuple[str, str], ...]) -> Callable[[Column], Column]:
    def escape(c: Column) -> Column:
        for a, b in pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return escape


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


@dataclass(frozen=True)
class Style:
    """How a channel marks bold text and code, what it escapes, and what it counts."""

    bold: tuple[str, str] = ("", "")
    code: tuple[str, str] = ("", "")
    escaped: tuple[tuple[str, str], ...] = ()
    length: Callable[[Column], Column] = F.length


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
STYLES = {
    "text": Style(),
    "html": Style(("<b>", "</b>"), ("<code>", "</code>"), _ENTITIES, utf16_length),
    "slack": Style(("*", "*"), ("`", "`"), _ENTITIES),
    "discord": Style(("**", "**"), ("`", "`"), tuple((c, "\\" + c) for c in "\\*_~|`>#")),
}


def alert_lines(mails: DataFrame, findings: DataFrame, artifacts: DataFrame, top: int = 5, zone: str = "UTC") -> DataFrame:
    """analysis_id, place (order on the page), weight (what goes last is dropped first), kind, label, text of each alert's lines.

    mails(id, level, from_addr, received_at) are what to alert on; of each the `top` gravest findings and its first `top`
    attachments with their hashes. Addresses and hosts are made inert.
    """
    mails = mails.select(F.col("id").alias("analysis_id"), "level", "from_addr", "received_at")
    line = lambda place, weight, kind, label, text: F.struct(F.lit(place).alias("place"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), text.alias("text"))
    when = F.date_format(F.from_utc_timestamp("received_at", zone), "yyyy-MM-dd HH:mm")
    head = F.array(line(0, 0, "title", "", F.concat(F.lit("A message looks "), "level")), line(1, 1, "fact", "From", F.when(F.col("from_addr") != "", defang(F.col("from_addr"))).otherwise("unknown")), line(2, 3, "fact", "Date", when), line(3, 2, "fact", "Risk", F.col("level")))
    out = mails.select("analysis_id", F.inline(head))
    chosen = lambda rows, *order: rows.join(mails.select("analysis_id"), "analysis_id", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("analysis_id").orderBy(*order))).filter(F.col("k") <= top)
    told = chosen(findings, F.desc("severity"), F.desc("score"), "position").select("analysis_id", (F.col("k") * 2 + 8).alias("place"), (F.col("k") * 2 + 8).alias("weight"), F.lit("fact").alias("kind"), F.lit("Finding").alias("label"), F.concat("rule", F.lit(" ("), "category", F.lit(")")).alias("text"))
    files = chosen(artifacts, "position")
    place = F.col("k") * 2 + 100
    named = F.struct(place.alias("place"), (F.col("k") * 2 + 9).alias("weight"), F.lit("fact").alias("kind"), F.lit("Attachment").alias("label"), defang(F.coalesce("filename", F.lit("unnamed"))).alias("text"))
    hashed = F.struct((place + 1).alias("place"), (F.col("k") * 2 + 9).alias("weight"), F.lit("code").alias("kind"), F.lit("SHA-256").alias("label"), F.coalesce("sha256", F.lit("none")).alias("text"))
    return out.unionByName(told).unionByName(files.select("analysis_id", F.inline(F.array(named, hashed)))).select(*LINE)


def one_line(longest: int) -> Column:
    """The text of a line without breaks, at most `longest` code points."""
    return clip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), longest)


def marked(style: Style, plain: Column) -> Column:
    """A line of kind title, fact or code and its one_line() in the style's markup."""
    escape = _replaced(style.escaped)
    code = F.replace(plain, F.lit("`"), F.lit("'"))
    code = _replaced(_ENTITIES)(code) if style.escaped == _ENTITIES else code
    bold = lambda c: F.concat(F.lit(style.bold[0]), c, F.lit(style.bold[1]))
    title, label = bold(escape(plain)), F.concat(bold(escape(F.col("label"))), F.lit(": "))
    return F.when(F.col("kind") == "title", title).when(F.col("kind") == "code", F.concat(label, F.lit(style.code[0]), code, F.lit(style.code[1]))).otherwise(F.concat(label, escape(plain)))


def fitted_all(lines: DataFrame, styles: dict[str, Style], limit: int, longest: int = 200) -> DataFrame:
    """analysis_id, style, text, dropped: the lines of each alert in order, as many of the weightiest as the limit takes, never part of one.

    If any is left out the last line tells how many. Markup is never cut, as whole lines go. A limit in which the first line
    could not fit whatever it says is an error. Lines are read, dealt and sorted once for all styles.
    """
    if limit < longest * 6 + 64:
        raise ValueError(f"a limit of {limit} is too small for lines of {longest}")
    whole = W.partitionBy("analysis_id")
    upto = whole.orderBy("weight", "place", "kind", "label", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("text", one_line(longest))
    rows = rows.withColumns({f"line_{i}": marked(style, F.col("text")) for i, style in enumerate(styles.values())})
    rows = rows.withColumns({f"size_{i}": style.length(F.col(f"line_{i}")) + 1 for i, style in enumerate(styles.values())})
    rows = rows.withColumns({f"upto_{i}": F.sum(f"size_{i}").over(upto) for i in range(len(styles))}).withColumns({f"all_{i}": F.sum(f"size_{i}").over(whole) for i in range(len(styles))})
    each = []
    for i, name in enumerate(styles):
        keep = (F.col(f"all_{i}") - 1 <= limit) | (F.col(f"upto_{i}") + NOTE <= limit)
        kept = F.sort_array(F.collect_list(F.when(keep, F.struct("place", F.col(f"line_{i}").alias("line")))))
        each.append(F.struct(F.lit(name).alias("style"), kept.alias("kept"), F.count_if(~keep).cast("int").alias("dropped")))
    one = rows.groupBy("analysis_id").agg(F.array(*each).alias("each")).select("analysis_id", F.inline("each"))
    note = F.when(F.col("dropped") > 0, F.concat(F.lit("\n… and "), F.col("dropped").cast("string"), F.lit(" more"))).otherwise("")
    return one.select("analysis_id", "style", F.concat(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), note).alias("text"), "dropped")


def fitted(lines: DataFrame, style: Style, limit: int, longest: int = 200) -> DataFrame:
    """analysis_id, text, dropped: fitted_all() for one style."""
    return fitted_all(lines, {"": style}, limit, longest).drop("style")


def _marked_sql(bold: str, end: str, code: str, code_end: str, escape: str) -> str:
    said = escape.format("text")
    return f"CASE kind WHEN 'title' THEN '{bold}' || {said} || '{end}' WHEN 'code' THEN '{bold}' || label || '{end}: {code}' || text || '{code_end}' ELSE '{bold}' || label || '{end}: ' || {said} END"


_ENT_SQL = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_STYLES_SQL = {"text": _marked_sql("", "", "", "", "{0}"), "html": _marked_sql("<b>", "</b>", "<code>", "</code>", _ENT_SQL), "slack": _marked_sql("*", "*", "`", "`", _ENT_SQL), "discord": _marked_sql("**", "**", "`", "`", r"regexp_replace({0}, '([\\*_~|`>#])', '\\\1', 'g')")}


@R.add(
    _q(
        [src.MAILS_SQL, src.FINDINGS_SQL, src.ARTIFACTS_SQL],
        f"""SELECT analysis_id, style, string_agg(line, chr(10) ORDER BY place) FILTER (keep) || CASE WHEN bool_and(keep) THEN '' ELSE chr(10) || '… and ' || CAST(count(*) FILTER (NOT keep) AS VARCHAR) || ' more' END AS text, CAST(count(*) FILTER (NOT keep) AS INTEGER) AS dropped FROM
(SELECT *, a - 1 <= 450 OR upto + 24 <= 450 AS keep FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY analysis_id, style ORDER BY weight, place ROWS UNBOUNDED PRECEDING) AS upto, sum(length(line) + 1) OVER (PARTITION BY analysis_id, style) AS a FROM
 (SELECT analysis_id, place, weight, style, CASE style {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _STYLES_SQL.items())} END AS line FROM
  (SELECT id AS analysis_id, 0 AS place, 0 AS weight, 'title' AS kind, '' AS label, 'A message looks ' || level AS text FROM mails WHERE level = 'malicious'
   UNION ALL SELECT id, 1, 1, 'fact', 'From', {_DEFANG_SQL.format("from_addr")} FROM mails WHERE level = 'malicious'
   UNION ALL SELECT id, 2, 3, 'fact', 'Date', strftime(CAST(received_at AS TIMESTAMP), '%Y-%m-%d %H:%M') FROM mails WHERE level = 'malicious'
   UNION ALL SELECT id, 3, 2, 'fact', 'Risk', level FROM mails WHERE level = 'malicious'
   UNION ALL SELECT analysis_id, k * 2 + 8, k * 2 + 8, 'fact', 'Finding', rule || ' (' || category || ')' FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY severity DESC, score DESC, position) AS k FROM findings) WHERE k <= 5 AND analysis_id IN (SELECT id FROM mails WHERE level = 'malicious')
   UNION ALL SELECT analysis_id, k * 2 + 100 + n, k * 2 + 9, CASE n WHEN 0 THEN 'fact' ELSE 'code' END, CASE n WHEN 0 THEN 'Attachment' ELSE 'SHA-256' END, CASE n WHEN 0 THEN {_DEFANG_SQL.format("filename")} ELSE sha256 END
    FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY position) AS k FROM artifacts), (VALUES (0), (1)) t(n) WHERE k <= 5 AND analysis_id IN (SELECT id FROM mails WHERE level = 'malicious')),
  (VALUES ('text'), ('html'), ('slack'), ('discord')) s(style)))) GROUP BY analysis_id, style""",
    )
)
def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every malicious mail's alert in four styles, each fitted to 450 characters."""
    mails = src.mails(spark, sf_dir).filter("level = 'malicious'")
    lines = alert_lines(mails, src.findings(spark, sf_dir), src.artifacts(spark, sf_dir))
    return fitted_all(lines, STYLES, 450, 64)
