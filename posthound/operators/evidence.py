"""Nested evidence of findings: JSON read as VARIANT, bounded in depth, length and number, and laid out as rows of paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.plans.registry import Registry
from posthound.session import spread
from posthound.sources import adapters as src

R = Registry()
#: Bounds of stored evidence: nesting below the root, code points of a string and of a key, members of an object, items of a list, code points of the whole.
DEPTH, CHARS, KEY_CHARS, MEMBERS, ITEMS, WHOLE = 6, 2000, 200, 100, 200, 64_000
CUT = "…"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _quoted(text: Column) -> Column:
    """text as a JSON string: that of a list of one, without its brackets."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _as_object(v: Column) -> Column:
    return F.map_entries(v.try_cast("map<string,variant>"))


def _as_list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _short_key(key: Column, most: int) -> Column:
    """A key of at most `most` code points; a longer one ends in a hash, so that two keys never become one."""
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.substring(key, 1, most - 17), F.lit(CUT), F.substring(F.sha2(key, 256), 1, 16)))


def _parts(v: Column) -> Column:
    """The members or items of a container as one array of (key, value), null for a leaf; the key of an item is null."""
    items = F.transform(_as_list(v), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(_as_object(v), items)


def _bounded(v: Column, left: int, chars: int, key_chars: int, members: int, items: int) -> Column:
    if left < 0:
        return F.lit(f'"{CUT}"')
    is_object = _as_object(v).isNotNull()
    one = lambda e: F.concat(F.when(e["key"].isNull(), F.lit("")).otherwise(F.concat(_quoted(_short_key(e["key"], key_chars)), F.lit(":"))), _bounded(e["value"], left - 1, chars, key_chars, members, items))
    inside = F.array_join(F.transform(F.slice(_parts(v), F.lit(1), F.when(is_object, members).otherwise(items)), one), ",")
    container = F.concat(F.when(is_object, "{").otherwise("["), inside, F.when(is_object, "}").otherwise("]"))
    text = v.try_cast("string")
    leaf = F.when(F.schema_of_variant(v) == "STRING", _quoted(F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(CUT))).otherwise(text))).otherwise(F.to_json(v))
    return F.coalesce(container, leaf)


def bounded(text: Column, depth: int = DEPTH, chars: int = CHARS, key_chars: int = KEY_CHARS, members: int = MEMBERS, items: int = ITEMS, whole: int = WHOLE) -> Column:
    """JSON evidence as it is stored: keys in bytewise order, what exceeds a bound cut and marked by an ellipsis.

    Values deeper than `depth` below the root become the ellipsis, strings keep `chars` code points, objects their first
    `members` keys, lists their first `items`. What is still longer than `whole` becomes {"_truncated":true,"keys":[...]} with at
    most 50 keys of the root. Null stays null; text that is no JSON (or repeats a key in one object) becomes a JSON string of it.
    The expression grows with the depth, not with what is nested; nothing leaves the JVM.
    """
    plain = _quoted(F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(CUT))).otherwise(text))

    def short(x: Column) -> Column:
        keys = F.transform(F.slice(F.coalesce(_as_object(x["v"]), F.array().cast("array<struct<key:string,value:variant>>")), 1, 50), lambda e: _short_key(e["key"], 100))
        return F.when(x["v"].isNull(), plain).when(F.length(x["out"]) > whole, F.to_json(F.struct(F.lit(True).alias("_truncated"), keys.alias("keys")))).otherwise(x["out"])

    parsed = _once(F.try_parse_json(text), lambda v: F.struct(v.alias("v"), _bounded(v, depth, chars, key_chars, members, items).alias("out")))
    return F.when(text.isNotNull(), _once(parsed, short))


_LEAVES = "array<struct<path:string,kind:string,value:string>>"


def _leaves(v: Column, path: Column, left: int) -> Column:
    is_object, kind = _as_object(v).isNotNull(), F.schema_of_variant(v)
    named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    here = lambda k, value: F.array(F.struct(path.alias("path"), k.alias("kind"), value.alias("value"))).cast(_LEAVES)
    leaf = here(named, F.when(kind == "STRING", v.try_cast("string")).when(kind != "VOID", F.to_json(v)))
    shell = F.when(is_object, "object").otherwise("list")
    if left == 0:
        return F.when(_parts(v).isNull(), leaf).otherwise(here(shell, F.to_json(v)))
    step = lambda e: F.when(e["key"].isNull(), F.lit("[*]")).when(e["key"].rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), e["key"])).otherwise(F.concat(F.lit("["), _quoted(e["key"]), F.lit("]")))
    below = F.flatten(F.transform(_parts(v), lambda e: _leaves(e["value"], F.concat(path, step(e)), left - 1)))
    return F.when(_parts(v).isNull(), leaf).when(F.size(_parts(v)) == 0, here(shell, F.lit(None).cast("string"))).otherwise(below)


def leaves(rows: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """key, path, kind, value: one row per leaf of JSON evidence, all items of a list under one path `[*]`.

    kind is string, number, boolean, null, object or list; the last two stand for empty containers (value null) and for those
    at `depth` (value: their JSON). Keys that are no plain names stand in brackets. Null and unreadable text have no row.
    """
    v = F.try_parse_json(F.col(text))
    found = rows.select(key, F.explode(F.when(v.isNotNull(), _leaves(v, F.lit("$"), depth))).alias("leaf"))
    return found.select(key, "leaf.*")


def path_counts(found: DataFrame, key: str) -> DataFrame:
    """path, kind, n, n_events, n_values, least of found(key, path, kind, value): leaves, different keys, different values, the least value.

    Where found is dealt by key, only counts per value leave a task: each key is counted with one of its values of a path.
    """
    own = W.partitionBy(key, "path", "kind").orderBy("value")
    once = found.groupBy(key, "path", "kind", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(own))
    # A null key is no key, as in count(distinct).
    per_value = once.groupBy("path", "kind", "value").agg(F.sum("n").alias("n"), F.count_if((F.col("k") == 1) & F.col(key).isNotNull()).alias("e"))
    return per_value.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.sum("e").alias("n_events"), F.count("value").alias("n_values"), F.min("value").alias("least"))


_DOC_BOUNDS = {"depth": 3, "chars": 60, "members": 5, "items": 12, "whole": 260}


@R.add(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
c AS (SELECT *, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS cut FROM d),
w AS (SELECT *, list_transform(string_split(text, ' ')[1:12], lambda x: CAST(to_json(CASE WHEN length(x) > 60 THEN substr(x, 1, 60) || '…' ELSE x END) AS VARCHAR)) AS w FROM c),
j AS (SELECT doc_id, '{"count":' || CAST(length(text) AS VARCHAR) || ',"empty":{},"nest":{"a":{"b":"…"}},"text":' || CAST(to_json(cut) AS VARCHAR) || ',"words":[' || array_to_string(w, ',') || ']}' AS whole FROM w),
k AS (SELECT doc_id, replace(whole, '{"a":{"b":"…"}}', '{"a":{"b":["…","…"]}}') AS whole FROM j)
SELECT doc_id, CASE WHEN length(whole) > 260 THEN '{"_truncated":true,"keys":["count","empty","nest","text","words","zone"]}' ELSE whole END AS evidence FROM k"""
)
def bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each document, its keys out of order and one too many, its words a list and its source nested too deep."""
    text, origin = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    nest = F.struct(F.struct(F.array(origin, origin).alias("b")).alias("a"))
    made = F.to_json(F.struct(F.lit("utc").alias("zone"), F.split(text, " ", -1).alias("words"), text.alias("text"), nest.alias("nest"), F.struct().alias("empty"), F.length(text).alias("count")))
    return src.table(spark, sf_dir, "documents").select("doc_id", bounded(made, **_DOC_BOUNDS).alias("evidence"))


@R.add(
    """WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT event_id, '$.at.user' AS path, 'number' AS kind, CAST(user_id AS VARCHAR) AS value FROM e UNION ALL SELECT event_id, '$["is late"]', 'boolean', CAST(user_id % 2 = 0 AS VARCHAR) FROM e
  UNION ALL SELECT event_id, '$.props.k', 'number', CAST(k AS VARCHAR) FROM e WHERE k IS NOT NULL UNION ALL SELECT event_id, '$.tags[*]', 'string', unnest([event_type, 't' || CAST(user_id % 3 AS VARCHAR)]) FROM e
  UNION ALL SELECT event_id, '$.none', 'list', NULL FROM e)
SELECT path, kind, count(*) AS n, count(DISTINCT event_id) AS n_events, count(DISTINCT value) AS n_values, min(value) AS least FROM l GROUP BY path, kind"""
)
def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence holds: per path and kind the leaves, the events and the different values."""
    rest = F.to_json(F.struct(F.struct(F.col("user_id").alias("user")).alias("at"), (F.col("user_id") % 2 == 0).alias("is late"), F.array("event_type", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))).alias("tags"), F.array().cast("array<string>").alias("none")))
    joined = F.concat(F.expr("substring(rest, 1, length(rest) - 1)"), F.lit(',"props":'), "props", F.lit("}"))
    events = spread(src.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), 150_000, "event_id")
    rows = events.withColumn("rest", rest).select("event_id", joined.alias("evidence"))
    return path_counts(leaves(rows, "event_id", "evidence"), "event_id")
