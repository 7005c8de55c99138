"""Rule tables of any size over bytes: an inverted index of literal anchors proposes, the patterns decide.

Every pattern names a literal that each of its matches holds. The windows of all rows that are some pattern's literal are found by
hash in Arrow batches and joined with the patterns; a pattern is tried only where its literal was met, and once a row however many
rules share it. A rule is proposed by its rarest patterns only: of m patterns of which n must match, any m - n + 1 hold one that
does. The plan has the same size for one rule and for thousands. A pattern without a literal of four bytes is tried on every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from posthound.plans.registry import Registry
from posthound.session import written
from posthound.sources import adapters as src

R = Registry()
GRAM = 4
#: Lengths of the literals that are indexed: of a longer one, as many of its leading bytes.
LENGTHS = (*range(GRAM, 17), 20, 24, 32)
#: Bits of the table by which tasks leave out windows that are nobody's literal; its 16 MB serve any number of rules.
BITS = 27
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Lower case of bytes as characters of ISO-8859-1.
_LOWER = np.array([ord(chr(i).lower()) if ord(chr(i).lower()) < 256 else i for i in range(256)], np.uint8)


def anchor(pattern: str) -> str:
    """The longest literal that every match of a regular expression holds; '' if none is sure.

    Only plain characters outside groups and classes count, and only if nothing makes the last of them optional or an
    alternative of something else.
    """
    best, run, depth, i, n = "", "", 0, 0, len(pattern)

    def close() -> None:
        nonlocal best, run
        if len(run) > len(best):
            best = run
        run = ""

    while i < n:
        c = pattern[i]
        if c == "\\":
            literal = pattern[i + 1 : i + 2] if not pattern[i + 1 : i + 2].isalnum() else None
            step = 2
        elif c == "[":
            j = i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3
            while j < n and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            literal, step = None, j + 1 - i
        elif c == "{":  # a count
            literal, step = None, max(pattern.find("}", i), i) + 1 - i
        else:
            literal, step = (None if c in "().^$|?*+}" else c), 1
        if c == "|" and depth == 0 or pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
            return ""
        depth += (c == "(") - (c == ")")
        after = pattern[i + step : i + step + 1]
        if literal is None or depth:
            close()
        elif after in ("?", "*", "{") and after:
            close()
        elif after == "+":
            run += literal
            close()
        else:
            run += literal
        i += step
    close()
    return best


def window_hashes(raw: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of every window of that length) of bytes, for ascending lengths."""
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, lengths[-1] + 1):
        if n > len(raw):
            return
        h = h[: len(raw) - n + 1] * _BASE + (raw[n - 1 :] + np.uint64(1))
        if n in lengths:
            mixed = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * _MIX
            yield n, mixed ^ (mixed >> np.uint64(32))


@F.pandas_udf(T.StructType().add("literal", T.StringType()).add("length", T.IntegerType()).add("hash", T.LongType()))
def _literals(patterns: pd.Series) -> pd.DataFrame:
    """The literal of each pattern, and the length and hash of its indexed bytes (null: none of four bytes)."""

    def one(p: str | None):
        held = anchor(p or "")
        raw = held.encode("latin-1", "ignore")
        if len(raw) < GRAM or len(raw) != len(held):
            return held, None, None
        n = max(k for k in LENGTHS if k <= len(raw))
        ((_, h),) = window_hashes(np.frombuffer(raw[:n], np.uint8).astype(np.uint64), (n,))
        return held, n, int(h.view(np.int64)[0])

    held, n, h = zip(*[one(p) for p in patterns], strict=True) if len(patterns) else ((), (), ())
    # By column: hashes beside nulls would become floating-point numbers.
    return pd.DataFrame({"literal": pd.Series(held, dtype="object"), "length": pd.Series(n, dtype="Int32"), "hash": pd.Series(h, dtype="Int64")})


def index(rules: DataFrame) -> DataFrame:
    """rule, place, pattern, need of rules(rule, need, patterns array<string>)."""
    return rules.select("rule", F.coalesce("need", F.lit(1)).alias("need"), F.posexplode("patterns").alias("place", "pattern")).filter("pattern is not null")


def row_literals(rows: DataFrame, key: str, data: str, lengths: tuple[int, ...], words: np.ndarray) -> DataFrame:
    """key, hash: the distinct windows of the lower-cased bytes of rows(key, data binary), and of those without zeros, whose bits are set in words."""
    kind = rows.select(key).schema
    schema = kind.add("hash", "long")

    def found(raw: np.ndarray) -> list[np.ndarray]:
        out = []
        for _, h in window_hashes(raw.astype(np.uint64), lengths):
            bit = h >> np.uint64(64 - BITS)
            out.append(h[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [], []
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer()
                if raw is None:
                    continue
                low = _LOWER[np.frombuffer(raw, np.uint8)]
                own = found(low)
                if (low == 0).any():
                    own += found(low[low != 0])
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *own])).view(np.int64)
                at.append(np.full(len(own), i))
                hashes.append(own)
            at, hashes = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *hashes])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes)], names=[key, "hash"])

    return rows.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, schema)


def _bit_words(hashes: DataFrame) -> np.ndarray:
    """The table of bits of hashes(hash), as 64-bit words; made by Spark, at most 2**21 words come to the driver."""
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    each = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))").alias("b"))
    held = each.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[held.column("w").to_numpy()] = held.column("b").to_numpy().view(np.uint64)
    return words


def pattern_hits(rows: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """key, kind, size, pattern: each of patterns(pattern), distinct, that fits rows(key, kind, data binary)."""
    known = written(patterns.select("pattern", _literals("pattern").alias("l")).select("pattern", (F.col("l.literal") == F.col("pattern")).alias("plain"), "l.length", "l.hash"), "literals")
    own = known.filter("hash is not null")
    lengths = tuple(sorted(r["length"] for r in own.select("length").distinct().collect()))
    always = known.filter("hash is null").select("pattern", "plain").collect()
    every = F.array(*[F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(r["plain"]).alias("plain")) for r in always]) if always else None
    none = F.array().cast("array<struct<pattern:string,plain:boolean>>")
    if lengths:
        met = row_literals(rows, key, "data", lengths, _bit_words(own)).join(own.hint("merge"), "hash")
        tried = met.groupBy(key).agg(F.collect_list(F.struct("pattern", "plain")).alias("tried"))
        rows = rows.hint("merge").join(tried, key, "left" if always else "inner")
    else:
        rows = rows.withColumn("tried", none)
    if always:
        rows = rows.withColumn("tried", F.concat(F.coalesce("tried", none), every))
    texts = rows.withColumn("text", F.lower(F.decode("data", "ISO-8859-1"))).withColumn("wide", F.when(F.instr("text", "\0") > 0, F.translate("text", "\0", "")))
    rx = lambda c, p: F.when(p["plain"], F.contains(F.col(c), p["pattern"])).otherwise(F.call_function("rlike", F.col(c), p["pattern"]))
    fits = F.filter("tried", lambda p: rx("text", p) | F.coalesce(rx("wide", p), F.lit(False)))
    return texts.select(key, "kind", F.octet_length("data").alias("size"), F.explode(fits).alias("p")).select(key, "kind", "size", "p.pattern")


def scan_table(rows: DataFrame, rules: DataFrame, key: str = "id", data: str = "data", kind: str | None = None, prefix: str = "yara") -> DataFrame:
    """key, rule, family, score of each rule that fits rows(key, data binary or string, kind); keys are distinct.

    rules(rule, family, score, need, kinds, most, patterns) as claims.read_rules() gives them, any number of them. Patterns are
    lower-case regular expressions over bytes, sought in the lower-cased bytes and in those without zeros. Null data fits no rule.
    """
    members = written(index(rules), "patterns")
    rows = rows.select(key, (F.col(kind) if kind else F.lit("")).alias("kind"), F.col(data).cast("binary").alias("data")).filter("data is not null")
    hits = written(pattern_hits(rows, members.select("pattern").distinct(), key), "hits")
    # Of a rule's patterns the rarest lead, so many that one of them must match; the others are counted where a leading one was met.
    often = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("often"))
    own = W.partitionBy("rule")
    ranked = members.join(often, "pattern", "left").withColumns({"k": F.row_number().over(own.orderBy(F.coalesce("often", F.lit(0)), "place", "pattern")), "lead": F.count(F.lit(1)).over(own) - F.min("need").over(own) + 1, "all": F.count(F.lit(1)).over(own)})
    ranked = written(ranked.select("rule", "place", "pattern", (F.col("k") <= F.col("lead")).alias("leads"), (F.col("lead") < F.col("all")).alias("more")), "leads")
    first = hits.join(ranked.filter("leads").hint("merge"), "pattern").select(key, "kind", "size", "rule", "place", "more")
    asked = first.filter("more").select(key, "rule").distinct().join(ranked.filter("not leads").select("rule", "place", "pattern").hint("merge"), "rule")
    rest = asked.hint("merge").join(hits, [key, "pattern"]).select(key, "kind", "size", "rule", "place")
    counted = first.drop("more").unionByName(rest).groupBy(key, "kind", "size", "rule").agg(F.count_distinct("place").alias("n"))
    known = rules.select("rule", "family", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("need", F.lit(1)).alias("need"), "kinds", "most")
    right = F.coalesce(F.exists("kinds", lambda k: F.coalesce(F.col("kind"), F.lit("")).startswith(k)), F.lit(True))
    right = (F.col("n") >= F.col("need")) & (F.col("most").isNull() | (F.col("size") <= F.col("most"))) & (right | (F.size("kinds") == 0))
    return counted.join(known.hint("merge"), "rule").filter(right).select(key, F.concat(F.lit(f"{prefix}."), "rule").alias("rule"), "family", "score")


@R.add(
    """WITH w AS (SELECT w, length(w) + ascii(w) AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '[a-z]{10,}')) AS w FROM pages))
SELECT page_id, 'yara.' || w AS rule, CASE WHEN k % 3 = 0 THEN 'F' || k % 7 END AS family, CAST(k % 100 AS INTEGER) AS score FROM pages JOIN w ON contains(lower(html), w)
WHERE (k % 2 = 0 OR contains(lower(html), 'lang="es"')) AND (k % 5 > 0 OR octet_length(encode(html)) <= 4000)"""
)
def rule_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every long word of the pages, some for Spanish or for small pages only."""
    pages = src.table(spark, sf_dir, "pages")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{10,}"), F.lit(0))).alias("rule")).distinct()
    k, spanish = F.length("rule") + F.ascii("rule"), F.lit('lang="es"')
    rules = words.select(
        "rule",
        F.when(k % 3 == 0, F.concat(F.lit("F"), (k % 7).cast("string"))).alias("family"),
        (k % 100).cast("int").alias("score"),
        (1 + k % 2).alias("need"),
        F.lit(None).cast("array<string>").alias("kinds"),
        F.when(k % 5 == 0, F.lit(4000)).cast("long").alias("most"),
        F.when(k % 2 == 0, F.array("rule")).otherwise(F.array("rule", spanish)).alias("patterns"),
    )
    return scan_table(pages.select("page_id", "html"), written(rules, "rules"), "page_id", "html")
