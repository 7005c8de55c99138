"""How the wording of each source departs from others of its language: wide term vectors.

Every kept term of a language becomes one array of its counts, indexed by the language's sources in order. Array functions turn
the counts into smoothed shares and emit, term by term, what each pair of sources adds to their divergence; sums are taken
before anything is shuffled. Terms are counted in Arrow batches, and a task adds up what it has read before it passes counts on.

A share is p = 1 + floor(10**9 * (count + 2) / (N + 2 V)): N the counts of all kept terms, V their number; what two shares of a
term add is floor((p - q)**2 / (p + q)). All of it is exact in whole numbers: 64-bit ones where counts allow it, decimals beyond.

Cases: a null text, language or source is the empty string; a text without terms still makes its source occur; terms are cut at
every ASCII character that is no letter, only A-Z is lower-cased; a language without kept terms has pairs of value 0 and no
terms; repeated rows count each; an empty table gives an empty result; extra columns are ignored. A row holds one array as
long as its language has sources, whose pairs are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.llm import bytesops as bo
from posthound.llm.common import sized, text_batches
from posthound.session import written

SCALE = 1_000_000_000
#: Bytes of text whose counts a task adds up before it passes them on.
HELD_BYTES = 8_000_000
#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`: ASCII letters and all of multi-byte characters.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Counts:
    """Counts of (language, source, term) of the texts a task holds."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}

    def add(self, langs: list[str], sources: list[str], buf: np.ndarray, offs: np.ndarray) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        low = bo.LOWER[buf]
        starts, ends, doc = bo.spans(TERM[buf], offs)
        if not len(starts):
            return
        raw = low.tobytes()
        h = bo.span_hashes(low, starts, ends)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        # Hashes only bring equal terms together: a span whose bytes are not those of the first of its hash is taken by itself.
        same = _same_bytes(low, starts, ends, first[inverse])
        known = np.array([self.terms.setdefault(raw[s:e], len(self.terms)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
        term = known[inverse]
        for k in np.flatnonzero(~same).tolist():
            term[k] = self.terms.setdefault(raw[starts[k] : ends[k]], len(self.terms))
        pair, times = np.unique(doc * len(self.terms) + term, return_counts=True)
        self.parts.append((group[pair // len(self.terms)], pair % len(self.terms), times))

    def flush(self, names: list[str]) -> pa.RecordBatch:
        g, t, n = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts, strict=True) if self.parts else ((), (), ())))
        key, inverse = np.unique(g * max(1, len(self.terms)) + t, return_inverse=True)
        count = np.bincount(inverse, n, len(key)).astype(np.int64)
        docs = np.bincount(inverse, minlength=len(key)).astype(np.int64)
        groups, terms = list(self.groups), pa.array(list(self.terms), pa.binary()).cast(pa.string())
        group = key // max(1, len(self.terms))
        # A group without terms in hand still occurs: one row of a null term each.
        bare = np.setdiff1d(np.arange(len(groups)), group)
        group = np.concatenate([group, bare])
        term = pa.concat_arrays([terms.take(pa.array(key % max(1, len(self.terms)))), pa.nulls(len(bare), pa.string())])
        zero = np.zeros(len(bare), np.int64)
        lang, source = (pa.array([x[i] for x in groups], pa.string()).take(pa.array(group)) for i in (0, 1))
        self.__init__()
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([count, zero])), pa.array(np.concatenate([docs, zero]))], names=names)


def _same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span's bytes equal those of span `other` of it."""
    lens = ends - starts
    same = lens == lens[other]
    size = np.where(same, lens, 0)
    heads = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(heads, size)
    differs = buf[step + np.repeat(starts, size)] != buf[step + np.repeat(starts[other], size)]
    same[np.repeat(np.arange(len(size)), size)[differs]] = False
    return same


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); a group's row of a null term only says that it occurs."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held, size = Counts(), 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, buf, offs in bo.chunks(batch.column(2)):
                held.add(langs[a:b], sources[a:b], buf, offs)
                size += len(buf)
                if size >= HELD_BYTES:
                    yield held.flush(names)
                    size = 0
        yield held.flush(names)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    each = text_batches(docs.select(*text)).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, whole: str) -> str:
    """SQL of 1 + floor(SCALE * (count + 2) / whole), exact for any 64-bit count."""
    return f"1 + CASE WHEN {count} < {2**62 // SCALE} THEN ({SCALE}L * ({count} + 2)) DIV ({whole}) ELSE CAST((CAST({count} AS decimal(20,0)) + 2) * {SCALE}BD DIV CAST({whole} AS decimal(20,0)) AS bigint) END"


#: What two shares of a term add; both are below 2 * SCALE, so the square fits 64 bits.
_ADDS = "((a - b) * (a - b)) DIV (a + b)"


def vectors(counts: DataFrame, least_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """(wide(lang, term, vec), stats(lang, sources, ns, v)) of term_counts(): vec[i] counts the term in sources[i], ns[i] is what a
    source's kept terms count in all, v is the number of kept terms."""
    sources = counts.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    sources = written(sources, "sources")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("own"))
    kept = terms.filter(F.col("docs") >= least_docs).join(sized(sources), "lang")
    wide = written(kept.select("lang", "term", F.expr("transform(sources, s -> coalesce(own[s], 0L))").alias("vec")), "vectors")
    sums = wide.select("lang", F.posexplode("vec").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    sums = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("ns"), F.max("v").alias("v"))
    stats = sources.join(sums, "lang", "left").select("lang", "sources", F.expr("coalesce(ns, transform(sources, s -> 0L))").alias("ns"), F.coalesce("v", F.lit(0)).alias("v"))
    return wide, written(stats, "stats")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language (part `pair`), and the
    terms that set it apart from the whole language most (part `term`, ranks to `top`)."""
    wide, stats = vectors(written(term_counts(docs), "counts"), least_docs)
    held = wide.join(sized(stats), "lang")
    shares = held.withColumn("p", F.expr(f"transform(vec, (c, i) -> {_share('c', 'ns[i] + 2 * v')})"))
    pairs = F.expr(f"flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), (b, k) -> struct(i AS i, i + 1 + k AS j, {_ADDS} AS f))))")
    sums = shares.select("lang", F.explode(pairs).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("f"))
    every = stats.select("lang", "sources", F.explode(F.expr("flatten(transform(sources, (s, i) -> transform(slice(sources, i + 2, size(sources)), (t, k) -> struct(i AS i, i + 1 + k AS j))))")).alias("x")).select("lang", "sources", "x.*")
    each = every.join(sums, ["lang", "i", "j"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    both = F.explode(F.array(F.struct(F.expr("sources[i]").alias("source"), F.expr("sources[j]").alias("item")), F.struct(F.expr("sources[j]").alias("source"), F.expr("sources[i]").alias("item"))))
    apart = each.select("lang", "f", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", F.col("f").alias("value"))
    whole = shares.withColumn("q", F.expr(f"aggregate(array(aggregate(vec, 0L, (s, c) -> s + c)), 0L, (z, c) -> {_share('c', 'aggregate(ns, 0L, (s, n) -> s + n) + 2 * v')})"))
    own = F.expr("filter(transform(p, (a, i) -> struct(sources[i] AS source, vec[i] AS n, a AS p)), x -> x.n > 0 AND x.p > q)")
    terms = whole.select("lang", "term", "q", F.explode(own).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((x.p - q) * (x.p - q)) DIV (x.p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return apart.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, rn, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc_id, row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT rn) >= 10),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
v AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM groups) g),
counts AS (SELECT g.lang, g.source, k.term, count(w.term) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL),
p AS (SELECT *, CAST(1 + (CAST({SCALE} AS HUGEINT) * (c + 2)) // CAST(sum(c) OVER (PARTITION BY lang, source) + 2 * v AS HUGEINT) AS HUGEINT) AS p FROM counts JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + (CAST({SCALE} AS HUGEINT) * (c + 2)) // CAST(sum(c) OVER (PARTITION BY lang) + 2 * v AS HUGEINT) AS HUGEINT) AS q FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
