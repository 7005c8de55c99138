"""Quality classifier by importance resampling over hashed n-grams.

Two generative models, of target text and of raw text, give each hashed n-gram (words, word pairs and pairs of word shapes) the
chance that a document holds it. A document's log importance weight is the sum of its n-grams' log ratios; a ratio counts as
none if it is within `dead` of 1 or within `sigmas` of chance, so that the weight tells what the target lacks or favours and
not how long the text is. Gumbel top-k then draws k documents without replacement with chances in proportion to their weights:
standard Gumbel noise is added to each log weight, at temperature 1, and the k largest sums are drawn. k is a given share of the
documents or, by default, as many as weigh at least the cut that best parts accepted from rejected labelled rows.

The target model and the cut are fitted on at most `sample` labelled rows (smallest hashes of their ids); the raw model
counts every document.

Cases: a null or empty text has weight 0; without labels of both kinds every document is kept; label rows without a
document, or with a null quality or toxic, train nothing; an id with contrary labels counts as rejected; repeated rows and ties at
the last place are drawn together; empty tables give empty results; extra columns pass through resample() unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthound.llm import bytesops as bo
from posthound.llm.common import text_batches
from posthound.llm.hilbert import ranked
from posthound.session import written

BUCKETS = 1 << 16
KINDS = 3
TOTAL = KINDS * BUCKETS
#: Weights are sums of whole 1/4096 nats, so that a document's weight is the same whatever batch it is in.
UNIT = 4096
_UP, _DIGIT, _ALPHA = (np.zeros(256, np.int64) for _ in range(3))
_UP[65:91] = 1
_DIGIT[48:58] = 1
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = 1


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of the distinct n-grams of each text, in text order."""
    starts, ends, doc = bo.words(buf, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = bo.span_hashes(bo.LOWER[buf], starts, ends)
    up, digit, alpha = (np.add.reduceat(t[buf], starts) for t in (_UP, _DIGIT, _ALPHA))
    length = ends - starts
    last, before = buf[ends - 1].astype(np.int64), buf[np.maximum(ends - 2, starts)]
    tail = np.where(_ALPHA[last] + _DIGIT[last] > 0, 0, last)
    joined = np.concatenate([[False], doc[1:] == doc[:-1]])
    again = joined & np.concatenate([[False], h[1:] == h[:-1]])
    shape = tail * 128 + ((tail > 0) & (before == last)) * 64 + np.minimum(up, 2) * 16 + (digit > 0) * 8 + (up >= alpha) * 4 + (alpha == 0) * 2 + again + 32768 * (length > 24)
    shape = bo.mix(shape.astype(np.uint64) + np.uint64(77))
    prev = lambda x: np.where(joined, np.concatenate([[np.uint64(0)], x[:-1]]), np.uint64(1))
    grams = (h, bo.mix(prev(h) * np.uint64(3) + h), bo.mix(prev(shape) * np.uint64(3) + shape))
    # 32-bit keys sort much faster, and nearly every chunk has few enough texts for them.
    kind = np.uint32 if len(offs) * TOTAL < 1 << 32 else np.int64
    base = (doc * TOTAL).astype(kind)
    held = np.concatenate([base + (g % np.uint64(BUCKETS)).astype(kind) + kind(k * BUCKETS) for k, g in enumerate(grams)])
    held.sort()
    held = held[np.concatenate([[True], held[1:] != held[:-1]])]
    text, bucket = np.divmod(held, kind(TOTAL))
    return bucket.astype(np.int64), text.astype(np.int64)


def counts(docs: DataFrame, good: np.ndarray) -> DataFrame:
    """bucket, raw, target: documents with each n-gram among docs(id, text), and among those whose id is in `good`; bucket TOTAL: all."""

    def run(batches):
        raw, target = np.zeros(TOTAL + 1, np.int64), np.zeros(TOTAL + 1, np.int64)
        for batch in batches:
            ids = np.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            known = np.isin(ids, good) & ~np.asarray(batch.column(0).is_null())
            raw[TOTAL] += len(ids)
            target[TOTAL] += int(known.sum())
            for a, b, buf, offs in bo.chunks(batch.column(1)):
                f, doc = features(buf, offs)
                raw += np.bincount(f, minlength=len(raw))
                target += np.bincount(f[known[a:b][doc]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return text_batches(docs).mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(table: list, prior: float, dead: float, sigmas: float) -> np.ndarray:
    """Per bucket, in whole units: log((target + prior) / (expected + prior)) where raw text would give `expected`; 0 if it tells nothing."""
    raw, target = np.zeros(TOTAL + 1), np.zeros(TOTAL + 1)
    for b, r, t in table:
        raw[b], target[b] = r, t
    expected = raw * (target[TOTAL] / max(1.0, raw[TOTAL]))
    out = np.log((target + prior) / (expected + prior))
    deviance = 2 * (np.where(target > 0, target * np.log(np.maximum(target, 1e-9) / np.maximum(expected, 1e-9)), 0) - (target - expected))
    tells = (np.abs(out) >= dead) & (deviance > sigmas * sigmas)
    return np.where(tells, np.rint(out * UNIT), 0).astype(np.int64)[:TOTAL]


class Model:
    def __init__(self, ratios: np.ndarray, least: tuple | None, kept: int, weights: DataFrame | None) -> None:
        self.ratios, self.least, self.kept, self.weights = ratios, least, kept, weights


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, temperature: float) -> DataFrame:
    """docs with log_weight and _key (its perturbed weight); the Gumbel noise is a function of id and text."""
    cast = docs.sparkSession.sparkContext.broadcast(ratios)
    rest = docs.columns
    at = rest.index(text_col)
    schema = T.StructType(list(docs.schema.fields)).add("log_weight", "double").add("_noise", "double")
    seeded = docs.withColumn("_noise", F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), F.lit(1 << 52)).cast("double"))

    def run(batches):
        table = cast.value
        for batch in batches:
            sums = np.zeros(batch.num_rows, np.int64)
            for a, b, buf, offs in bo.chunks(batch.column(at)):
                f, doc = features(buf, offs)
                sums[a:b] = np.bincount(doc, weights=table[f], minlength=b - a)  # whole numbers, so exact
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums / UNIT), batch.columns[-1]], names=[*rest, "log_weight", "_noise"])

    out = text_batches(seeded).mapInArrow(run, schema)
    gumbel = -F.log(-F.log((F.col("_noise") + 0.5) / float(1 << 52)))
    return out.withColumn("_key", F.col("log_weight") + temperature * gumbel).drop("_noise")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 40_000, prior: float = 0.5, dead: float = 1.0, sigmas: float = 4.5, temperature: float = 1.0, share: float | None = None) -> Model:
    """Count, calibrate and find the last place that Gumbel top-k fills. share: part of the documents to draw; None: by the labels."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    # Bounded by `sample` rows.
    rows = known.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    good = np.sort(np.array([r["id"] for r in rows if r["good"]], dtype=np.int64))
    bad = np.sort(np.array([r["id"] for r in rows if not r["good"]], dtype=np.int64))
    if not len(good) or not len(bad):
        return Model(np.zeros(TOTAL, np.int64), None, 0, None)
    # One row per bucket.
    ratios = log_ratios(counts(plain, good).collect(), prior, dead, sigmas)
    thin = written(weigh(plain, ratios, "id", "text", temperature).select("id", "log_weight", "_key", F.xxhash64("text").alias("_text")), "weights")
    if share is None:
        marks = docs.sparkSession.createDataFrame([(r["id"], r["good"]) for r in rows], "id long, good boolean")
        # One row per eighth of a nat in which labelled documents lie.
        seen = thin.join(F.broadcast(marks), "id").groupBy((F.rint(F.col("log_weight") * 8) / 8).alias("w")).agg(F.sum(F.col("good").cast("long")).alias("yes"), F.sum((~F.col("good")).cast("long")).alias("no")).orderBy("w").collect()
        kept = thin.filter(F.col("log_weight") >= best_cut([(r["w"], r["yes"], r["no"]) for r in seen])).count()
    else:
        kept = round(share * thin.count())
    order = ranked(thin.withColumn("_down", -F.col("_key")), ["_down", "id", "_text"])
    last = order.filter(F.col("rank") == kept - 1).select("_key", "id", "_text").first()
    return Model(ratios, (last["_key"], last["id"], last["_text"]) if last else None, kept, order)


def best_cut(seen: list[tuple[float, int, int]], loss: float = 2.0) -> float:
    """The weight from which on rows are accepted: the largest share of rejected rows caught less `loss` times that of accepted rows lost."""
    yes, no = max(1, sum(r[1] for r in seen)), max(1, sum(r[2] for r in seen))
    best, cut, lost, caught = 0.0, float("-inf"), 0, 0
    for w, y, n in seen:
        lost, caught = lost + y, caught + n
        if caught / no - loss * lost / yes > best:
            best, cut = caught / no - loss * lost / yes, w + 1 / 16
    return cut


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, **how) -> DataFrame:
    """The rows of docs that Gumbel top-k draws, with all their columns."""
    model = fit(docs, labels, id_col, text_col, temperature=temperature, **how)
    if model.weights is None:
        return docs
    if model.least is None:
        return docs.limit(0)
    key, last_id, last_text = model.least
    own = F.col(id_col).cast("long")
    tied = own.isNull() | (own < last_id) | ((own == last_id) & (F.xxhash64(text_col) <= last_text)) if last_id is not None else own.isNull() & (F.xxhash64(text_col) <= last_text)
    scored = weigh(docs, model.ratios, id_col, text_col, temperature)
    return scored.filter((F.col("_key") > key) | ((F.col("_key") == key) & tied)).select(*docs.columns)


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, log_weight, gumbel_key, draw (place from 1) of the documents drawn."""
    model = fit(docs, labels, **how)
    if model.weights is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"), F.lit(None).cast("long").alias("draw"))
    return model.weights.filter(F.col("rank") < model.kept).select(F.col("id").alias("doc_id"), "log_weight", F.col("_key").alias("gumbel_key"), (F.col("rank") + 1).alias("draw"))
