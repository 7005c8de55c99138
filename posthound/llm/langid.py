"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its hashed byte n-grams (one to three bytes, ASCII letters lower-cased, runs of
other than letters as one space). Each language has several centroids, clustered by spherical k-means; a text takes the
language of the centroid with the largest cosine, and counts as rejected if it is farther from it than nearly all of that
language's own training texts.

Document frequencies count every training document; centroids are clustered on at most `per_language` training documents of
each language (smallest hashes of their ids).

Cases: a null text, or one without any letter, is `und` with score 0 and not rejected; ties go to the language that sorts first; without training
documents every row is `und`; rows with a null language or id train nothing; repeated rows are judged alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.llm import bytesops as bo
from posthound.llm.common import sized, text_batches

DIM = 4096
#: Texts whose counts are held as one matrix.
SLICE = 512
#: Bytes that are part of words: ASCII letters and all of multi-byte characters; the rest reads as a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def tf(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n-gram counts, one row per text."""
    n = len(offs) - 1
    x = _FOLD[buf]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    doc = np.repeat(np.arange(n), np.diff(offs))[keep]
    x = x[keep].astype(np.uint32)
    out = np.zeros(n * DIM, np.float32)
    h = x + np.uint32(1)
    for k in range(3):
        if k:
            if len(x) <= k:
                break
            h = h[:-1] * np.uint32(257) + x[k:] + np.uint32(1)
        same = doc[k:] == doc[: len(doc) - k]
        at = ((h * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((doc[k:] * DIM + at)[same], minlength=n * DIM).astype(np.float32)
    return out.reshape(n, DIM)


def _tf_slices(texts: pa.Array) -> Iterator[np.ndarray]:
    """tf() of at most SLICE texts at a time: its matrix has DIM columns, whatever the texts' lengths."""
    for a, b, buf, offs in bo.chunks(texts, bo.CHUNK_BYTES // 2):
        for s in range(0, b - a, SLICE):
            e = min(b - a, s + SLICE)
            yield tf(buf[offs[s] : offs[e]], offs[s : e + 1] - offs[s])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """DIM + 1 counts over docs(text): documents with each n-gram, and documents."""

    def run(batches):
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            df[DIM] += batch.num_rows
            for counts in _tf_slices(batch.column(0)):
                df[:DIM] += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(df)], names=["bucket", "df"])

    out = np.zeros(DIM + 1, np.int64)
    for r in text_batches(docs.select("text")).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        out[r["bucket"]] = r["df"]
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeds: (unit centroids, each row's cosine to its own)."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).max(1)


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], centroids: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.names, self.centroids, self.least = idf, names, centroids, least


def fit(train: DataFrame, per_language: int = 300, clusters: int = 4, tail: float = 0.005) -> Model | None:
    """A model of train(doc_id, text, lang), rows with a null in any of them left out; None without rows."""
    train = train.filter("doc_id is not null and lang is not null and text is not null and text rlike '\\\\p{L}'")
    df = document_frequencies(train)
    if not df[DIM]:
        return None
    idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 0.05).astype(np.float32)
    # The smallest hashes of each language, of those below a bound that about four times as many stay under: no task sees a whole language.
    ids = train.select("doc_id", "lang").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)))
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    low = ids.join(sized(sizes), "lang").filter(F.col("h").cast("double") * F.col("n") < 4.0 * per_language * (1 << 52))
    own = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = low.withColumn("k", own).filter(F.col("k") <= per_language).select("doc_id").distinct()
    # At most per_language ids a language.
    sample = train.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id", "lang"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").head(per_language)
        x = np.concatenate([vectors(counts, idf) for counts in _tf_slices(pa.array(pdf["text"]))])
        c, cos = cluster(x, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [r.tolist() for r in c], "least": float(np.quantile(cos, tail))})

    rows = sorted(sample.groupBy("lang").applyInPandas(run, "lang string, c array<float>, least double").collect(), key=lambda r: (r["lang"], tuple(r["c"])))
    return Model(idf, [r["lang"] for r in rows], np.array([r["c"] for r in rows], np.float32), np.array([r["least"] for r in rows]))


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and rejected, from docs.text alone."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    cast = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        m = cast.value
        names = np.array(m.names, dtype=object)
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            at = 0
            for counts in _tf_slices(batch.column(len(keep))):
                cos = vectors(counts, m.idf) @ m.centroids.T
                best[at : at + len(cos)], score[at : at + len(cos)] = cos.argmax(1), cos.max(1)
                at += len(cos)
            letter = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            score = np.where(letter, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(score), pa.array(letter & (score < m.least[best]))], names=[*keep, "lang_pred", "score", "rejected"])

    return text_batches(rows).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")), **how)
    return predict(docs, model, ["doc_id", "held_out"])
