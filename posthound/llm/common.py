"""Joins that several operators and pipeline stages share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids that an explicit broadcast may hold (about 16 bytes each); beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000

#: Bytes of an Arrow batch: what a task holds of its input at a time, in the executor and in its Python worker, or one longer row.
BATCH_BYTES = "4m"


def text_batches(rows: DataFrame) -> DataFrame:
    """rows; their session hands batches of at most BATCH_BYTES to Python from now on."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sized(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if they are few; ids should be cheap to count (a written table)."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids(id); null ids match null ids."""
    gone = sized(ids.select(F.col("id").alias("_gone")).distinct())
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
