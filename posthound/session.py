"""Session builder and the shared folder in which jobs cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "posthound", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where all run on this machine, a folder of our own stands in for it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='posthound-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes of an Arrow batch: what a task holds of its input at a time, in the executor and in its Python worker, or one longer row.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """The session hands batches of at most BATCH_BYTES to Python from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shares(table: DataFrame, per: int) -> int:
    """Tasks of about `per` rows of a table that is cheap to count, one for each core at least."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // per))


def spread(table: DataFrame, per: int, *keys: str) -> DataFrame:
    """table dealt by keys over tasks of about `per` rows.

    A table of short rows is one small file, which is one task whatever the rows are made into; and a fixed number of
    shuffle partitions makes tasks as large as the input.
    """
    return table.repartition(shares(table, per), *keys)


_written: list[str] = []


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once into the shared folder and read it back: later steps neither recompute it nor depend on executors' disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/posthound/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables written between two marks; only for callers whose results no longer need them."""
    for path in _written[since:until]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:until]
