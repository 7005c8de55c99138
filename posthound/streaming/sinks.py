"""An effectively-once sink of results with their children: several relations that appear together or not at all.

Layout under one folder: `<relation>/epoch=E/bucket=B/*.parquet` and `_epochs/E`, a manifest of one row. An epoch's relations are
written first and its manifest last, in one file move; readers take only epochs with a manifest. An epoch that is delivered again
is written anew if it has no manifest, and left alone if it has. The bucket is a hash of a result's natural key, so a batch looks
for keys that are stored already only in the buckets of its own keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.operators.dml import KEY, new_results, with_keys

#: Relations: the results, and the columns of them that hold children.
PARENT, CHILDREN = "results", ("artifacts", "findings")


def bucket_of(key: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifests(spark: SparkSession, path: str) -> dict[int, dict]:
    """What each finished epoch holds, by epoch: rows of each relation and the buckets they lie in."""
    fs, at = _fs(spark, f"{path}/_epochs")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    out = {}
    for name in (n for n in names if n.isdigit()):
        fs, at = _fs(spark, f"{path}/_epochs/{name}")
        file = fs.open(at)
        try:
            out[int(name)] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()
    return out


def _publish(spark: SparkSession, path: str, epoch: int, content: dict) -> None:
    """The manifest appears by one rename, whole."""
    fs, tmp = _fs(spark, f"{path}/_epochs/.{epoch}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.rename(tmp, _fs(spark, f"{path}/_epochs/{epoch}")[1])


def read(spark: SparkSession, path: str, relation: str, schema, buckets: list[int] | None = None, known: dict[int, dict] | None = None) -> DataFrame:
    """A relation's rows of all finished epochs; only those of some buckets, if given, and only folders that hold them are listed."""
    known = manifests(spark, path) if known is None else known
    folders = [f"{path}/{relation}/epoch={e}/bucket={b}" for e, m in sorted(known.items()) for b in m["buckets"].get(relation, []) if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def results_sink(path: str, buckets: int = 64, children: tuple[str, ...] = CHILDREN, fail_before: Callable[[str, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of results whose `children` columns are arrays of structs.

    Results whose natural key is stored already are left out with all their children. fail_before(step, epoch) is called before
    each relation and before the manifest; tests let it raise.
    """
    step = fail_before or (lambda name, epoch: None)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = manifests(spark, path)
        if epoch in known:
            return
        batch = batch.persist()
        try:
            flat = batch.drop(*children).schema
            keyed = with_keys(batch).withColumn("bucket", bucket_of([F.col(k) for k in KEY], buckets))
            own = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most `buckets`
            fresh = new_results(batch, read(spark, path, PARENT, flat, own, known))
            fresh = with_keys(fresh).withColumn("bucket", bucket_of([F.col(k) for k in KEY], buckets)).persist()
            held = {"rows": {}, "buckets": {}}
            relations = {PARENT: fresh.drop(*children)} | {c: fresh.select(F.col("id").alias("result_id"), "bucket", F.posexplode(c).alias("position", "child")).select("result_id", "bucket", "position", "child.*") for c in children}
            for name, rows in relations.items():
                step(name, epoch)
                rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/epoch={epoch}")
                counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
                held["rows"][name], held["buckets"][name] = sum(r["n"] for r in counts), sorted(r["bucket"] for r in counts)
            step("manifest", epoch)
            _publish(spark, path, epoch, held)
            fresh.unpersist()
        finally:
            batch.unpersist()

    return write


def schema_of(rows: DataFrame, relation: str):
    """The schema in which a relation of these results is stored."""
    if relation == PARENT:
        return rows.drop(*CHILDREN).schema
    return rows.select(F.col("id").alias("result_id"), F.posexplode(relation).alias("position", "child")).select("result_id", "position", "child.*").schema
