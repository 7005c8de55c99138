"""Sharding by a Hilbert curve over several metadata columns, in DataFrame operations only.

Each dimension is quantised to `bits` bits, the cell's index on the Hilbert curve orders the rows, and the order is cut into
runs of equal length: shards cover small boxes of the metadata space, so that readers skip most of them by their bounds.

Cases: null dimensions take cell 0; equal texts of one cell lie together, those of other languages or sources lie with their own cell; repeated rows keep their places side by side;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.llm.common import bound
from posthound.session import written


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of cell (dims), each 0 to 2**bits - 1, by the transpose of its axes; at most 63 bits in all."""
    n = len(dims)
    if n * bits > 63 or n < 2:
        raise ValueError("two dimensions or more, and at most 63 bits in all")
    cell = F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        first, own = x[0], F.get(x, i)
        hit = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(k == 0, F.when(hit, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))).when((k == i) & ~hit, own.bitwiseXOR(swap)).otherwise(v))

    halves = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    zero = F.lit(0).cast("long")

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), zero, lambda a, v: a.bitwiseXOR(v)))

    def tail(x: Column) -> Column:
        return F.aggregate(halves, zero, lambda t, q: F.when(F.element_at(x, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def interleaved(x: Column) -> Column:
        return F.aggregate(places, zero, lambda a, p: F.shiftleft(a, 1).bitwiseOR(F.call_function("shiftright", F.get(x, p["i"]), p["b"]).bitwiseAND(F.lit(1).cast("long"))))

    return bound(F.aggregate(steps, cell, undo), lambda turned: bound(gray(turned), lambda g: bound(tail(g), lambda t: bound(F.transform(g, lambda v: v.bitwiseXOR(t)), interleaved))))


def ranked(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """rows with rank (long, from 0) and total: their places in the whole order. No task sees more than its range of rows."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << 33) - 1
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(mask)))
    placed = written(placed, "ranked")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    return placed.join(before, "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_n", "_before")


def metadata_dims(lang: str = "lang", source: str = "source", size: Column | None = None, bits: int = 10) -> list[Column]:
    """Cells of language and source (hashed) and of a size on a logarithmic scale; nulls: cell 0."""
    top = (1 << bits) - 1
    hashed = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(top)) + 1) for c in (lang, source)]
    return [*hashed, F.least(F.lit(top), F.floor(F.log2(F.coalesce(size, F.lit(0)) + 1) * (top // 32)))]


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source", bits: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert by the law `rows`: shards' counts are at most one apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    keys = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), hilbert_index(metadata_dims(lang, source, size, bits), bits).alias("hilbert"), F.xxhash64(text).alias("_text")
    )
    placed = ranked(keys, ["hilbert", "_text", "doc_id"])
    shard = F.expr(f"(rank * {shards}) div total")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **how) -> DataFrame:
    """Write docs as one folder of Parquet per shard, each a few files of rows in slot order, and return each shard's bounds for pruning.

    Every row lies in one file; null and repeated ids are fine. A column of docs named like one of the added ones is replaced.
    """
    added = ("shard", "slot", "hilbert")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    # Equal rows are interchangeable, so numbering them makes each row's place its own.
    number = F.row_number().over(W.partitionBy(*[F.xxhash64(*docs.columns, F.lit(k)) for k in range(2)]).orderBy(F.lit(0)))
    rows = written(docs.withColumn("_key", F.struct(*[F.xxhash64(*docs.columns, F.lit(k)) for k in range(2)], number)), "rows")
    placed = assign_shards(rows.withColumn(id_col, F.col("_key")), id_col=id_col, **how).select(F.col("doc_id").alias("_key"), *added)
    out = rows.join(placed, "_key").drop("_key").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars", "hilbert") if c in out.columns for n, f in (("min", F.min), ("max", F.max))]
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)
