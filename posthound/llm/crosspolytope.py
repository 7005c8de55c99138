"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and files them
under the nearest signed axis; with `rotations` > 1 an address joins several axes. A query probes, in each table, the addresses of its nearest
axes; what it finds there is scored exactly by cosine in double precision on the original vectors.

How many tables, probes and axes an address takes is tuned to the rows: the exact neighbours of a bounded sample of queries, found in
one pass over all rows, tell the recall of every choice, and the cheapest that reaches the target is taken. With more rows,
addresses of more axes become cheaper, so that the share of rows that a query is scored against falls.

Equal vectors are filed once with their smallest ids, as many as a query can need. Large buckets are dealt out over blocks by
a hash of the id, and the queries that probe them go to every block, so no task holds a hot bucket whole.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither do rows with a null id or whose
length differs from the most common one; ties go to the smaller id; rows that repeat an id are different candidates only if
their vectors differ, and an id is returned once, with its best score; a query whose buckets hold fewer than k
others is compared with every row, in blocks; components of any finite size count (vectors are scaled by a power of two first); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.session import written


class Rotations:
    """Pseudo-rotations of `dim`-vectors, padded to a power of two; equal seeds give equal rotations everywhere."""

    def __init__(self, dim: int, tables: int, rotations: int, seed: int) -> None:
        self.dim, self.tables, self.rotations = dim, tables, rotations
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, self.width))

    def turned(self, unit: np.ndarray, table: int, k: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.dim] = unit
        for signs in self.signs[table, k]:
            x = x * signs
            h = 1
            while h < self.width:  # fast Hadamard transform
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
                h *= 2
            x /= np.sqrt(self.width)
        return np.concatenate([x, -x], 1)

    def addresses(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The `probes` nearest addresses of each row, nearest first; an address of several rotations ranks by its axes' products."""
        out = cost = None
        for k in range(self.rotations):
            near = self.turned(unit, table, k)
            top = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            gap = near.max(1, keepdims=True) - np.take_along_axis(near, top, 1)
            if out is None:
                out, cost = top, gap
                continue
            # The pair of the i-th and j-th best has (i + 1) * (j + 1) - 1 pairs at least as good before it.
            i, j = np.nonzero((np.arange(out.shape[1])[:, None] + 1) * (np.arange(top.shape[1]) + 1) <= probes)
            out, cost = out[:, i] * (2 * self.width) + top[:, j], cost[:, i] + gap[:, j]
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            out, cost = np.take_along_axis(out, best, 1), np.take_along_axis(cost, best, 1)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares neither overflow nor vanish; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filed(rows: DataFrame, spin: Rotations, probes: int) -> DataFrame:
    """(address, id, vec): a row per table and probe."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                unit = _unit(_matrix(part.column(1), spin.dim))
                for t in range(spin.tables):
                    got = spin.addresses(unit, t, probes)
                    at = pa.array(np.repeat(np.arange(len(unit)), got.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array((got + t * (2 * spin.width) ** spin.rotations).ravel()), part.column(0).take(at), part.column(1).take(at)], names=["address", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "address long, id long, vec array<double>")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, the same however rows are batched."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _best(q_ids: np.ndarray, q_vec: np.ndarray, q_unit: np.ndarray, ids: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows by score, then id."""
    near = q_unit @ _unit(vec).T
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    m = min(len(ids), k)
    # Everything that ties with the last place within rounding is scored exactly.
    edge = -np.partition(-near, m - 1, axis=1)[:, m - 1] - 1e-12
    i, j = np.nonzero((near >= edge[:, None]) & np.isfinite(near))
    score = cosines(q_vec[i], vec[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k]


def _search(filed: DataFrame, dim: int, k: int, hold: int = 2048) -> DataFrame:
    """Rows (key, kind, id, vec) in key order, queries (kind 0) before rows (kind 1): each query's best of each bucket block.

    A task holds the queries of one block in runs of `hold` and streams the block's rows past them.
    """

    def run(batches):
        key, queries = None, []

        def score(ids: np.ndarray, vec: np.ndarray):
            for q_ids, q_vec, q_unit in queries:
                i, j, cos = _best(q_ids, q_vec, q_unit, ids, vec, k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(cos)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kinds, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            vec = _matrix(batch.column(3), dim)
            cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                if keys[s] != key:
                    key, queries = keys[s], []
                if kinds[s] == 0:
                    for a in range(s, e, hold):
                        v = vec[a : min(e, a + hold)]
                        queries.append((ids[a : min(e, a + hold)], v, _unit(v)))
                else:
                    for a in range(s, e, hold):
                        yield from score(ids[a : min(e, a + hold)], vec[a : min(e, a + hold)])

    return filed.mapInArrow(run, "query_id long, vec_id long, score double")


def _meet(filed: DataFrame, probing: DataFrame, dim: int, k: int, block: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score of the best rows at the addresses that queries probe, each pair once."""
    loads = filed.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    loads = loads.select("address", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # Queries of a block are dealt out too; a block's rows go to each deal.
    asks = probing.groupBy("address").agg(F.count(F.lit(1)).alias("n")).select("address", F.ceil(F.col("n") / query_block).cast("int").alias("deals"))
    plan = written(loads.join(asks, "address"), "blocks")
    deal = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = filed.join(plan, "address").select("address", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"), F.explode(deal("deals")).alias("d"), F.lit(1).alias("kind"), "id", "vec")
    probed = probing.join(plan, "address").select("address", F.explode(deal("blocks")).alias("b"), F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("d"), F.lit(0).alias("kind"), "id", "vec")
    both = probed.unionByName(spread).select(F.xxhash64("address", "b", "d").alias("key"), "kind", "id", "vec")
    best = _search(both.repartition("key").sortWithinPartitions("key", "kind"), dim, k)
    return best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def exact_neighbours(base: DataFrame, ids: np.ndarray, vecs: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score, vec: each given query's k nearest of all rows, by one pass over them."""
    unit = _unit(vecs)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                i, j, cos = _best(ids, vecs, unit, part.column(0).to_numpy(), _matrix(part.column(1), vecs.shape[1]), k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), part.column(0).take(pa.array(j)), pa.array(cos), part.column(1).take(pa.array(j))], names=["query_id", "vec_id", "score", "vec"])

    found = base.select("id", "vec").mapInArrow(run, "query_id long, vec_id long, score double, vec array<double>")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


#: What the tuning may choose from.
MOST_TABLES, MOST_PROBES, MOST_ROTATIONS = 24, 256, 4


def tuned(base: DataFrame, asked: DataFrame, dim: int, k: int, seed: int, recall: float, sample: int) -> tuple[int, int, int]:
    """(tables, probes, rotations): the cheapest whose recall on `sample` queries (smallest hashes of their ids) reaches `recall`.

    The cost of a choice counts the rows filed and probing, and a fiftieth for each row scored.
    """
    total, n_queries = base.count(), asked.count()
    drawn = asked.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).collect()  # bounded by `sample`
    if not drawn:
        return 1, 1, 1
    ids, vecs = np.array([r["id"] for r in drawn]), np.array([r["vec"] for r in drawn], dtype=np.float64)
    true = exact_neighbours(base, ids, vecs, k).collect()  # at most k rows a query of the sample
    place = {q: i for i, q in enumerate(ids.tolist())}
    if not true:
        return 1, 1, 1
    query, found = np.array([place[r["query_id"]] for r in true]), _unit(np.array([r["vec"] for r in true], dtype=np.float64))
    places = {}
    for rotations in range(1, MOST_ROTATIONS + 1):
        spin = Rotations(dim, MOST_TABLES, rotations, seed)
        if rotations > 1 and (2 * spin.width) ** (rotations - 1) > total:
            break
        # Each true neighbour's place among the addresses that its query probes, by table.
        ranks = []
        for t in range(MOST_TABLES):
            hit = spin.addresses(_unit(vecs), t, MOST_PROBES)[query] == spin.addresses(found, t, 1)
            ranks.append(np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        places[rotations] = np.minimum.accumulate(np.array(ranks), axis=0)
    return cheapest(places, 2 * spin.width, total, n_queries, recall)


def cheapest(places: dict[int, np.ndarray], axes: int, total: int, n_queries: int, recall: float) -> tuple[int, int, int]:
    """(tables, probes, rotations) of the least cost, from places[rotations][tables - 1]: each true neighbour's first place in so many tables."""
    best = None
    for rotations, least in places.items():
        for tables, own in enumerate(least, 1):
            # The probes that the last needed neighbour takes; of choices that miss the target, the one that comes closest.
            needed = max(1, int(np.ceil(recall * len(own))))
            missed = max(0, needed - int((own < MOST_PROBES).sum()))
            probes = min(int(np.sort(own)[needed - 1]) + 1, MOST_PROBES, axes**rotations)
            choice = (missed, tables * (total + n_queries * probes) + n_queries * tables * probes * total / axes**rotations / 50, tables, probes, rotations)
            best = choice if best is None else min(best, choice)
    return best[2:]


def nearest(rows: DataFrame, queries: str = "id % 50 = 0", k: int = 5, tables: int | None = None, probes: int | None = None, rotations: int | None = None, recall: float = 0.97, sample: int = 256, block: int = 8192, query_block: int = 4096, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that the condition `queries` (on `id`) selects.

    tables, probes, rotations: given together, or tuned to `recall`, which is measured on at most `sample` queries.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(finite).filter(F.exists("vec", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.size("vec") == sizes["dim"])
    # Of equal vectors only the k + 1 smallest ids can be found: their scores are equal.
    same = F.row_number().over(W.partitionBy(F.xxhash64("vec"), F.hash("vec")).orderBy("id"))
    base = written(rows.distinct().withColumn("_n", same).filter(F.col("_n") <= k + 1).select("id", "vec"), "base")
    asked = written(rows.filter(queries).distinct(), "asked")
    if tables is None or probes is None or rotations is None:
        tables, probes, rotations = tuned(base, asked, sizes["dim"], k, seed, recall, sample)
    spin = Rotations(sizes["dim"], tables, rotations, seed)
    found = written(_meet(written(_filed(base, spin, 1), "filed"), _filed(asked, spin, probes), sizes["dim"], k, block, query_block), "found")
    # Queries whose buckets hold fewer than k others meet every row, in blocks.
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = written(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "short")
    if not short.isEmpty():
        whole = lambda d: d.select(F.lit(-1).cast("long").alias("address"), "id", "vec")
        rest = found.join(full, "query_id", "left_semi")
        found = rest.unionByName(_meet(whole(base), whole(short), sizes["dim"], k, block, query_block))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
