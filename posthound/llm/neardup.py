"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Each independent tree branches the documents by the values of a few selected minwise
tokens (about 1/threshold tokens a node, chosen by the node's own path), so that a similar pair keeps meeting while others part.
Nodes of at most `leaf` documents are compared exhaustively on their signatures; larger nodes branch again.

Links are found in two passes, so that a huge group of near copies is linked without all its pairs. The first confirms few
candidates of each node: pairs with the node's centre, with each document's nearest, and with a few leaders of large nodes. The
second takes the pairs that the first left out, except where confirmed links already connect both documents: all of them in
every leaf, and all pairs of blocks of the nodes that are still large at the last level. It sends the full sets of the documents
in such pairs to their node once, where one product of the node's incidence matrix compares all of them, and returns a spanning
forest of the links, so that no table of pairs grows with the square of a node. A pair is left out for good only if its signatures
are too unlike, or if it could not change a component.
Every link is confirmed on the full shingle sets. Documents with equal sets are one class from the start.

Cases: a null or empty text, or one of white space only, has no shingle and links with nothing; fewer words than a shingle
count as one shingle; rows that share a doc_id are one node; rows whose doc_id is null form nodes only through equal sets and
have a null component unless the set occurs with an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posthound.llm import bytesops as bo
from posthound.llm.common import sized, text_batches, without
from posthound.llm.components import components
from posthound.session import written

#: Minwise tokens of a signature; eight bits of each travel with a document.
COORDS = 64
_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 2**32, COORDS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _signature(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minwise values, one row a set; sets must not be empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offs) - 1, COORDS), dtype=np.uint32)
    for k in range(COORDS):
        y = (x ^ _XOR[k]) * _MUL[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, offs[:-1])
    return out


def _chosen(key: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tokens that a node branches by, from its path: one always, a second with chance 1/threshold - 1."""
    r = bo.mix(key ^ np.uint64(0xA5A5A5A55A5A5A5A))
    second = (r >> np.uint64(40)).astype(np.float64) / 2.0**24 < 1 / threshold - 1
    one = (r & np.uint64(0xFFFF)) % np.uint64(COORDS)
    two = (one + np.uint64(1) + ((r >> np.uint64(16)) & np.uint64(0xFFFF)) % np.uint64(COORDS - 1)) % np.uint64(COORDS)
    return [(np.ones(len(key), bool), one.astype(np.int64)), (second, two.astype(np.int64))]


def _child(key: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    return bo.mix(bo.mix(key + coord.astype(np.uint64) * np.uint64(bo.BASE)) ^ (value.astype(np.uint64) + np.uint64(0x1234567)))


def _uniques(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(h[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return np.concatenate(parts) if parts else h, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _set_chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, buf, offs in bo.chunks(batch.column(1)):
        low = bo.LOWER[buf]
        starts, ends, doc = bo.words(low, offs)
        yield a, b, *_uniques(*bo.shingles(bo.span_hashes(low, starts, ends), doc, b - a, width))


def _digest(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for each set; the sets start at `at` and are not empty."""
    return np.add.reduceat(h, at), np.add.reduceat(bo.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)


def profiles(docs: DataFrame, width: int, trees: int, threshold: float) -> DataFrame:
    """id, n_shingles, digest (d1, d2) of the set, 64 signature bytes, and the keys of the first level's nodes."""

    def run(batches):
        for batch in batches:
            for a, b, h, offs in _set_chunks(batch, width):
                n = np.diff(offs)
                full = np.flatnonzero(n > 0)
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                sig8, keys = np.zeros((b - a, COORDS), np.uint8), [[] for _ in range(b - a)]
                if len(full):
                    at = offs[:-1][full]
                    d1[full], d2[full] = _digest(h, at)
                    sig = _signature(h, np.append(at, offs[-1]))
                    sig8[full] = (bo.mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                    for tree in range(trees):
                        root = bo.mix(np.full(len(full), tree + 1, np.uint64))
                        for hit, coord in _chosen(root, threshold):
                            if hit[0]:
                                got = _child(root, coord, sig[np.arange(len(full)), coord]).view(np.int64)
                                for i, k in zip(full, got.tolist(), strict=True):
                                    keys[i].append(k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([r.tobytes() for r in sig8], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "d1", "d2", "sig", "keys"],
                )

    return text_batches(docs).mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sig binary, keys array<long>")


def _agreement(sig: np.ndarray) -> np.ndarray:
    """Equal places of each two signatures."""
    return np.concatenate([(sig[i : i + 32, None, :] == sig[None, :, :]).sum(2, dtype=np.int16) for i in range(0, len(sig), 32)])


def _pairs_in(ids: np.ndarray, sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidates inside one small node for the first pass, and whether others are left for the second: every pair in groups of six
    or fewer; in larger ones each document's with the centre and with its nearest, and up to sixteen of each document that is not
    like the centre."""
    m, left = len(ids), False
    agree = _agreement(sig)
    agree[np.arange(m), np.arange(m)] = 0
    near = agree >= least
    if m > 6 and near.any():
        keep = np.zeros_like(near)
        centre = int(np.argmax(np.where(near, agree, 0).sum(1, dtype=np.int64)))
        keep[centre] = near[centre]
        keep[np.arange(m), agree.argmax(1)] = True
        far = np.flatnonzero(~near[centre])
        keep[far] |= agree[far] >= np.sort(agree[far], 1)[:, -min(m, 16), None]
        keep = (keep | keep.T) & near
        left = bool((near & ~keep).any())
        near = keep
    i, j = np.nonzero(np.triu(near, 1))
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), left


def _column(c: pa.Array) -> np.ndarray:
    """Numbers as they are, signatures as rows of a matrix, lists as an array of arrays."""
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDS)
    if not pa.types.is_list(c.type):
        return c.to_numpy()
    flat, cut = c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()
    out = np.empty(len(c), object)
    for i in range(len(c)):
        out[i] = flat[cut[i] : cut[i + 1]]
    return out


def _runs(batches, take):
    """take(columns of one or more whole nodes, bounds of the nodes) over batches in key order; one node at a time is held back."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_column(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield from take([c[:last] for c in cols], _bounds(cols[0][:last]))
        rest = [c[last:] for c in cols]
    if rest is not None:
        yield from take(rest, _bounds(rest[0]))


def _bounds(key: np.ndarray):
    cut = np.flatnonzero(np.diff(key)) + 1
    return list(zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(key)]]).tolist(), strict=True))


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u = np.unique(np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)], 1), axis=0)
    return u[:, 0], u[:, 1]


def _leaf_pairs(nodes: DataFrame, least: int) -> DataFrame:
    """The first pass over small nodes: candidates (a, b), and `open`, the keys of nodes with pairs left for the second pass."""

    def take(cols, bounds):
        key, ids, sig = cols
        out_a, out_b, opened = [], [], []
        for s, e in bounds:
            if e - s > 1:
                a, b, left = _pairs_in(ids[s:e], sig[s:e], least)
                out_a.append(a), out_b.append(b)
                if left:
                    opened.append(int(key[s]))
        a, b = _unique_pairs(out_a, out_b)
        none = [None] * len(opened)
        yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.array([None] * len(a) + opened, pa.int64())], names=["a", "b", "open"])

    return nodes.repartition("key").sortWithinPartitions("key").select("key", "id", "sig").mapInArrow(lambda batches: _runs(batches, take), "a long, b long, open long")


def _open_members(nodes: DataFrame, least: int) -> DataFrame:
    """The second pass over nodes(key, id, sig, label, block): the members (key, id, label, block) that are alike, by their signatures,
    to one of another label; where a node has two blocks, to one of the other block."""

    def take(cols, bounds):
        key, ids, sig, label, block = cols
        keep = np.zeros(len(ids), bool)
        for s, e in bounds:
            g, t, k = sig[s:e], label[s:e], block[s:e]
            if (t == t[0]).all():
                continue
            two = bool((k != k[0]).any())
            for i in range(0, e - s, 32):
                ok = (g[i : i + 32, None, :] == g[None, i:, :]).sum(2, dtype=np.int16) >= least
                ok &= t[i : i + 32, None] != t[None, i:]
                if two:
                    ok &= k[i : i + 32, None] != k[None, i:]
                keep[s + i : s + i + len(ok)] |= ok.any(1)
                keep[s + i : e] |= ok.any(0)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, ids, label, block)], names=["key", "id", "label", "block"])

    return nodes.repartition("key").sortWithinPartitions("key").select("key", "id", "sig", "label", "block").mapInArrow(lambda batches: _runs(batches, take), "key long, id long, label long, block long")


#: Columns of the incidence matrix that a node is compared by at a time.
PANEL = 4096


def _common(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by the product of their incidence matrix, a panel of columns at a time."""
    size = np.array([len(x) for x in items])
    _, column, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    # What only one set holds is in no intersection.
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = np.repeat(np.arange(len(items)), size)[shared[column]], place[column[shared[column]]]
    out = np.zeros((len(items), len(items)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(shared.sum()), PANEL):
        a, b = np.searchsorted(column, (first, first + PANEL))
        panel = np.zeros((len(items), PANEL), np.float32)
        panel[row[a:b], column[a:b] - first] = 1
        out += panel @ panel.T  # whole numbers below 2 ** 24, so exact
    return out.astype(np.int64)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph whose adjacency matrix is `near`."""
    out, todo = [], near.any(1)
    while todo.any():
        front = np.array([int(np.argmax(todo))])
        todo[front] = False
        while len(front):
            meets = near[front][:, todo]
            new, hit = np.flatnonzero(todo), meets.any(0)
            found = new[hit]
            out.append((front[meets.argmax(0)[hit]], found))
            todo[found] = False
            front = found
    return np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)])


def _exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members(key, id, label, block, items) of each node: a spanning forest of its confirmed pairs of two labels."""

    def take(cols, bounds):
        _, ids, label, block, items = cols
        for s, e in bounds:
            if e - s < 2:
                continue
            t, k, n = label[s:e], block[s:e], np.array([len(x) for x in items[s:e]])
            common = _common(list(items[s:e]))
            near = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (t[:, None] != t[None, :])
            if (k != k[0]).any():
                near &= k[:, None] != k[None, :]
            a, b = (ids[s:e][x] for x in _forest(near))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return members.repartition("key").sortWithinPartitions("key").select("key", "id", "label", "block", "items").mapInArrow(lambda batches: _runs(batches, take), "a long, b long")


#: Documents that every member of a large node is held against: the node's smallest by so many hashes.
LEADERS = 3


def _star_pairs(nodes: DataFrame, least: int) -> DataFrame:
    """(leader, document) candidates of large nodes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sigs = [np.frombuffer(b"".join(batch.column(1 + 2 * k).to_pylist()), np.uint8).reshape(-1, COORDS) for k in range(LEADERS + 1)]
            leads = [batch.column(2 + 2 * k).to_numpy() for k in range(LEADERS)]
            for k, lead in enumerate(leads):
                ok = ((sigs[0] == sigs[k + 1]).sum(1) >= least) & (ids != lead)
                for other in leads[:k]:
                    ok &= lead != other
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, lead)[ok]), pa.array(np.maximum(ids, lead)[ok])], names=["a", "b"])

    first = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), "id", "sig")).alias(f"m{k}") for k in range(LEADERS)]
    leaders = nodes.groupBy("key").agg(*first)
    chosen = [F.col(f"m{k}.{c}").alias(f"{c}{k}") for k in range(LEADERS) for c in ("id", "sig")]
    return nodes.join(leaders, "key").select("id", "sig", *chosen).mapInArrow(run, "a long, b long")


def _branch(nodes: DataFrame, threshold: float) -> DataFrame:
    """The children of large nodes: each document under its values of the tokens that its node branches by."""
    r = F.xxhash64("key", F.lit("branch"))
    one = F.pmod(r, F.lit(COORDS))
    two = F.pmod(one + 1 + F.pmod(F.shiftright(r, 12), F.lit(COORDS - 1)), F.lit(COORDS))
    second = F.pmod(F.shiftright(r, 24), F.lit(1 << 20)) < F.lit(int((1 / threshold - 1) * (1 << 20)))
    child = lambda c: F.xxhash64("key", c, F.col("sig").substr(c.cast("int") + 1, F.lit(1))).alias("key")
    return nodes.select(child(one), "id", "sig").unionByName(nodes.filter(second).select(child(two), "id", "sig"))


def _least(threshold: float) -> int:
    return int(COORDS * threshold - 4.8 * (COORDS * threshold * (1 - threshold)) ** 0.5)


def candidates(reps: DataFrame, threshold: float, leaf: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The first pass over reps(id, sig, keys): its distinct candidates (a < b); what it leaves for the second: leaves, and the
    nodes that are still large at the last level, if there are any (key, id, sig)."""
    least = _least(threshold)
    nodes, found, levels, large_left = reps.select(F.explode("keys").alias("key"), "id", "sig"), None, [], None
    for level in range(depth):
        large = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf), "nodes")
        pairs = _leaf_pairs(nodes.join(large, "key", "left_anti"), least)
        found = pairs if found is None else found.unionByName(pairs)
        levels.append(nodes)
        if large.isEmpty():
            break
        big = written(nodes.join(large, "key", "left_semi"), "branch")
        found = found.unionByName(_star_pairs(big, least), allowMissingColumns=True)
        nodes = _branch(big, threshold)
    else:
        # Nodes that are still large hold near copies of one text: their leaders and blocks of them link most; the second pass takes the rest.
        large_left = big
        block = F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("n") / leaf).cast("long"))
        found = found.unionByName(_leaf_pairs(big.join(large, "key").select(F.xxhash64("key", block).alias("key"), "id", "sig"), least))
    found = written(found.filter("a < b or open is not null").distinct(), "pairs")
    opened = sized(written(found.filter("open is not null").select(F.col("open").alias("key")), "open"))
    left = levels[0].join(opened, "key", "left_semi")
    for nodes in levels[1:]:
        left = left.unionByName(nodes.join(opened, "key", "left_semi"))
    return found.filter("a < b").select("a", "b"), left, large_left


def _grid(nodes: DataFrame, leaf: int) -> DataFrame:
    """Large nodes(key, id, sig, label) as nodes of two blocks each (or of one with itself): every two documents of different
    labels meet. A label of more than half a leaf has blocks of its own, which never meet each other; the others share blocks."""
    half = max(1, leaf // 2)
    c = F.col
    sizes = nodes.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    own = sizes.filter(c("c") > half).select("key", "label", F.ceil(c("c") / half).cast("long").alias("own"))
    shared = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(c("c") <= half, c("c")).otherwise(0)) / half).cast("long").alias("shared"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    dealt = nodes.join(shared, "key").join(own, ["key", "label"], "left")
    alone = c("own").isNotNull()
    at = F.when(alone, F.xxhash64("label", F.pmod(F.xxhash64("id"), c("own")))).otherwise(F.pmod(F.xxhash64("label"), F.greatest("shared", F.lit(1))))
    dealt = written(dealt.select("key", "id", "sig", "label", at.alias("block"), F.when(alone, c("label")).alias("whole")), "dealt")
    blocks = dealt.select("key", "block", "whole").distinct().select("key", c("block").alias("other"), c("whole").alias("other_whole"))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
    return dealt.join(blocks, "key").filter("whole is null or other_whole is null or whole != other_whole").select(cell, "id", "sig", "label", "block")


def left_links(docs: DataFrame, left: DataFrame, large_left: DataFrame | None, labels: DataFrame, width: int, percent: int, leaf: int, unique: bool) -> DataFrame:
    """The second pass: confirmed links (a, b) among what the first left, between documents that labels(node, label) do not connect."""
    held = sized(labels.select(F.col("node").alias("id"), "label"))
    labelled = lambda nodes: nodes.join(held, "id", "left").select("key", "id", "sig", F.coalesce("label", "id").alias("label"))
    nodes = labelled(left).withColumn("block", F.lit(0).cast("long"))
    if large_left is not None:
        nodes = nodes.unionByName(_grid(labelled(large_left), leaf))
    members = written(_open_members(nodes, _least(percent / 100)), "members")
    sets = _sets_of(docs, written(members.select("id").distinct(), "paired"), width, unique)
    return _exact_links(members.join(sets, "id"), percent).distinct()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, sorted array of the distinct shingle hashes."""

    def run(batches):
        for batch in batches:
            for a, b, h, offs in _set_chunks(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "items"])

    return text_batches(docs).mapInArrow(run, "id long, items array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, unique: bool) -> DataFrame:
    """The full sets of the documents in ids(id), a row each; where ids repeat, one for each different set of an id."""
    sets = shingle_sets(docs.join(sized(ids), "id", "left_semi"), width)
    return written(sets if unique else sets.distinct(), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int, unique: bool) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    sets = _sets_of(docs, written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired"), width, unique)
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("two")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("items").alias("one")), "a")
        .select("a", "b", F.size(F.array_intersect("one", "two")).cast("long").alias("common"), (F.size("one") + F.size("two")).cast("long").alias("both"))
        .filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = 10, leaf: int = 1024, depth: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of the documents linked with 100 * intersection >= percent * union.

    trees: independent repetitions; a pair at the threshold misses one first-level tree with chance 1 - percent/100 at most.
    leaf: nodes up to this size are compared exhaustively; larger ones branch up to `depth` more times.
    """
    return _decided(docs, id_col, text_col, width, percent, trees, leaf, depth).drop("d1", "d2").withColumnRenamed("id", id_col)


def _decided(docs: DataFrame, id_col: str, text_col: str = "text", width: int = 5, percent: int = 80, trees: int = 10, leaf: int = 1024, depth: int = 4) -> DataFrame:
    """near_duplicates as id, d1, d2 (digest of the row's set), n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = written(profiles(docs, width, trees, percent / 100), "profile")
    some = profile.filter("n_shingles > 0")
    unique = profile.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    classes = written(some.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "classes")
    # One row of each class carries its signature: rows of a class have the same, so any of its smallest id will do.
    reps = some.filter("id is not null").join(classes.withColumnRenamed("rep", "id"), ["d1", "d2", "id"], "left_semi").select("id", "sig", "keys")
    first, left, large_left = candidates(reps, percent / 100, leaf, depth)
    links = written(_confirmed(docs, first, width, percent, unique), "links")
    labels = written(components(links), "labels")
    more = written(left_links(docs, left, large_left, labels, width, percent, leaf, unique), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("component_id"))
    return profile.join(named, ["d1", "d2"], "left").select(
        "id",
        "d1",
        "d2",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("id").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("kept"),
    )


def _digested(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """docs with _d1 and _d2, the digest of each row's set as in profiles (zeros for no shingle)."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            d1, d2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["id", "text"])
            for a, b, h, offs in _set_chunks(texts, width):
                full = np.flatnonzero(np.diff(offs) > 0)
                if len(full):
                    d1[a + full], d2[a + full] = _digest(h, offs[:-1][full])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=[*batch.schema.names, "_d1", "_d2"])

    return text_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_d1", T.LongType()), T.StructField("_d2", T.LongType())]))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, **how) -> DataFrame:
    """docs without all but one document of each component; rows that repeat a kept doc_id with equal columns stay once.

    Rows whose doc_id is null or occurs more than once are decided one by one, by doc_id and set.
    """
    found = written(_decided(docs, id_col, text_col, width, **how).select("id", "d1", "d2", "kept"), "kept")
    several = written(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"), "several")
    gone = found.filter(~F.col("kept"))
    if several.isEmpty():
        return without(docs, gone.select("id"), id_col)
    odd = sized(several.withColumnRenamed("id", "_several"))
    by_row = _digested(docs.join(odd, F.col(id_col).eqNullSafe(F.col("_several")), "left_semi"), text_col, width)
    lost = gone.join(odd, F.col("id").eqNullSafe(F.col("_several")), "left_semi").select(F.col("id").alias("_gone"), F.col("d1").alias("_g1"), F.col("d2").alias("_g2")).distinct()
    stay = by_row.join(lost, F.col(id_col).eqNullSafe(F.col("_gone")) & (F.col("_d1") == F.col("_g1")) & (F.col("_d2") == F.col("_g2")), "left_anti")
    return without(docs, gone.select("id").unionByName(several), id_col).unionByName(stay.drop("_d1", "_d2").dropDuplicates())


#: Every pair that shares a shingle, counted; components by a recursive walk.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT n.doc_id AS doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id, min(reach) = n.doc_id AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id
"""
