"""Merkle manifest of a dataset: the tree is built bottom-up level by level, proofs are pushed from the root down to the leaves.

A leaf is the hash of a row's fields. The leaves of one tree (a language) are ranked without any task seeing more than its
range of them, and lie in blocks of `arity ** LEVELS` that follow each other. A block row holds its leaves and folds up to
LEVELS levels of the tree with array functions; the blocks' heads are the leaves of the next, far smaller, table, and so on
up to one head per tree. Each of these tables is written: the way down joins the blocks of a table with their
parents' proof suffixes, and each node puts its own siblings before the suffix that it inherits. The trees' roots, ordered by
name, are the leaves of one more tree, the dataset's.

A step of a proof is the siblings left and right of the node in its run; a level at which the node is alone has none.

Cases: each null field hashes as `-`, which no value does; leaves ascend by id, nulls first, and rows of one id by their leaf's
hash; equal rows are leaves of their own, side by side; a null name is a tree of its own, before all others; a tree of one leaf
has this as its root; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from posthound.llm.common import bound, sized
from posthound.llm.hilbert import ranked
from posthound.session import written

#: Levels that one block row folds: 256 leaves at arity 2.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(value.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of fields in their order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def _levels(hs: Column, depth: Column, arity: int) -> Column:
    """array of levels 0 to depth of the tree over hs, each an array of hashes: a run of `arity` becomes its hash."""

    def up(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        runs = F.sequence(F.lit(1), F.size(below), F.lit(arity))
        return F.concat(levels, F.array(F.transform(runs, lambda i: digest(F.array_join(F.slice(below, i, F.lit(arity)), "")))))

    return F.aggregate(F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), depth), F.array(hs), up)


def _path(levels: Column, depth: Column, at: Column, arity: int) -> Column:
    """The siblings of leaf `at` (from 0) on each of `depth` levels: array of struct(l, r), hashes joined left to right."""

    def step(j: Column) -> Column:
        width = F.pow(F.lit(float(arity)), j).cast("int")
        own = F.floor(at / width).cast("int")
        first = (own / arity).cast("int") * arity
        level = F.element_at(levels, j + 1)
        left = F.array_join(F.slice(level, first + 1, own - first), "")
        right = F.array_join(F.slice(level, own + 2, F.lit(arity - 1) - (own - first)), "")
        return F.struct(left.alias("l"), right.alias("r"))

    return F.transform(F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), depth), step)


def proof_hash(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def _blocks(nodes: DataFrame, arity: int) -> DataFrame:
    """tree, blk, more, depth, hs, tags of nodes(tree, pos, n, h, tag): a row holds one block in order; more: other blocks exist."""
    size = arity**LEVELS
    in_block = F.sort_array(F.collect_list(F.struct("pos", "h", "tag")))
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / size).cast("long").alias("blk")).agg(in_block.alias("nodes"), F.max("n").alias("n"))
    # A tree of n leaves has the least depth whose power of the arity reaches n; a block that is not alone folds all its levels.
    reach = F.array(*[F.lit(arity**j) for j in range(LEVELS + 1)])
    depth = F.when(F.col("n") > size, F.lit(LEVELS)).otherwise(F.size(F.filter(reach, lambda x: x < F.col("n"))))
    return rows.select("tree", "blk", "n", depth.alias("depth"), F.col("nodes.h").alias("hs"), F.col("nodes.tag").alias("tags"))


def build(nodes: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """(written tables of blocks with their levels, leaves first; roots(tree, root)) of nodes(tree, pos, n, h, tag).

    pos counts a tree's leaves from 0, n is their number, tag goes with a leaf.
    """
    tables, tops = [], []
    while True:
        blocks = _blocks(nodes, arity).withColumn("levels", _levels(F.col("hs"), F.col("depth"), arity))
        blocks = written(blocks.drop("hs").withColumn("head", F.element_at(F.element_at("levels", -1), 1)), "merkle")
        tables.append(blocks)
        size = arity**LEVELS
        tops.append(blocks.filter(F.col("n") <= size).select("tree", F.col("head").alias("root")))
        rest = blocks.filter(F.col("n") > size)
        if not rest.limit(1).count():
            break
        nodes = rest.select("tree", F.col("blk").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("head").alias("h"), F.col("blk").cast("string").alias("tag"))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)
    return tables, roots


def push(tables: list[DataFrame], suffix: DataFrame, arity: int = 2) -> DataFrame:
    """tree, pos, tag, h, path of every leaf, from the top table down; suffix(tree, suffix) is what a tree's root inherits.

    A block takes its parent's path as its suffix, once for all its leaves.
    """
    size, above = arity**LEVELS, None
    for blocks in reversed(tables):
        rows = blocks.filter(F.col("n") <= size).join(sized(suffix), "tree")
        if above is not None:
            rows = rows.unionByName(blocks.filter(F.col("n") > size).join(above.withColumnRenamed("pos", "blk"), ["tree", "blk"]))
        first = F.col("blk") * size
        path = lambda at: F.concat(_path(F.col("levels"), F.col("depth"), at, arity), F.col("suffix"))
        each = F.transform("tags", lambda tag, at: F.struct((first + at).alias("pos"), tag.alias("tag"), F.get(F.get("levels", F.lit(0)), at).alias("h"), path(at).alias("path")))  # noqa: B023
        leaves = rows.select("tree", F.explode(each).alias("x")).select("tree", "x.*")
        above = leaves.select("tree", "pos", F.col("path").alias("suffix"))
    return leaves


def manifest(docs: DataFrame, arity: int = 2, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, path and verified for every row of docs.

    tampered: rows whose n_chars is one more when they are checked (default: crc32 of the decimal doc_id divides by 7).
    """
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = {c: F.col(c) for c in FIELDS}
    forged = fields | {"n_chars": F.col("n_chars") + 1}
    hit = tampered & F.col("n_chars").isNotNull()
    # A null name joins with nothing, so trees go by names of their own, which sort like theirs, null first.
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = docs.select("doc_id", tree.alias("tree"), leaf_hash(list(fields.values())).alias("leaf"), F.when(hit, leaf_hash(list(forged.values()))).alias("forged"))
    placed = ranked(rows, ["tree", "doc_id", "leaf"]).drop("total")
    trees = written(placed.groupBy("tree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    nodes = placed.join(sized(trees), "tree").select("tree", (F.col("rank") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("h"), F.struct("doc_id", "forged").alias("tag"))
    tables, subroots = build(nodes, arity)
    # The trees are the leaves of the dataset's tree, in the order of their names.
    top = ranked(subroots, ["tree"]).select(F.lit("").alias("tree"), F.col("rank").alias("pos"), F.col("total").alias("n"), F.col("root").alias("h"), F.col("tree").alias("tag"))
    top_tables, root = build(top, arity)
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    steps = push(top_tables, root.select("tree", nothing.alias("suffix")), arity).join(sized(root), "tree")
    heads = written(steps.select(F.col("tag").alias("tree"), F.col("path").alias("suffix"), F.col("h").alias("subroot"), "root"), "heads")
    leaves = push(tables, heads.select("tree", "suffix"), arity).join(sized(heads.select("tree", "subroot", "root")), "tree")
    folded = fold(F.coalesce(F.col("tag.forged"), F.col("h")), F.col("path"))
    out = leaves.select(F.col("tag.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, verified for every distinct row of docs: whether its own hash folds to the root of a manifest's (doc_id, path, root).

    A row whose id the manifest lacks is not verified; of several paths of one id, one that fits is enough.
    """
    now = docs.select("doc_id", leaf_hash([F.col(c) for c in FIELDS]).alias("_leaf"))
    held = known.select(F.col("doc_id").alias("_id"), "path", F.col("root").alias("_root"))
    fits = F.coalesce(fold(F.col("_leaf"), F.col("path")) == F.col("_root"), F.lit(False))
    tried = now.join(held, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("ok", fits)
    return tried.groupBy("doc_id", "_leaf").agg(F.max("ok").alias("verified")).select("doc_id", "verified")


def _sql_leaf(n_chars: str = "n_chars") -> str:
    fields = [f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _sql_climb(name: str, source: str) -> str:
    """Every node of the trees over source, with its children's hashes."""
    return f"""{name}(tree, lvl, pos, h, n, kids) AS (
  SELECT tree, CAST(0 AS BIGINT), pos, h, n, CAST([] AS VARCHAR[]) FROM {source}
  UNION ALL
  SELECT tree, max(lvl) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2, list(h ORDER BY pos) FROM {name} WHERE n > 1 GROUP BY tree, pos // 2)"""


def _sql_paths(name: str, source: str, nodes: str) -> str:
    """Siblings left and right of each leaf's ancestors, from the leaf up."""
    child = "(b.pos >> CAST(k.lvl - 1 AS BIGINT)) % 2"
    return f"""{name} AS (
  SELECT b.tree, b.pos, list(CASE WHEN {child} = 1 THEN k.kids[1] ELSE '' END ORDER BY k.lvl) AS ls, list(CASE WHEN {child} = 0 THEN coalesce(k.kids[2], '') ELSE '' END ORDER BY k.lvl) AS rs
  FROM {source} b JOIN {nodes} k ON k.lvl > 0 AND k.tree = b.tree AND k.pos = b.pos >> CAST(k.lvl AS BIGINT) GROUP BY b.tree, b.pos)"""


def _sql_crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII, bit by bit: the SQL has no crc32 of its own."""
    one = lambda x: f"CAST({x} AS UBIGINT)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: {one(f'ascii(substr({text}, CAST(k AS INTEGER), 1))')})"
    bits = f"list_transform(range(8), lambda z: {one(0)})"
    shift = f"lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, {one(3988292384)}) ELSE v // 2 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), {bits}), {shift})"
    return f"xor(list_reduce(list_prepend({one(4294967295)}, {codes}), {byte}), {one(4294967295)})"


ORACLE_SQL = f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_sql_leaf()} AS h,
    CASE WHEN n_chars IS NOT NULL AND {_sql_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS forged FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{_sql_climb("up", "base")},
subs AS (SELECT tree AS name, h, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_sql_climb("top", "subs")},
{_sql_paths("low", "base", "up")},
{_sql_paths("high", "subs", "top")},
whole AS (SELECT b.doc_id, b.h AS leaf, b.forged, s.h AS subroot, r.h AS root, coalesce(l.ls, []) || coalesce(g.ls, []) AS ls, coalesce(l.rs, []) || coalesce(g.rs, []) AS rs
  FROM base b JOIN subs s ON s.name = b.tree JOIN top r ON r.n = 1 LEFT JOIN low l ON l.tree = b.tree AND l.pos = b.pos LEFT JOIN high g ON g.pos = s.pos),
folds(doc_id, leaf, subroot, root, ls, rs, i, x) AS (SELECT doc_id, leaf, subroot, root, ls, rs, CAST(0 AS BIGINT), coalesce(forged, leaf) FROM whole
  UNION ALL SELECT doc_id, leaf, subroot, root, ls, rs, i + 1, sha256(ls[i + 1] || x || rs[i + 1]) FROM folds WHERE i < len(ls))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(ls, lambda a, k: a || rs[k]), '')) AS proof_sha256, x AS folded_root, x = root AS verified FROM folds WHERE i = len(ls)
"""
