"""Roots of trees that are given by parent ids, by pointer jumping: each round doubles how far every node sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthound.plans.registry import Registry
from posthound.session import written
from posthound.sources import adapters as src

R = Registry()


def roots(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", most: int = 64) -> DataFrame:
    """id, root, depth, in_cycle for nodes(id, parent), ids distinct and not null.

    A node without a parent, or whose parent is no node, is a root at depth 0. A node whose ancestors run in a cycle takes the
    smallest id of the cycle as its root, has no depth, and is `in_cycle` if it lies on the cycle itself. Rounds grow with the
    logarithm of the depth: a pointer of 2**k steps is joined with the pointer of 2**k steps at its end. Nodes that have found
    their root take no further part; once a round moves nobody to a root, and 2**k has passed the number of open nodes, those
    left are on cycles or below them.
    """
    own = written(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")), "nodes")
    # No side is broadcast: files of millions of ids are small enough to be taken for few rows.
    linked = own.hint("merge").join(own.select(F.col("id").alias("parent")), "parent", "left_semi")
    solved = written(own.hint("merge").join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")), "roots")
    open_ = written(linked.select("id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("parent").alias("least")), "pointers")
    reach = 1
    for _ in range(most):
        left = open_.count()
        if not left:
            break
        ends = solved.select(F.col("id").alias("to"), "root", "depth")
        ended = written(open_.hint("merge").join(ends, "to").select("id", "root", (F.col("steps") + F.col("depth")).alias("depth")), "roots")
        if reach > left and not ended.limit(1).count():
            break
        ahead = open_.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("least").alias("low"))
        jumped = open_.hint("merge").join(ended.select("id"), "id", "left_anti").hint("merge").join(ahead, "to")
        open_ = written(jumped.select("id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "low").alias("least")), "pointers")
        solved, reach = solved.unionByName(ended), reach * 2
    else:
        raise RuntimeError(f"{most} rounds did not reach all roots")
    out = solved.select("id", "root", "depth", F.lit(False).alias("in_cycle"))
    # What is left has taken more steps than there are open nodes: every pointer ends on a cycle, each node of a cycle is the end
    # of one, and the least id that such an end has passed is its cycle's.
    low = open_.select(F.col("id").alias("to"), F.col("least").alias("root"))
    on = open_.select(F.col("to").alias("id"), F.lit(True).alias("on")).distinct()
    stuck = open_.hint("merge").join(low, "to").select("id", "root").hint("merge").join(on, "id", "left")
    return out.unionByName(stuck.select("id", "root", F.lit(None).cast("long").alias("depth"), F.coalesce("on", F.lit(False)).alias("in_cycle")))


_PARENT = """CASE WHEN event_id % 97 = 3 THEN event_id + 1 WHEN event_id % 97 = 4 THEN event_id - 1 WHEN event_id % 1000 = 0 THEN NULL WHEN event_id % 501 = 0 THEN -event_id ELSE event_id - 1 - event_id % 2 END"""


@R.add(
    f"""WITH RECURSIVE n AS (SELECT event_id AS id, {_PARENT} AS parent FROM events),
seed AS (SELECT a.id, CASE WHEN b.parent = a.id THEN least(a.id, b.id) ELSE a.id END AS root, CASE WHEN b.parent = a.id THEN NULL ELSE 0 END AS depth, b.parent IS NOT DISTINCT FROM a.id AS in_cycle
  FROM n a LEFT JOIN n b ON a.parent = b.id WHERE b.id IS NULL OR b.parent = a.id),
t AS (SELECT id, root, depth, in_cycle FROM seed UNION ALL SELECT n.id, t.root, t.depth + 1, false FROM t JOIN n ON n.parent = t.id WHERE n.id NOT IN (SELECT id FROM seed))
SELECT id, root, CAST(depth AS BIGINT) AS depth, in_cycle FROM t"""
)
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies to the one or two before them: some begin a thread, some answer an unknown one, some answer each other."""
    events = src.table(spark, sf_dir, "events")
    return roots(events.selectExpr("event_id AS id", f"{_PARENT} AS parent"))
