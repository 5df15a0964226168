"""Trees in pre-order without a walk: Euler tours of parent pointers, ranked by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import positions
from loomgraph.scratch import Scratch


def preorder(nodes: DataFrame, order: list[Column], tree: str = "tree", node: str = "node", parent: str = "parent") -> DataFrame:
    """Adds place (0-based pre-order in the tree), depth and last (the place of the last node below it) to rows of trees.

    nodes: tree, node and parent (null for a root, of which a tree may have several) and any other columns; a node occurs once in its
    tree, siblings follow by `order`. [RND-15]

    Each node has an arc down to it and one up from it. An arc's follower is known from the first child, the next sibling and the
    parent; the number of arcs down and up that are still to come is found by jumping to the follower's follower, in as many rounds as
    the tour's length has binary digits. So a chain of n nodes takes log n rounds, and a parent of any number of children is no
    group of any task. Nodes below a cycle or an unknown parent have no end to come to and are left out.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "preorder")
    rows = scratch.save(positions(nodes.select(tree, node, parent, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), [F.col(tree), F.col(parent).asc_nulls_first(), *[F.col(f"_o{i}") for i in range(len(order))], F.col(node)], "at", scratch))
    base = rows.select(F.col(tree).alias("t"), F.col(node).alias("v"), F.col(parent).alias("p"), "at")
    # of siblings that lie side by side in the order, each one's next
    after = base.select("t", F.col("p").alias("p2"), F.col("v").alias("sibling"), (F.col("at") - 1).alias("at"))
    after = base.join(after, ["t", "at"]).where(F.col("p").eqNullSafe(F.col("p2"))).select("t", "v", "sibling")
    child = base.where("p IS NOT NULL").groupBy("t", F.col("p").alias("v")).agg(F.min_by("v", "at").alias("child"))
    known = base.join(after, ["t", "v"], "left").join(child, ["t", "v"], "left")
    arc = lambda side, of: F.struct(F.lit(side).alias("side"), of.alias("v"))
    down = known.select("t", F.lit(0).alias("side"), "v", F.when(F.col("child").isNotNull(), arc(0, F.col("child"))).otherwise(arc(1, F.col("v"))).alias("next"))
    up = known.select("t", F.lit(1).alias("side"), "v", F.when(F.col("sibling").isNotNull(), arc(0, F.col("sibling"))).when(F.col("p").isNotNull(), arc(1, F.col("p"))).alias("next"))
    # downs: arcs down from here to where `next` begins; depth falls by the arcs up and rises by those down
    arcs = down.unionByName(up).select("t", "side", "v", F.col("next.side").alias("ns"), F.col("next.v").alias("nv"), (F.col("side") == 0).cast("long").alias("downs"), F.when(F.col("side") == 0, -1).otherwise(1).cast("long").alias("ups"))
    arcs = scratch.save(arcs)
    left, n = arcs.count(), arcs.where("ns IS NOT NULL").count()
    while n:
        ahead = arcs.select("t", F.col("side").alias("ns"), F.col("v").alias("nv"), F.col("ns").alias("ns2"), F.col("nv").alias("nv2"), F.col("downs").alias("d2"), F.col("ups").alias("u2"))
        arcs = arcs.join(ahead, ["t", "ns", "nv"], "left").select("t", "side", "v", F.col("ns2").alias("ns"), F.col("nv2").alias("nv"), (F.col("downs") + F.coalesce("d2", F.lit(0))).alias("downs"), (F.col("ups") + F.coalesce("u2", F.lit(0))).alias("ups"))
        arcs = scratch.save(arcs)
        n, left = arcs.where("ns IS NOT NULL").count(), left // 2
        if not left:
            break
    ended = arcs.where("ns IS NULL")
    total = ended.where("side = 0").groupBy("t").agg(F.max("downs").alias("total"))
    here = ended.where("side = 0").join(total, "t").select("t", "v", (F.col("total") - F.col("downs")).alias("place"), F.col("ups").alias("depth"))
    below = ended.where("side = 1").join(total, "t").select("t", "v", (F.col("total") - F.col("downs") - 1).alias("last"))
    found = here.join(below, ["t", "v"]).select(F.col("t").alias(tree), F.col("v").alias(node), "place", "depth", "last")
    return nodes.join(found, [tree, node])
