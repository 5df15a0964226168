"""Reachability, shortest paths and cycles as iterated joins whose rounds are written tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.spread import Reached, bit_names, has_bit, levels, set_bits, spread
from loomgraph.operators.trees import preorder
from loomgraph.schema import Graph
from loomgraph.scratch import Scratch

#: How deep the answers look.
SUBTREE_DEPTH, FLOW_DEPTH, TREE_DEPTH, COMPOSITION_DEPTH = 10, 12, 4, 3
FLOW_KINDS = ("navigates_to", "routes_to", "renders", "calls")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False, expandable: DataFrame | None = None) -> DataFrame:
    """root, node and depth of all that seeds (root, node) reach, seeds included at depth 0.

    edges: src, dst. Each round joins the newest nodes of all roots with the edges and drops what a root has seen.
    expandable: ids from which the walk goes on; others are reached but lead no further.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = scratch.save(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = newest = scratch.save(seeds.select("root", "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        front = newest if expandable is None else newest.join(expandable.select(F.col("id").alias("node")), "node", "left_semi")
        found = front.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        newest = scratch.save(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
        if depth % 12 == 0:
            seen = scratch.save(seen)
    return seen


def of_kinds(graph: Graph, *kinds: str) -> DataFrame:
    return graph.of_kinds(*kinds)


def route_subtrees(graph: Graph) -> DataFrame:
    """route and id of the nodes that each route shows: what it routes to and what that renders or defines, ten levels deep. [TRV-01]"""
    seeds = of_kinds(graph, "routes_to").select(F.col("src").alias("root"), F.col("dst").alias("node"))
    found = reach(of_kinds(graph, "renders", "defines"), seeds, SUBTREE_DEPTH)
    return found.select(F.col("root").alias("route"), F.col("node").alias("id")).join(graph.nodes.select("id"), "id", "left_semi")


def edges_into(graph: Graph, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The edges (of the kinds, if given) that may lie on a way to an id: all of them, or those of the kinds that can lead to nodes of such types."""
    asked = ids.select("id").where("id IS NOT NULL")
    types = None if graph.ends is None else {r["type"] for r in asked.join(graph.nodes.select("id", "type"), "id", "left").select("type").distinct().collect()}  # a row a type
    if types is None or None in types:  # of what is no node nothing is known
        return graph.of_kinds(*kinds) if kinds else graph.edges
    found: set[str] = set()
    while more := {k for k, (_, b) in graph.ends.items() if b & types and (not kinds or k in kinds)} - found:
        found |= more
        types |= set().union(*(graph.ends[k][0] for k in more))
    return graph.of_kinds(*sorted(found))


def target_bits(graph: Graph, targets: DataFrame) -> Iterator[Reached]:
    """What leads to each target (column id) by edges of any kind, as bits: of a node those of the targets that depend on nothing
    less. A block of targets at a time, all of them in one walk. [TRV-02]"""
    starts = targets.select(F.col("id").alias("start"), F.col("id").alias("node"))
    return spread(edges_into(graph, targets), starts, reverse=True, known=graph.nodes.select("id"), written=graph.written)


def route_bits(graph: Graph, ids: DataFrame, by: str = "id") -> Iterator[Reached]:
    """Which of the ids, and of what lies on ways to them, each route leads to by edges of any kind, as bits. Routes are told apart by id
    or by name. [TRV-12, AGG-07, AGG-16]

    A walk goes on from known nodes only, as the walk back from a node does.
    """
    routes = graph.nodes.where(F.col("type") == "route").select(F.col(by).alias("start"), F.col("id").alias("node"))
    return spread(edges_into(graph, ids), routes, known=graph.nodes.select("id"), written=graph.written)


def subtree_bits(graph: Graph) -> Iterator[Reached]:
    """What each route shows, as bits: route_subtrees with one row a node. [TRV-01]"""
    starts = of_kinds(graph, "routes_to").select(F.col("src").alias("start"), F.col("dst").alias("node"))
    return spread(of_kinds(graph, "renders", "defines"), starts, most_rounds=SUBTREE_DEPTH, written=graph.written)


def dependents(graph: Graph, targets: DataFrame) -> DataFrame:
    """root, id, type, name and file of all that lead to each target (column id) by edges of any kind, itself left out. [TRV-02]

    A row a pair is what is asked for here; counts are taken from target_bits without it.
    """
    out = None
    for found in target_bits(graph, targets):
        rows = found.nodes.select("node", *found.bits()).select(F.col("node").alias("id"), F.explode(set_bits(found.words)).alias("bit"))
        one = rows.join(F.broadcast(found.starts), "bit").select(F.col("start").alias("root"), "id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = graph.nodes.sparkSession.createDataFrame([], "root string, id string")
    return out.join(graph.nodes.select("id", "type", "name", "file"), "id")


def render_subtree(graph: Graph, targets: DataFrame, depth: int = SUBTREE_DEPTH) -> DataFrame:
    """root, id and depth of what each target renders, directly or not, itself left out. [TRV-03, TRV-09]"""
    seeds = targets.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    found = reach(of_kinds(graph, "renders"), seeds, depth, expandable=graph.nodes.select("id"))
    return found.where(F.col("root") != F.col("node")).select("root", F.col("node").alias("id"), "depth").join(graph.nodes.select("id"), "id", "left_semi")


def shortest_path(graph: Graph, start: str, goal: str, max_hops: int = FLOW_DEPTH) -> DataFrame:
    """hop and id along the shortest flow from start to goal; no rows if there is none, or if they are the same node. [TRV-06]

    Of several parents the first in discovery order wins: that of the earliest parent, then edge kind, then id.
    """
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "path")
    none = spark.createDataFrame([], "hop int, id string")
    if start == goal:
        return none
    steps = scratch.save(of_kinds(graph, *FLOW_KINDS).select("src", "dst", "kind"))
    # a node's key is the way to it, kind and id at each hop: of equally long ways the smallest is that of the earliest parent
    newest = spark.createDataFrame([(start, [])], "id string, key array<string>")
    seen = newest.select("id")
    for _ in range(max_hops):
        found = newest.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("key", F.array("kind", "dst")).alias("key"))
        newest = scratch.save(found.groupBy("id").agg(F.min("key").alias("key")).join(seen, "id", "left_anti"))
        end = newest.where(F.col("id") == goal).select("key").first()
        if end is not None:
            return spark.createDataFrame([(i, x) for i, x in enumerate([start, *end["key"][1::2]])], "hop int, id string")
        if newest.isEmpty():
            return none
        seen = seen.unionByName(newest.select("id"))
    return none


def shortest_paths(graph: Graph, pairs: DataFrame, max_hops: int = FLOW_DEPTH) -> DataFrame:
    """start, goal, hop and id along the shortest flow of each pair (start, goal); no rows of a pair without one or of one node. [TRV-06]

    All goals are walked back from at once, as bits: a level has a row a node, whatever the number of pairs, and the walk ends with
    the level that meets the last pair's start. The way is read from the start on: at each hop the smallest kind and id of what lies
    one level nearer to the goal, which is the parent that shortest_path takes.
    """
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "paths")
    pairs = scratch.save(pairs.select("start", "goal").where("start != goal").distinct())
    goals = pairs.select(F.col("goal").alias("id")).distinct()
    steps = edges_into(graph, goals, FLOW_KINDS).select("src", "dst", "kind")
    steps = steps if graph.written else scratch.save(steps)
    out, least = None, F.min(F.struct("kind", "dst")).alias("m")
    for block, words, walked in levels(steps, goals.select(F.col("id").alias("start"), F.col("id").alias("node")), True, max_hops, written=True):
        active = scratch.save(pairs.join(block.withColumnRenamed("start", "goal"), "goal"))
        near, met = [], None  # near[k]: what is k hops from goals
        for k, level in enumerate(walked):
            near.append(level)
            if k:
                hit = scratch.save(active.join(level.withColumnRenamed("node", "start"), "start").where(has_bit(words)).select("start", "goal", "bit", F.lit(k).alias("n")))
                met = hit if met is None else met.unionByName(hit)
                active = scratch.save(active.join(hit, ["start", "goal"], "left_anti"))
                if active.isEmpty():
                    break
        if met is None:
            continue
        here = scratch.save(met.withColumn("id", F.col("start")))
        rows, hop = here.select("start", "goal", F.lit(0).alias("hop"), "id"), 0
        while True:
            hop += 1
            going = here.where(F.col("n") >= hop)
            left = sorted(r["k"] for r in going.select((F.col("n") - hop).alias("k")).distinct().collect())  # a row a length
            if not left:
                break
            allowed = None
            for k in left:
                one = near[k].select(F.col("node").alias("dst"), *bit_names(words), F.lit(k + hop).alias("n"))
                allowed = one if allowed is None else allowed.unionByName(one)
            reached = going.join(steps, F.col("id") == F.col("src")).select("start", "goal", "bit", "n", "kind", "dst").join(allowed, ["dst", "n"]).where(has_bit(words))
            here = scratch.save(reached.groupBy("start", "goal", "bit", "n").agg(least).select("start", "goal", "bit", "n", F.col("m.dst").alias("id")))
            rows = rows.unionByName(here.select("start", "goal", F.lit(hop).alias("hop"), "id"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "start string, goal string, hop int, id string") if out is None else out


def beside(graph: Graph, path: DataFrame, most: int = 22) -> DataFrame:
    """src, dst and label of what the nodes of a path (id) call or navigate to off it, the first `most`. [TRV-07]"""
    on = path.select("id")
    rows = of_kinds(graph, "calls", "navigates_to").join(on.withColumnRenamed("id", "src"), "src", "left_semi").join(on.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return rows.select("src", "dst", F.col("kind").alias("label")).distinct().orderBy("src", "dst", "label").limit(most)


def journeys(links: DataFrame, start: str, rounds: int = 4, most: int = 22) -> DataFrame:
    """round, src and dst of the tree of routes that navigation reaches from `start`, each at its first place. [TRV-08]

    links: src and dst of routes. A route is reached in the earliest round, from the smallest of its sources there; of the
    tree's edges the first `most` by round, src and dst are kept.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "journey")
    steps = scratch.save(links.select("src", "dst").distinct())
    newest = spark.createDataFrame([(start,)], "dst string")
    seen, out = newest, None
    for k in range(1, rounds + 1):
        found = steps.join(newest.select(F.col("dst").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("src")).join(seen, "dst", "left_anti")
        found = scratch.save(found.select(F.lit(k).alias("round"), "src", "dst"))
        out = found if out is None else out.unionByName(found)
        newest = found.select("dst")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return out.orderBy("round", "src", "dst").limit(most)


def component_trees(graph: Graph, roots: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """tree, node, type, name, file, place, depth and last of what each tree's root (tree, node) renders, in pre-order. [TRV-04]

    Children follow by id and a node stands where it is met first. Ways are at most `depth` edges long, so a row holds no more of its
    way than that; the order is that of an Euler tour (trees.preorder), without a walk.
    """
    scratch = Scratch(graph.nodes.sparkSession, "trees")
    steps = of_kinds(graph, "renders").select(F.col("src").alias("node"), F.col("dst").alias("child")).distinct()
    newest = scratch.save(roots.select("tree", "node").distinct().withColumn("way", F.array("node")))
    ways = newest
    for _ in range(depth):
        found = newest.join(steps, "node").where(~F.array_contains("way", F.col("child"))).select("tree", F.col("child").alias("node"), F.concat("way", F.array("child")).alias("way"))
        newest = scratch.save(found.groupBy("tree", "node").agg(F.min("way").alias("way")))
        if newest.isEmpty():
            break
        ways = ways.unionByName(newest)
    first = ways.groupBy("tree", "node").agg(F.min("way").alias("way")).select("tree", "node", F.when(F.size("way") > 1, F.element_at("way", -2)).alias("parent"))
    known = scratch.save(first.join(graph.nodes.select(F.col("id").alias("node"), "type", "name", "file"), "node"))
    return preorder(known, [F.col("node")]).where(F.col("depth") <= depth).drop("parent")


def _spread_least(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """v, f and b: the smallest of v and all that reach it by edges (src, dst), and of v and all that it reaches.

    Labels move an edge a round, both ways at once, and jump: what reaches a label reaches v, so a chain of n nodes takes about
    log n rounds.
    """
    label = scratch.save(nodes.select("v", F.col("v").alias("f"), F.col("v").alias("b")))
    while True:
        ahead = edges.join(label, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), F.col("f").alias("gf"), F.lit(None).cast("string").alias("gb"))
        back = edges.join(label, F.col("dst") == F.col("v")).select(F.col("src").alias("v"), F.lit(None).cast("string").alias("gf"), F.col("b").alias("gb"))
        jump_f = label.select("v", F.col("f").alias("at")).join(label.select(F.col("v").alias("at"), F.col("f").alias("gf")), "at").select("v", "gf", F.lit(None).cast("string").alias("gb"))
        jump_b = label.select("v", F.col("b").alias("at")).join(label.select(F.col("v").alias("at"), F.col("b").alias("gb")), "at").select("v", F.lit(None).cast("string").alias("gf"), "gb")
        got = ahead.unionByName(back).unionByName(jump_f).unionByName(jump_b).groupBy("v").agg(F.min("gf").alias("gf"), F.min("gb").alias("gb"))
        least = lambda a, b: F.least(F.col(a), F.coalesce(b, a))
        moved = (F.coalesce("gf", "f") < F.col("f")) | (F.coalesce("gb", "b") < F.col("b"))
        after = scratch.save(label.join(got, "v", "left").select("v", least("f", "gf").alias("f"), least("b", "gb").alias("b"), moved.alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("v", "f", "b")
        label = after.select("v", "f", "b")


def cycles(graph: Graph, kind: str = "imports") -> DataFrame:
    """cycle (its smallest member) and member of each strongly connected component of more than one node. [TRV-05]

    Each round spreads the smallest label forwards and backwards. Where both agree the label's own component is found;
    an edge whose ends differ in either label joins no component and goes.
    """
    scratch = Scratch(graph.nodes.sparkSession, "cycles")
    edges = scratch.save(of_kinds(graph, kind).where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found = None
    while not edges.isEmpty():
        # nodes without an edge in or out are in no cycle
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        inner = scratch.save(inner)
        if inner.count() < edges.count():
            edges = inner
            continue
        nodes = inner.select(F.col("src").alias("v")).distinct()
        marks = _spread_least(inner, nodes, scratch)
        done = marks.where(F.col("f") == F.col("b")).select(F.col("f").alias("cycle"), F.col("v").alias("member"))
        found = done if found is None else found.unionByName(done)
        rest = marks.where(F.col("f") != F.col("b"))
        x, y = rest.select(F.col("v").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), rest.select(F.col("v").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        edges = scratch.save(inner.join(x, "src").join(y, "dst").where((F.col("f1") == F.col("f2")) & (F.col("b1") == F.col("b2"))).select("src", "dst"))
    if found is None:
        return graph.nodes.sparkSession.createDataFrame([], "cycle string, member string")
    large = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return found.join(large.select("cycle"), "cycle", "left_semi").select("cycle", "member")
