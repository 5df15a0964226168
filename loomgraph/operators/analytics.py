"""Impact, architecture score, duplicates, hotspots, what-if simulations and placement advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import same_shape, segments  # noqa: F401
from loomgraph.operators import traverse as walk
from loomgraph.operators.spread import bit_names, how_many, per_start, pushed, set_bits, spread
from loomgraph.schema import Graph
from loomgraph.scratch import Scratch

#: Files whose components a framework calls, targets from which on cycles are contracted, thresholds, and the points and cap of each penalty.
FRAMEWORK_ENTRY = ("page", "layout", "template", "error", "loading", "not-found", "global-error", "default", "middleware", "_app", "_document")
MANY_TARGETS = 1024
LARGE_LOC, HEAT_LIMIT, FANOUT_LIMIT, FANOUT_WARNING = 150, 8, 6, 15
PENALTIES = {
    "cycles": (8, 24), "dead": (2, 16), "large": (3, 15), "unused_apis": (2, 10), "duplicate_names": (2, 10),
    "duplicate_shapes": (2, 10), "dangling_channels": (4, 12), "orphan_handlers": (2, 6),
}


def base_name(column: str = "file") -> Column:
    """The file's name without its last extension; empty without a file. [FLT-10]"""
    return F.coalesce(F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]+$", ""), F.lit(""))


def _own(graph: Graph) -> DataFrame:
    """Components that no framework calls by their file's name."""
    return graph.nodes.where((F.col("type") == "component") & ~base_name().isin(*FRAMEWORK_ENTRY))


def _without_in(graph: Graph, nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.join(walk.of_kinds(graph, *kinds).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def _with_in(graph: Graph, nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.join(walk.of_kinds(graph, *kinds).select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def degree(graph: Graph) -> DataFrame:
    """id and degree over both ends of all edges: a self-loop counts twice. [AGG-09, AGG-33]"""
    return graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def dead_code(graph: Graph) -> DataFrame:
    """Components that nothing renders or routes to, and hooks that nothing uses. [JON-04, AGG-03]"""
    hooks = graph.nodes.where(F.col("type") == "hook")
    return _without_in(graph, _own(graph), "renders", "routes_to").select("id", "type").unionByName(_without_in(graph, hooks, "uses").select("id", "type"))


def called_apis(graph: Graph) -> DataFrame:
    """Apis with a caller. [JON-03]"""
    return _with_in(graph, graph.nodes.where(F.col("type") == "api"), "calls")


def unused_apis(graph: Graph) -> DataFrame:
    """Declared apis that nothing calls and whose path no called one's path matches: as many segments, each equal or a wildcard on either side. [FLT-11, JON-06, AGG-03]

    Equal paths are removed by an equi-join. Where either path has wildcards the two meet by every pattern of wildcards that paths
    of their number of segments have: both with the wildcards' places left out of the join key, so that no two tables are crossed. As in the reference behaviour the declared name is compared whole, its method being part of the first segment.
    """
    idle = _without_in(graph, graph.nodes.where((F.col("type") == "api") & F.col("declared")), "calls").select("id", "name")
    idle = idle.withColumn("a", segments(F.col("name")))
    paths = called_apis(graph).select(segments(F.element_at(F.split("name", " "), -1)).alias("b")).distinct()
    left = idle.join(paths, F.col("a") == F.col("b"), "left_anti")
    wild = lambda c: F.transform(c, lambda x: x.startswith(":"))
    some = lambda c: F.exists(c, lambda x: x.startswith(":"))
    masks = lambda df, c: df.where(some(c)).select(F.size(c).alias("n"), wild(c).alias("mask")).distinct()
    # patterns of wildcards are few, as they are those of declared routes: combined with one another they stay a small table
    patterns = masks(left, "a").unionByName(masks(paths, "b")).distinct()
    plain = left.unionByName(paths.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.col("b").alias("a"))).select(F.size("a").alias("n")).distinct()
    patterns = patterns.unionByName(plain.select("n", F.array_repeat(F.lit(False), F.col("n")).alias("mask"))).distinct()
    both = patterns.alias("x").join(patterns.alias("y"), F.col("x.n") == F.col("y.n")).select(F.col("x.n").alias("n"), F.col("x.mask").alias("mx"), F.col("y.mask").alias("my"))
    both = both.where(F.exists("mx", lambda v: v) | F.exists("my", lambda v: v)).withColumn("free", F.zip_with("mx", "my", lambda p, q: p | q))
    key = lambda c: F.zip_with(c, "free", lambda s, f: F.when(f, F.lit(":")).otherwise(s))
    asked = left.withColumn("n", F.size("a")).withColumn("mx", wild("a")).join(both, ["n", "mx"]).select("id", "mx", "my", key("a").alias("key"))
    given = paths.withColumn("n", F.size("b")).withColumn("my", wild("b")).join(both, ["n", "my"]).select("mx", "my", key("b").alias("key")).distinct()
    return left.join(asked.join(given, ["mx", "my", "key"], "left_semi").select("id").distinct(), "id", "left_anti").select("id")


def large_nodes(graph: Graph) -> DataFrame:
    """Nodes of any type of 150 lines or more. [AGG-04]"""
    return graph.nodes.where(F.col("loc") >= LARGE_LOC).select("id", "loc").orderBy(F.desc("loc"), "id")


def duplicate_names(graph: Graph) -> DataFrame:
    """name and n of components that share a name. [AGG-05]"""
    return _own(graph).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def structural_duplicates(graph: Graph) -> DataFrame:
    """shape, n and n_names of components with one shape under several names. [AGG-06]"""
    rows = _own(graph).where(F.col("shape").isNotNull() & (F.col("shape") != "")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_names"))
    return rows.where((F.col("n") > 1) & (F.col("n_names") > 1))


def channel_gaps(graph: Graph) -> DataFrame:
    """id and gap of channels invoked but not handled, or handled but not invoked. [JON-05]"""
    channels = graph.nodes.where(F.col("type") == "channel").select("id")
    sides = walk.of_kinds(graph, "invokes", "handles").groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.col("kind") == "invokes").alias("invoked"), F.bool_or(F.col("kind") == "handles").alias("handled"))
    return channels.join(sides, "id").where(F.col("invoked") != F.col("handled")).select("id", F.when(F.col("invoked"), "dangling").otherwise("orphan").alias("gap"))


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def architecture_score(graph: Graph) -> DataFrame:
    """One row: each finding's count, the score (100 less capped penalties, 0 at least) and its grade. [AGG-03, SCL-06]"""
    gaps = channel_gaps(graph).agg(F.count_if(F.col("gap") == "dangling").alias("dangling_channels"), F.count_if(F.col("gap") == "orphan").alias("orphan_handlers"))
    cyclic = walk.cycles(graph).select("cycle").distinct()
    row = _n(cyclic, "cycles")
    for name, found in (("dead", dead_code(graph)), ("large", large_nodes(graph)), ("unused_apis", unused_apis(graph)), ("duplicate_names", duplicate_names(graph)), ("duplicate_shapes", structural_duplicates(graph))):
        row = row.join(_n(found, name))  # one row each
    row = row.join(gaps)
    penalty = sum((F.least(F.lit(cap), F.col(name) * points) for name, (points, cap) in PENALTIES.items()), F.lit(0))
    row = row.withColumn("score", F.greatest(F.lit(0), F.lit(100) - penalty))
    grade = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 60, "fair").otherwise("needs attention")
    return row.withColumn("grade", grade)


def risk(routes: Column, total: Column) -> Column:
    return F.when((routes >= 3) | (total >= 20), "High").when((routes >= 1) | (total >= 6), "Medium").otherwise("Low")


def _together(parts: list[DataFrame], ddl: str, graph: Graph) -> DataFrame:
    """Rows of all blocks of starts."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return graph.nodes.sparkSession.createDataFrame([], ddl) if out is None else out


def dependents_by_type(graph: Graph, targets: DataFrame) -> DataFrame:
    """root, type and n: how many of each type depend on each target. [AGG-01]

    More than MANY_TARGETS of them are asked for by their cycles: nodes of one cycle have the same dependents, but for themselves.
    """
    targets = targets.select("id").where("id IS NOT NULL").distinct()
    if targets.limit(MANY_TARGETS + 1).count() <= MANY_TARGETS:
        return _by_type(graph, targets)
    nodes = graph.nodes.select("id")
    unknown = targets.join(nodes, "id", "left_anti")
    rows = _by_type_of_cycles(graph, targets.join(nodes, "id", "left_semi"))
    return rows if unknown.isEmpty() else rows.unionByName(_by_type(graph, unknown))


def _by_type(graph: Graph, targets: DataFrame) -> DataFrame:
    parts = []
    for found in walk.target_bits(graph, targets):
        typed = found.nodes.select(F.col("node").alias("id"), *found.bits()).join(graph.nodes.select("id", "type"), "id")
        parts.append(per_start(typed, found, ["type"]).select(F.col("start").alias("root"), "type", "n"))
    return _together(parts, "root string, type string, n long", graph)


def _by_type_of_cycles(graph: Graph, targets: DataFrame) -> DataFrame:
    """dependents_by_type of targets that are nodes: one walk finds what leads to any of them, the cycles among that are contracted, and
    the walks by blocks go from cycle to cycle over what is left."""
    scratch = Scratch(graph.nodes.sparkSession, "dependents")
    types = graph.nodes.select("id", "type")
    every = targets.select(F.lit("").alias("start"), F.col("id").alias("node"))
    into = walk.edges_into(graph, targets)
    (found,) = spread(into, every, reverse=True, known=types, written=graph.written)
    # an end that is no node leads no further and counts for nothing
    near = scratch.save(found.nodes.select(F.col("node").alias("id")).join(types, "id"))
    end = lambda name: near.select(F.col("id").alias(name))
    edges = scratch.save(into.select("src", "dst").where("src != dst").join(end("dst"), "dst", "left_semi").join(end("src"), "src", "left_semi").select("src", "dst", F.lit("any").alias("kind")).distinct())
    cyclic = walk.cycles(Graph(near, edges, written=True), "any").select(F.col("member").alias("id"), "cycle")
    near = scratch.save(near.join(cyclic, "id", "left").withColumn("cycle", F.coalesce("cycle", "id")))
    of = lambda name: near.select(F.col("id").alias(name), F.col("cycle").alias(f"{name}_cycle"))
    between = edges.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_cycle").alias("src"), F.col("dst_cycle").alias("dst")).where("src != dst").distinct()
    asked = scratch.save(targets.join(near, "id"))
    starts = asked.select(F.col("cycle").alias("start"), F.col("cycle").alias("node")).distinct()
    sizes = scratch.save(near.groupBy(F.col("cycle").alias("node"), "type").agg(F.count(F.lit(1)).alias("size")))
    parts = []
    for found in spread(between, starts, reverse=True):
        typed = found.nodes.select("node", *found.bits(own=True)).join(sizes, "node")
        parts.append(per_start(typed, found, ["type"], {"n": F.col("size")}).select(F.col("start").alias("cycle"), "type", "n"))
    counted = _together(parts, "cycle string, type string, n long", graph)
    rows = asked.select(F.col("id").alias("root"), "cycle", F.col("type").alias("own")).join(counted, "cycle")
    return rows.select("root", "type", (F.col("n") - F.when(F.col("own") == F.col("type"), 1).otherwise(0)).alias("n")).where("n > 0")


def impact(graph: Graph, targets: DataFrame) -> DataFrame:
    """Per target: how many of each type depend on it, apis, contexts and channels in their reach, the risk and the size of a change. [AGG-01, AGG-02, API-22]

    A node's row has a bit for each target that it depends on, so one walk serves a block of targets. What is in reach is one step
    on: the bits of an api are those of all that call it.
    """
    parts, contexts = [], graph.nodes.where(F.col("type") == "context").select(F.col("id").alias("dst"))
    for found in walk.target_bits(graph, targets):
        typed = found.nodes.select(F.col("node").alias("id"), *found.bits()).join(graph.nodes.select("id", "type"), "id")
        counts = {"n_dependents": F.lit(1), **{f"n_{t}s": (F.col("type") == t).cast("long") for t in ("route", "component", "file")}}
        per = per_start(typed, found, ["type"]).groupBy("start").agg(*[F.sum(c * F.col("n")).alias(n) for n, c in counts.items()])
        # a dependent that is no node leads no further and counts for nothing
        touched = found.nodes.select(F.col("node").alias("src"), *found.bits(own=True)).join(graph.nodes.select(F.col("id").alias("src")).unionByName(found.starts.select(F.col("start").alias("src"))).distinct(), "src", "left_semi")
        used = touched.join(walk.of_kinds(graph, "calls", "uses", "invokes").select("src", "dst", "kind"), "src")
        ends = used.groupBy("dst", "kind").agg(*[F.bit_or(c).alias(c) for c in bit_names(found.words)])
        ends = ends.where("kind != 'uses'").unionByName(ends.where("kind = 'uses'").join(contexts, "dst", "left_semi"))
        reach = per_start(ends, found, ["kind"]).groupBy("start").agg(*[F.sum((F.col("kind") == k).cast("long") * F.col("n")).alias(n) for n, k in (("n_apis", "calls"), ("n_contexts", "uses"), ("n_channels", "invokes"))])
        parts.append(found.starts.select("start").join(per, "start", "left").join(reach, "start", "left").withColumnRenamed("start", "root").na.fill(0))
    names = ("n_dependents", "n_routes", "n_components", "n_files", "n_apis", "n_contexts", "n_channels")
    rows = _together(parts, "root string, " + ", ".join(f"{n} long" for n in names), graph).select("root", *names)
    size = F.when((F.col("n_dependents") > 15) | (F.col("n_routes") >= 3), "L").when(F.col("n_dependents") >= 5, "M").otherwise("S")
    return rows.withColumns({"risk": risk(F.col("n_routes"), F.col("n_dependents")), "complexity": size})


def route_counts(graph: Graph, ids: DataFrame, by: str = "id") -> DataFrame:
    """id and routes: how many routes (told apart by id or name) lead to each of the ids that any leads to. One row a node and block of routes."""
    parts = []
    for found in walk.route_bits(graph, ids, by):
        rows = found.nodes.select(F.col("node").alias("id"), *found.bits()).join(ids.select("id"), "id", "left_semi")
        parts.append(rows.select("id", how_many(found.words).alias("routes")).where("routes > 0"))
    return _together(parts, "id string, routes long", graph).groupBy("id").agg(F.sum("routes").alias("routes"))


def heatmap(graph: Graph, limit: int = HEAT_LIMIT) -> DataFrame:
    """The components rendered from most places, with the routes that reach them and their stars. [AGG-07, SCL-14]"""
    components = graph.nodes.where(F.col("type") == "component").select("id")
    top = walk.of_kinds(graph, "renders", "routes_to").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("renderers")).join(components, "id", "left_semi").orderBy(F.desc("renderers"), "id").limit(limit)
    reached = route_counts(graph, top)
    stars = F.least(F.lit(5), 1 + F.floor(F.col("renderers") / 3)).cast("int")
    return top.join(reached, "id", "left").select("id", "renderers", F.coalesce("routes", F.lit(0)).alias("routes"), F.repeat(F.lit("★"), stars).alias("stars"))


def state_fanout(graph: Graph, limit: int = FANOUT_LIMIT) -> DataFrame:
    """Contexts by consumers, with a warning from 15 on. [AGG-08]"""
    contexts = graph.nodes.where(F.col("type") == "context").select("id")
    rows = walk.of_kinds(graph, "uses").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("consumers")).join(contexts, "id", "left_semi")
    return rows.orderBy(F.desc("consumers"), "id").limit(limit).withColumn("warning", F.col("consumers") >= FANOUT_WARNING)


def route_apis(graph: Graph, trees: DataFrame | None = None) -> DataFrame:
    """route and api of what each route's subtree calls; trees: the subtrees, if they are known already. [AGG-10]"""
    return (trees or walk.route_subtrees(graph)).join(walk.of_kinds(graph, "calls"), F.col("id") == F.col("src")).select("route", F.col("dst").alias("api")).distinct()


def route_links(graph: Graph, trees: DataFrame | None = None) -> DataFrame:
    """src and dst of navigation between routes, each edge's owner being every route whose subtree holds its start. [AGG-11, JON-09]"""
    routes = graph.nodes.where(F.col("type") == "route").select("id")
    owners = (trees or walk.route_subtrees(graph)).select("route", "id").unionByName(routes.select(F.col("id").alias("route"), "id"))
    links = owners.join(walk.of_kinds(graph, "navigates_to"), F.col("id") == F.col("src")).select(F.col("route").alias("src"), "dst")
    return links.where(F.col("src") != F.col("dst")).join(routes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def route_risk(graph: Graph) -> DataFrame:
    """Per route: nodes and components of its subtree, apis called in it, links to other routes, and the risk of changing it.

    Subtrees are bits; apis and links take the bits of what calls or navigates to them.
    """
    types, parts, links = graph.nodes.select("id", "type"), [], []
    routes = types.where(F.col("type") == "route").select("id")
    for found in walk.subtree_bits(graph):
        tree = found.nodes.select(F.col("node").alias("id"), *found.bits(own=True)).join(types, "id")
        per = per_start(tree, found, ["type"]).groupBy("start").agg(F.sum("n").alias("n_nodes"), F.sum(F.when(F.col("type") == "component", F.col("n")).otherwise(0)).alias("n_components"))
        inside = tree.select(F.col("id").alias("src"), *bit_names(found.words))
        apis = per_start(pushed(inside.join(walk.of_kinds(graph, "calls").select("src", "dst"), "src"), found.words, "dst"), found, [], {"n_apis": F.lit(1)})
        parts.append(per.join(apis, "start", "left").select(F.col("start").alias("route"), "n_nodes", "n_components", F.coalesce("n_apis", F.lit(0)).alias("n_apis")))
        into = inside.join(walk.of_kinds(graph, "navigates_to").select("src", "dst").join(routes.withColumnRenamed("id", "dst"), "dst", "left_semi"), "src")
        hit = pushed(into, found.words, "dst")
        links.append(hit.select(F.explode(set_bits(found.words)).alias("bit"), "dst").join(F.broadcast(found.starts), "bit").select(F.col("start").alias("src"), "dst"))
    own = walk.of_kinds(graph, "navigates_to").join(routes.withColumnRenamed("id", "src"), "src", "left_semi").join(routes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    pairs = _together([*links, own], "src string, dst string", graph).where("src != dst").distinct()
    count = pairs.groupBy(F.col("dst").alias("route")).agg(F.count(F.lit(1)).alias("n_links"))
    rows = _together(parts, "route string, n_nodes long, n_components long, n_apis long", graph).join(count, "route", "left").na.fill(0)
    return rows.withColumn("risk", risk(F.col("n_links"), F.col("n_links") + F.col("n_apis")))


def what_if_remove(graph: Graph, targets: DataFrame) -> DataFrame:
    """Per target: what breaks, what is at risk, routes that stay safe, files to touch and the risk. [AGG-12]"""
    nodes = graph.nodes.select("id", "type", "name", "file")
    goal = targets.select(F.col("id").alias("root")).distinct()
    direct = graph.edges.join(goal, F.col("dst") == F.col("root")).join(nodes.where(F.col("type") != "file"), F.col("src") == F.col("id"))
    broken = direct.groupBy("root").agg(F.count(F.lit(1)).alias("n_direct"))
    own = goal.join(nodes, F.col("root") == F.col("id")).select("root", "file")
    files = direct.select("root", "file").unionByName(own).where(F.col("file").isNotNull() & (F.col("file") != "")).groupBy("root").agg(F.count_distinct("file").alias("n_files"))
    # safe are all routes of a file but those hit: as many as there are, less the hit ones of such a name
    shown = nodes.where((F.col("type") == "route") & F.col("file").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    every = shown.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("every"))
    parts = []
    for found in walk.target_bits(graph, targets):
        typed = found.nodes.select(F.col("node").alias("id"), *found.bits()).join(nodes.select("id", "type", "name"), "id")
        per = per_start(typed, found, ["type"]).groupBy("start").agg(F.sum("n").alias("n_dependents"), F.sum(F.when(F.col("type") == "component", F.col("n")).otherwise(0)).alias("n_components"))
        # a name has the bits of all routes that bear it
        named = pushed(typed.where(F.col("type") == "route"), found.words, "name").join(shown, "name", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        hit = per_start(named, found, [], {"n_routes": F.lit(1), "n_hit": F.col("k")})
        parts.append(per.join(hit, "start", "left").withColumnRenamed("start", "root"))
    counted = _together(parts, "root string, n_dependents long, n_components long, n_routes long, n_hit long", graph)
    rows = goal.join(broken, "root", "left").join(files, "root", "left").join(counted, "root", "left").na.fill(0).join(F.broadcast(every))  # one row
    rows = rows.withColumn("n_safe_routes", F.col("every") - F.col("n_hit")).drop("n_hit", "every")
    return rows.withColumn("risk", risk(F.col("n_routes"), F.col("n_dependents")))


def what_if_split(graph: Graph, targets: DataFrame) -> DataFrame:
    """Per target: call sites, children, state and apis, and whether a split is worth it. [AGG-13]"""
    goal = targets.select("id").distinct()
    # targets may be most of the nodes, whose ids weigh far more in memory than in files: edges are counted first, and nothing is broadcast
    leave = walk.of_kinds(graph, "renders", "uses", "calls").groupBy(F.col("src").alias("id")).agg(
        F.count_if(F.col("kind") == "renders").alias("children"), F.count_if(F.col("kind") == "uses").alias("state"), F.count_if(F.col("kind") == "calls").alias("apis")
    )
    enter = walk.of_kinds(graph, "renders", "routes_to").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("call_sites"))
    rows = goal.hint("merge").join(graph.nodes.select("id", "loc").hint("merge"), "id").join(leave.hint("merge"), "id", "left").join(enter.hint("merge"), "id", "left").na.fill(0, ["children", "state", "apis", "call_sites"])
    return rows.withColumn("worth", (F.coalesce("loc", F.lit(0)) >= LARGE_LOC) | (F.col("children") >= 5))


def what_if_lazy_load(graph: Graph, target: str) -> DataFrame:
    """One row: components exclusive to the target's subtree with their lines, shared ones, entries and the verdict. [AGG-14, SET-05]

    Of a component every route that hosts it counts as another one, so only what is on no other route is exclusive.
    """
    node = graph.nodes.where(F.col("id") == target)
    trees = walk.route_subtrees(graph)
    is_route = not node.where(F.col("type") == "route").isEmpty()
    name = F.broadcast(node.select(F.col("name").alias("own_name")))
    if is_route:
        ids = trees.where(F.col("route") == target).select("id")
    else:
        ids = walk.render_subtree(graph, node).select("id").unionByName(node.select("id"))
    others = graph.nodes.where((F.col("type") == "route") & F.col("file").isNotNull() & (F.col("id") != target)).select(F.col("id").alias("route"), "name")
    if not is_route:
        others = others.join(name, F.col("name") == F.col("own_name"), "left_anti")
    elsewhere = trees.join(others, "route", "left_semi").select("id").distinct().withColumn("shared", F.lit(True))
    tree = ids.distinct().join(graph.nodes.where(F.col("type") == "component").select("id", "loc"), "id").join(elsewhere, "id", "left")
    alone = F.col("shared").isNull() & (F.col("id") != target)
    out = tree.agg(F.count_if(alone).alias("exclusive"), F.coalesce(F.sum(F.when(alone, F.coalesce("loc", F.lit(0)))), F.lit(0)).alias("exclusive_loc"), F.count_if(F.col("shared").isNotNull()).alias("shared"))
    kinds = ["navigates_to"] if is_route else ["renders", "routes_to"]
    entries = walk.of_kinds(graph, *kinds).where(F.col("dst") == target).agg(F.count(F.lit(1)).alias("entries"))
    return out.join(entries).withColumn("worthwhile", (F.col("exclusive") >= 3) | (F.col("exclusive_loc") > 200))


def what_if(graph: Graph, action: str, targets: DataFrame) -> DataFrame:
    """The simulation of an action: remove, split, or lazy_load of one target. [AGG-15]"""
    if action == "lazy_load":
        return what_if_lazy_load(graph, targets.first()["id"])
    known = {"remove": what_if_remove, "split": what_if_split}
    if action not in known:
        raise LookupError("actions: lazy_load, remove, split")
    return known[action](graph, targets)


def state_placement(graph: Graph, types: tuple[str, ...] = ("context", "hook")) -> DataFrame:
    """Per state node: consumers, routes they are on, and where the state belongs. [AGG-16]"""
    states = graph.nodes.where(F.col("type").isin(*types)).select("id")
    consumers = walk.of_kinds(graph, "uses").join(graph.nodes.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("consumers"))
    routes = route_counts(graph, states, "name")
    rows = states.join(consumers, "id", "left").join(routes, "id", "left").na.fill(0)
    return rows.withColumn("placement", F.when(F.col("consumers") <= 1, "local").when(F.col("routes") <= 1, "lift").otherwise("context"))


def recommendations(graph: Graph) -> DataFrame:
    """id and advice: split, blast radius, dead or consolidate, one row each. [AGG-17, API-23]"""
    enter = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("kind").isin("renders", "routes_to")).alias("renderers"), F.count(F.lit(1)).alias("entering"))
    calls = walk.of_kinds(graph, "calls").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("apis"))
    rows = graph.nodes.select("id", "type", "loc").join(enter, "id", "left").join(calls, "id", "left").na.fill(0, ["renderers", "entering", "apis"])
    advice = F.array(
        F.when(F.col("loc") >= LARGE_LOC, "split"), F.when(F.col("renderers") >= 5, "blast-radius"),
        F.when((F.col("type") == "component") & (F.col("renderers") == 0) & (F.col("entering") <= 1), "dead"), F.when(F.col("apis") >= 3, "consolidate"),
    )
    return rows.select("id", F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("advice"))


def data_flow(graph: Graph, targets: DataFrame, depth: int = 3) -> DataFrame:
    """root, src, kind and dst of what each target's subtree uses and calls, and what its hooks in turn use and call. [TRV-10, JON-10]"""
    ids = walk.render_subtree(graph, targets, depth).select("root", "id").unionByName(targets.select(F.col("id").alias("root"), "id")).distinct()
    links = walk.of_kinds(graph, "uses", "calls").select("src", "kind", "dst")
    first = ids.join(links, F.col("id") == F.col("src")).select("root", "src", "kind", "dst")
    hooks = graph.nodes.where(F.col("type") == "hook").select(F.col("id").alias("hook"))
    second = first.where(F.col("kind") == "uses").join(hooks, F.col("dst") == F.col("hook"), "left_semi").select("root", F.col("dst").alias("mid")).join(links, F.col("mid") == F.col("src")).select("root", "src", "kind", "dst")
    return first.unionByName(second).distinct()


def navigation_in(graph: Graph, targets: DataFrame, most_routes: int = 3, most_callers: int = 5) -> DataFrame:
    """root, route and caller: the first routes that show each target and the first navigations into them. [TRV-11, WIN-07]"""
    goal = targets.select(F.col("id").alias("root")).distinct()
    shown = walk.route_subtrees(graph).join(goal, F.col("id") == F.col("root")).select("root", "route")
    shown = shown.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("route"))).where(F.col("k") <= most_routes).drop("k")
    callers = walk.of_kinds(graph, "navigates_to").select(F.col("dst").alias("route"), F.col("src").alias("caller"))
    callers = callers.withColumn("k", F.row_number().over(Window.partitionBy("route").orderBy("caller"))).where(F.col("k") <= most_callers).drop("k")
    return shown.join(callers, "route").select("root", "route", "caller")


def api_flow(graph: Graph, most_callers: int = 8, most_routes: int = 3) -> DataFrame:
    """api, caller and route: the first callers of each api and the first routes that lead to them. [TRV-12, WIN-07]"""
    calls = walk.of_kinds(graph, "calls").select(F.col("dst").alias("api"), F.col("src").alias("caller"))
    calls = calls.withColumn("k", F.row_number().over(Window.partitionBy("api").orderBy("caller"))).where(F.col("k") <= most_callers).drop("k")
    asked, parts = calls.select(F.col("caller").alias("node")).distinct(), []
    for found in walk.route_bits(graph, asked.withColumnRenamed("node", "id")):
        # bits are numbered by id, so the lowest ones set are the first routes
        lowest = F.slice(set_bits(found.words), 1, most_routes)
        rows = found.nodes.join(asked, "node", "left_semi").select("node", *found.bits()).select(F.col("node").alias("caller"), F.explode(lowest).alias("bit"))
        parts.append(rows.join(F.broadcast(found.starts), "bit").select("caller", F.col("start").alias("route")))
    routes = _together(parts, "caller string, route string", graph)
    if len(parts) > 1:
        routes = routes.withColumn("k", F.row_number().over(Window.partitionBy("caller").orderBy("route"))).where(F.col("k") <= most_routes).drop("k")
    return calls.join(routes, "caller").select("api", "caller", "route")
