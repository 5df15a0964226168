"""Answers as Markdown and Mermaid, written from ordered rows whose number an answer's limits bound."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import mermaid_id
from loomgraph.operators import analytics, labels, ledger, lookup, temporal, traverse
from loomgraph.schema import Graph

#: Rows shown and nodes drawn at most.
SHOWN, DRAWN = 40, 22
SHAPES = {"route": ("([", "])"), "api": ("[[", "]]"), "context": ("{{", "}}"), "hook": ("(", ")"), "channel": ("[/", "/]")}


def thousands(n: Column) -> Column:
    """[SCL-08]"""
    return F.format_number(n, 0)


def table(df: DataFrame, limit: int = SHOWN) -> str:
    """A Markdown table of the first rows, with how many more there are."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + ["", "_More rows are left out._"] * (len(rows) > limit))


def flowchart(graph: Graph, edges: DataFrame, direction: str = "LR", limit: int = DRAWN) -> str:
    """A Mermaid chart of edges (src, dst, label), at most `limit` of them, once each. [DIA-01..DIA-03]"""
    names = graph.nodes.select("id", "name", "type")
    a = names.select(F.col("id").alias("src"), F.coalesce("name", "id").alias("a"), F.col("type").alias("ta"))
    b = names.select(F.col("id").alias("dst"), F.coalesce("name", "id").alias("b"), F.col("type").alias("tb"))
    rows = edges.select("src", "dst", "label").distinct().orderBy("src", "dst", "label").limit(limit).join(a, "src", "left").join(b, "dst", "left")
    rows = rows.select("*", mermaid_id(F.col("src")).alias("ia"), mermaid_id(F.col("dst")).alias("ib")).orderBy("src", "dst", "label").collect()
    lines, declared = [], {}
    for r in rows:
        for node, name, kind in ((r["ia"], r["a"] or r["src"], r["ta"]), (r["ib"], r["b"] or r["dst"], r["tb"])):
            left, right = SHAPES.get(kind, ("[", "]"))
            declared[node] = f'  {node}{left}"{html.escape(name)}"{right}'
        lines.append(f"  {r['ia']} -->" + (f"|{r['label']}| " if r["label"] else " ") + r["ib"])
    return "\n".join(["```mermaid", f"flowchart {direction}", *declared.values(), *lines, "```"])


def project_map(graph: Graph) -> str:
    """Routes with their sizes, apis and links. [AGG-10, AGG-11]"""
    links = analytics.route_links(graph).withColumn("label", F.lit(""))
    return "\n\n".join(["# Project map", table(analytics.route_risk(graph).orderBy("route")), flowchart(graph, links)])


def component_tree(graph: Graph, root: str, depth: int = traverse.TREE_DEPTH, limit: int = SHOWN) -> str:
    """An indented tree of the components below a node, the root with its file, at most `limit` lines. [TRV-04]"""
    node = graph.nodes.where(F.col("id") == root).select(F.col("id").alias("tree"), F.col("id").alias("node"))
    rows = traverse.component_trees(graph, node, depth).where(F.col("type") == "component").orderBy("place").limit(limit + 1).collect()
    lines = ["  " * r["depth"] + f"- {r['name']}" + (f" ({r['file']})" if r["depth"] == 0 else "") for r in rows[:limit]]
    return "\n".join(lines + ["- …"] * (len(rows) > limit))


def impact(graph: Graph, target: str) -> str:
    """What depends on the first matches of a target. [AGG-01]"""
    found = lookup.resolve(graph, target).orderBy(F.desc("rank"), "id").limit(3).select("id")
    dependents = traverse.dependents(graph, found).where(F.col("type") != "route").select("root", "type", "name").orderBy("root", "type", "name")
    return "\n\n".join([f"# Impact of {target}", table(analytics.impact(graph, found).orderBy("root")), table(dependents)])


def trace(graph: Graph, start: str, goal: str) -> str:
    """[TRV-06, TRV-07]"""
    ids = [lookup.resolve(graph, t).orderBy(F.desc("rank"), "id").select("id").first() for t in (start, goal)]
    rows = traverse.shortest_path(graph, ids[0]["id"], ids[1]["id"]).orderBy("hop").collect() if all(ids) else []
    if not rows:
        return f"No flow path from {start} to {goal}."
    path = [r["id"] for r in rows]
    spark = graph.nodes.sparkSession
    along = spark.createDataFrame(list(zip(path, path[1:], [""] * len(path), strict=False)), "src string, dst string, label string")
    beside = traverse.beside(graph, spark.createDataFrame([(x,) for x in path], "id string"), DRAWN)
    return "\n\n".join([f"# Flow from {start} to {goal}: {len(path) - 1} hops", flowchart(graph, along.unionByName(beside))])


def explain(graph: Graph, target: str) -> str:
    """How a node is reached, what it is made of, what flows through it, where its state belongs. [AGG-18]"""
    node = lookup.resolve(graph, target).orderBy(F.desc("rank"), "id").limit(1).select("id")
    ways = analytics.navigation_in(graph, node).select(F.col("caller").alias("src"), F.col("route").alias("dst"), F.lit("navigates").alias("label"))
    inside = traverse.render_subtree(graph, node, traverse.COMPOSITION_DEPTH).select("id").unionByName(node)
    parts = traverse.of_kinds(graph, "renders").join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", F.lit("").alias("label"))
    flow = analytics.data_flow(graph, node).select("src", "dst", F.col("kind").alias("label"))
    advice = analytics.recommendations(graph).join(node, "id", "left_semi")
    titles = ("How users reach it", "What it is composed of", "Where data flows")
    body = [f"## {t}\n\n{flowchart(graph, e)}" for t, e in zip(titles, (ways, parts, flow), strict=True)]
    return "\n\n".join([f"# {target}", *body, "## Advice", table(advice)])


def blueprint(graph: Graph, names: list[str]) -> str:
    """Labels of a sketch matched to nodes, and the route that most of them are on. [AGG-19]"""
    asked = graph.nodes.sparkSession.createDataFrame([("screen", i, x) for i, x in enumerate(names)], "screen string, place int, label string")
    elements, screens = labels.blueprint(graph, asked)
    top = screens.first()
    return "\n".join([f"# Blueprint: {(top and top['route']) or '-'}", "", table(elements.orderBy("place").select("label", "id", "n_routes"))])


def analysis(graph: Graph) -> str:
    """[AGG-03..AGG-08]"""
    parts = {"Score": analytics.architecture_score(graph), "Dead code": analytics.dead_code(graph).orderBy("id"), "Large": analytics.large_nodes(graph), "Hotspots": analytics.heatmap(graph), "State": analytics.state_fanout(graph)}
    return "\n\n".join(["# Architecture", *[f"## {k}\n\n{table(v)}" for k, v in parts.items()]])


def difference(before: Graph, after: Graph) -> str:
    """[SET-03]"""
    parts = [table(temporal.totals(before, after)), table(temporal.node_changes(before, after).orderBy("change", "type", "id")), table(temporal.movers(before, after))]
    return "\n\n".join(["# Architecture diff", *parts])


def savings(usage: DataFrame) -> str:
    """[DIA-04]"""
    by_tool = ledger.savings_by_tool(usage).orderBy(F.desc("saved"), "tool")
    pie = "\n".join(["```mermaid", "pie title Tokens saved", *[f'  "{r["tool"]}" : {max(0, r["saved"])}' for r in by_tool.limit(DRAWN).collect()], "```"])
    return "\n\n".join(["# Savings", table(ledger.savings_summary(usage)), pie, table(by_tool.withColumns({"out": thousands(F.col("out")), "base": thousands(F.col("base"))}))])


def page(graph: Graph, title: str, folder: str) -> str:
    """A page that draws the edges, and its data: nodes and edges as partitioned JSON lines in `folder` beside it, all of them. [SNK-06, SNK-07]

    `<` is escaped in the data as well, so that it may be put into the page.
    """
    for name, rows in (("nodes", graph.nodes.select("id", "type", "name")), ("edges", graph.edges.select("src", "dst", "kind"))):
        rows.select(F.replace(F.to_json(F.struct("*")), F.lit("<"), F.lit("\\u003c")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
    names = {}
    for name in ("nodes", "edges"):
        path = graph.nodes.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        files = path.getFileSystem(graph.nodes.sparkSession._jsc.hadoopConfiguration()).listStatus(path)
        names[name] = sorted(n for f in files if (n := f"{name}/{f.getPath().getName()}").startswith(f"{name}/part-"))
    data = json.dumps(names).replace("<", "\\u003c")
    script = "const show=async()=>{for(const f of g.edges){const t=await(await fetch(f)).text();for(const l of t.split('\\n'))if(l){const e=JSON.parse(l);document.getElementById('g').append(e.src+' '+e.kind+' '+e.dst+'\\n')}}};show()"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><pre id=g></pre><script>const g={data};{script}</script>"
