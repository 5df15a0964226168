"""The compiled graph of the tables: what is read is made, once, and walks read the kinds that matter."""

import datetime

from loomgraph.operators import analytics, spread, traverse
from loomgraph.schema import Graph
from loomgraph.scratch import Scratch
from loomgraph.sources import tabular

SF = "/root/testdata/sf0.001"


def _graph(spark, made=None):
    def lines():
        if made is not None:
            made.append(1)
        return Scratch(spark, "lines").save(tabular.joined_lines(spark, SF))

    return tabular.TableGraph(spark, SF, lines)


def test_nodes_and_tables_of_small_kinds_are_made_without_joining_lines(spark):
    made = []
    graph = _graph(spark, made)
    assert graph.nodes.count() > 0 and graph.of_kinds("renders").count() == 150
    assert not made and set(graph._kinds) == {"renders"}
    graph.of_kinds("imports").count()
    assert made == [1] and set(graph._kinds) == {"renders", "imports"}


def test_graphs_of_a_folder_share_the_kinds_that_are_the_same_in_both(spark):
    whole = _graph(spark)
    called = tabular.TableGraph(spark, SF, whole._lines, called_only=True, whole=lambda: whole)
    early = tabular.TableGraph(spark, SF, whole._lines, until="1995-03-01", called_only=True, whole=lambda: whole)
    plain = tabular.compile_tables(spark, SF, "1995-03-01", True)
    rows = lambda df: sorted(map(str, df.select("src", "kind", "dst", "confidence").collect()))
    assert rows(early.edges) == rows(plain.edges) != rows(called.edges) == rows(whole.edges)
    assert all(called._kinds[k] is whole._kinds[k] for k in whole.ends)
    assert {k for k in whole.ends if early._kinds[k] is not whole._kinds[k]} == set(whole.dated)


def test_kinds_together_are_the_compiled_edges(spark):
    graph, plain = _graph(spark), tabular.compile_tables(spark, SF)
    rows = lambda df: sorted(map(str, df.select("src", "kind", "dst", "confidence").collect()))
    assert rows(graph.edges) == rows(plain.edges)


def test_following_lines_skip_unknown_suppliers_and_do_not_need_an_order(spark, tmp_path):
    day = datetime.datetime(1995, 1, 1)
    lines = [(1, 1, 1, 10), (1, 2, 1, 99), (1, 3, 1, 11), (1, 4, 1, 12), (2, 1, 1, 11), (2, 2, 1, 10)]
    lines = spark.createDataFrame([(o, n, p, s, 1.0, day) for o, n, p, s in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, 0), (11, 0), (12, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 5, "1-URGENT", "O")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = tabular.joined_lines(spark, str(tmp_path)).collect()
    assert sorted((r["l_suppkey"], r["following"]) for r in rows if r["following"] is not None) == [(10, 11), (11, 10)]
    assert sorted(r["l_suppkey"] for r in rows if r["ordered"]) == [10, 11, 12, 99]


def test_walks_read_only_kinds_that_lead_to_the_targets(spark):
    graph = _graph(spark)
    kinds = lambda df: {r["kind"] for r in df.select("kind").distinct().collect()}
    contexts = graph.nodes.where("type = 'context'").select("id")
    traverse.edges_into(graph, graph.nodes.where("type = 'file'"))
    assert set(graph._kinds) == {"imports"}
    assert "uses" in kinds(traverse.edges_into(graph, contexts))
    assert set(graph._kinds) == {"uses", "renders", "routes_to", "defines", "navigates_to", "imports"}
    unknown = spark.createDataFrame([("nowhere",), (None,)], "id string")
    assert traverse.edges_into(graph, unknown).count() == graph.edges.count()


def test_ends_hold_for_every_edge(spark):
    graph = _graph(spark)
    of = lambda end: graph.nodes.select(graph.nodes["id"].alias(end), graph.nodes["type"].alias(f"{end}_type"))
    seen = graph.edges.join(of("src"), "src").join(of("dst"), "dst").select("kind", "src_type", "dst_type").distinct().collect()
    assert seen and all(r["src_type"] in graph.ends[r["kind"]][0] and r["dst_type"] in graph.ends[r["kind"]][1] for r in seen)


def test_a_level_has_a_row_a_node_however_many_goals(spark):
    edges = spark.createDataFrame([(f"m{i}", f"g{j}") for i in range(3) for j in range(70)] + [("s", f"m{i}") for i in range(3)], "src string, dst string")
    goals = spark.createDataFrame([(f"g{j}", f"g{j}") for j in range(70)], "start string, node string")
    ((_, words, walked),) = spread.levels(edges, goals, True)
    assert words == 2 and [level.count() for level in walked] == [70, 3, 1, 0]


def test_shortest_flows_of_several_lengths_and_none(spark):
    edges = [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "a")]
    graph = Graph(spark.createDataFrame([(i, "component", i) for i in "abcdex"], "id string, type string, name string"), spark.createDataFrame([(*e, "renders") for e in edges], "src string, dst string, kind string"))
    pairs = spark.createDataFrame([("a", "d"), ("a", "e"), ("x", "e"), ("e", "a"), ("a", "a"), ("b", "d"), ("q", "d")], "start string, goal string")
    ways = {}
    for r in traverse.shortest_paths(graph, pairs).orderBy("hop").collect():
        ways.setdefault((r["start"], r["goal"]), []).append(r["id"])
    assert {k: "".join(v) for k, v in ways.items()} == {("a", "d"): "abd", ("a", "e"): "abde", ("x", "e"): "xabde", ("b", "d"): "bd"}
    assert traverse.shortest_paths(graph, pairs.where("start = 'x'"), 3).isEmpty()


def test_splits_of_all_components_broadcast_nothing(spark):
    graph = _graph(spark)
    plan = analytics.what_if_split(graph, graph.nodes.where("type = 'component'"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
