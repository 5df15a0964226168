import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import analytics, features, labels, ledger, lookup, merge, order, temporal, traverse
from loomgraph.schema import Graph, violations
from tests.graphs import SHORT, names, shop


def one(spark, *ids):
    return spark.createDataFrame([(SHORT[i],) for i in ids], "id string")


@pytest.fixture(scope="module")
def graph(spark):
    g = shop(spark)
    return Graph(g.nodes.cache(), g.edges.cache())


def test_subtrees_and_dependents(spark, graph):
    trees = traverse.route_subtrees(graph)
    assert names(trees.where(F.col("route") == "route:/cart")) == {"CartPage", "CartList", "Button"}
    assert names(trees.where(F.col("route") == "route:/orders")) == {"OrdersPage", "Button"}
    assert names(traverse.dependents(graph, one(spark, "Button"))) == {"CartList", "OrdersPage", "CartPage", "/cart", "/orders"}
    row = analytics.impact(graph, one(spark, "Button")).first()
    assert (row["n_routes"], row["n_dependents"], row["risk"], row["complexity"]) == (2, 5, "Medium", "M")
    assert names(traverse.render_subtree(graph, one(spark, "CartPage"))) == {"CartList", "Button"}


def test_cycles_and_paths(spark, graph):
    assert {(r["cycle"], r["member"]) for r in traverse.cycles(graph).collect()} == {("src/a.ts", "src/a.ts"), ("src/a.ts", "src/b.ts")}
    path = [r["id"] for r in traverse.shortest_path(graph, "route:/cart", "api:GET /api/orders").orderBy("hop").collect()]
    assert path == ["route:/cart", SHORT["CartPage"], "route:/orders", SHORT["OrdersPage"], "api:GET /api/orders"]
    assert traverse.shortest_path(graph, "route:/cart", "route:/cart").count() == 0
    assert traverse.shortest_path(graph, "route:/help", "route:/cart").count() == 0


def test_score(graph):
    row = analytics.architecture_score(graph).first()
    assert (row["cycles"], row["dead"], row["large"], row["unused_apis"], row["score"], row["grade"]) == (1, 2, 1, 0, 85, "good")
    assert names(analytics.dead_code(graph)) == {"Orphan", "useOld"}


def test_links_and_simulations(spark, graph):
    assert {(r["src"], r["dst"]) for r in analytics.route_links(graph).collect()} == {("route:/cart", "route:/orders"), ("route:/orders", "route:/help")}
    row = analytics.what_if_remove(graph, one(spark, "CartCtx")).first()
    assert (row["n_direct"], row["n_dependents"], row["n_routes"], row["n_safe_routes"], row["n_files"], row["risk"]) == (1, 4, 1, 1, 2, "Medium")
    row = analytics.what_if_lazy_load(graph, "route:/cart").first()
    assert (row["exclusive"], row["exclusive_loc"], row["shared"], row["entries"], row["worthwhile"]) == (2, 180, 1, 0, False)
    row = analytics.what_if_lazy_load(graph, SHORT["CartList"]).first()
    assert (row["exclusive"], row["shared"]) == (0, 2)
    placed = {r["id"]: r["placement"] for r in analytics.state_placement(graph).collect()}
    assert placed[SHORT["CartCtx"]] == "local"
    heat = [(r["id"], r["renderers"], r["routes"], r["stars"]) for r in analytics.heatmap(graph).collect()]
    assert heat[0] == (SHORT["Button"], 2, 2, "★") and {h[0] for h in heat[1:]} == {SHORT[x] for x in ("CartPage", "OrdersPage", "CartList")}
    split = analytics.what_if_split(graph, one(spark, "CartList")).first()
    assert (split["children"], split["state"], split["apis"], split["call_sites"], split["worth"]) == (1, 1, 1, 1, True)
    assert {(r["id"], r["advice"]) for r in analytics.recommendations(graph).collect()} == {(SHORT["CartList"], "split"), (SHORT["Orphan"], "dead")}
    flow = {(r["src"], r["dst"]) for r in analytics.data_flow(graph, one(spark, "CartPage")).collect()}
    assert (SHORT["useCart"], SHORT["CartCtx"]) in flow and (SHORT["CartList"], "api:POST /orders") in flow


def test_lookup(spark, graph):
    assert [(r["id"], r["rank"]) for r in lookup.resolve(graph, "CartPage").collect()] == [(SHORT["CartPage"], 1000)]
    assert [r["id"] for r in lookup.resolve(graph, "/cart").collect()] == ["route:/cart"]
    assert [r["id"] for r in lookup.resolve(graph, "artl").collect()] == [SHORT["CartList"]]
    hits = [(r["name"], r["score"]) for r in lookup.search(graph, "cart").collect()]
    assert {n for n, s in hits if s == 80} == {"CartPage", "CartList", "CartCtx"} and {n for n, s in hits if s == 60} == {"/cart", "useCart"}
    assert names(lookup.neighbours(graph, SHORT["CartList"])) == {"CartPage", "Button", "useCart", "POST /orders"}
    assert labels.match_labels(graph, spark.createDataFrame([("Cart List",)], "label string")).orderBy("place").first()["id"] == SHORT["CartList"]
    first = lookup.relations(graph, graph.nodes.where(F.col("name") == "CartList")).orderBy("place").collect()
    assert [r["relation"] for r in first] == ["calls → POST /orders", "renders → Button", "uses → useCart", "← renders by CartPage"]


def test_candidates(spark):
    text = '# Head line\n**Bold one** says "quoted" and `code x` **bold ONE** "ab" \n## ' + "x" * 50
    got = [r["name"] for r in lookup.ui_candidates(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("place").collect()]
    assert got == ["Bold one", "quoted", "code x", "Head line"]


def test_merge(spark):
    rows = [("x", 1, "first", None, None), ("x", 2, "second", "f.ts", None), ("x", 3, "third", None, True), ("x", 4, "fourth", "g.ts", True), ("y", 1, "only", None, False)]
    got = {r["id"]: r for r in merge.merge_nodes(spark.createDataFrame(rows, "id string, ord int, name string, file string, declared boolean")).collect()}
    assert (got["x"]["name"], got["x"]["file"], got["x"]["declared"]) == ("third", "f.ts", True) and got["y"]["name"] == "only"
    edges = spark.createDataFrame([("a", "calls", "b", 2, "late"), ("a", "calls", "b", 1, "early")], "src string, kind string, dst string, ord int, why string")
    assert [r["why"] for r in merge.dedup_edges(edges).collect()] == ["early"]


def test_repair_roles_and_invariants(spark, graph):
    broken = shop(spark, without_nodes=("/help",))
    assert [tuple(r) for r in merge.repair(broken).collect()] == [("route:/help", "route", "/help")]
    roles = {r["type"]: r["role"] for r in merge.normalize_roles(graph.nodes).collect()}
    assert roles["route"] == "entry-point" and roles["context"] == "state" and roles["component"] is None
    assert all(r["n"] == 0 for r in violations(graph).collect())
    assert [r["id"] for r in order.in_order(graph).nodes.orderBy("position").collect()][0].startswith("api:")


def test_differences(spark, graph):
    before = shop(spark, without_nodes=("Orphan",))
    assert [tuple(r) for r in temporal.node_changes(before, graph).collect()] == [("added", "component", SHORT["Orphan"])]
    assert temporal.node_changes(graph, graph).count() == 0
    after = shop(spark, without_edges=(("OrdersPage", "Button"),))
    assert {(r["id"], r["delta"]) for r in temporal.movers(graph, after).collect()} == {(SHORT["Button"], -1), (SHORT["OrdersPage"], -1)}
    assert temporal.totals(graph, after).first()["edge_delta"] == "-1"
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "9")], "path string, hash string")
    assert {tuple(r) for r in temporal.stale_files(stored, current).collect()} == {("b", "changed"), ("c", "gone")}
    imports = spark.createDataFrame([("a", "c"), ("b", "c"), ("e", "d")], "src string, dst string")
    assert {(r["path"], r["why"]) for r in temporal.dirty_files(stored, current, imports).collect()} == {("b", "changed"), ("d", "new"), ("e", "new"), ("a", "importer")}
    git = "branch string, head string, main_head string"
    reason = lambda a, b: temporal.drift(spark.createDataFrame([a], git), spark.createDataFrame([b], git)).first()[0]
    assert reason(("m", "1", "1"), ("m", "2", "3")) == "head" and reason(("m", "1", None), ("m", "1", "3")) is None


def test_features(graph):
    own = features.derive_features(graph)
    got = {r["feature"]: (r["n_members"], r["n_shared"]) for r in features.feature_list(graph, own).collect()}
    assert got == {"cart": (4, 1), "orders": (3, 1), "help": (1, 0)}
    assert features.find_feature(own, "CART").count() == 1
    assert ("orders", SHORT["CartPage"]) in {(r["feature"], r["src"]) for r in features.entry_points(graph, own).collect()}


def test_paths(spark):
    cases = {
        paths.route_for_file: {"app/(shop)/product/[id]/page.tsx": "/product/:id", "app/page.tsx": "/", "pages/index.tsx": "/", "pages/blog/[...slug].tsx": "/blog/:slug*", "pages/_app.tsx": None, "pages/api/x.ts": None, "src/x.ts": None},
        paths.api_route_for_file: {"app/api/orders/route.ts": "/api/orders", "pages/api/users/index.ts": "/api/users", "pages/x.tsx": None},
        paths.normalize_route: {"/a/?x=1": "/a", "/": "/", "#top": "/"},
        paths.to_pathname: {"/x?y#z": "/x", "https://h/p?q": "/p", "https://h": "/", "foo": None},
    }
    for f, pairs in cases.items():
        rows = spark.createDataFrame(list(pairs.items()), "x string, want string").select("x", "want", f(F.col("x")).alias("got")).collect()
        assert all(r["got"] == r["want"] for r in rows), (f, rows)
    shapes = [("/a/:id", "/a/7", True), ("/a", "/a/b", False), ("/:x/b", "/a/:y", True)]
    rows = spark.createDataFrame(shapes, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in rows.select("want", analytics.same_shape(analytics.segments(F.col("a")), analytics.segments(F.col("b")))).collect())


def test_estimates(spark):
    sizes = [(384, 384, 258), (385, 10, 258), (1536, 768, 516), (769, 769, 1032), (None, 1, 1290)]
    rows = spark.createDataFrame(sizes, "w int, h int, want int")
    assert all(r[0] == r[1] for r in rows.select("want", ledger.image_tokens(F.col("w"), F.col("h"))).collect())
    pairs = spark.createDataFrame([(1290, 2580, 0.0), (1000, 333, 66.7)], "i int, t int, want double")
    assert all(r[0] == r[1] for r in pairs.select("want", ledger.savings_percent(F.col("i"), F.col("t"))).collect())
    usage = spark.createDataFrame([("search", 25, 250, m) for m in (1, 2, 3, 4)], "tool string, out long, base long, ms long")
    row = ledger.savings_summary(usage).first()
    assert (row["median_ms"], row["reduction"], row["queries"]) == (3, 90, 4)
    assert ledger.savings_summary(usage.limit(0)).count() == 0
    text = spark.createDataFrame([("🙂🙂a",), ("",)], "t string").select(ledger.text_tokens(F.col("t"))).collect()
    assert [r[0] for r in text] == [2, 0]


@pytest.mark.parametrize("seed", range(2))
def test_against_a_plain_model(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(26)})
    graph = Graph(spark.createDataFrame([(i, "file", i, i) for i in ids], "id string, type string, name string, file string"), spark.createDataFrame([(a, b, "imports") for a, b in pairs], "src string, dst string, kind string"))

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    ahead = {i: reached(i) for i in ids}
    want = {i: {j for j in ids if i != j and j in ahead[i] and i in ahead[j]} | {i} for i in ids}
    got = {}
    for r in traverse.cycles(graph).collect():
        got.setdefault(r["cycle"], set()).add(r["member"])
    assert got == {min(m): m for m in want.values() if len(m) > 1}
    deps = {}
    for r in traverse.dependents(graph, graph.nodes.select("id")).collect():
        deps.setdefault(r["root"], set()).add(r["id"])
    assert deps == {i: s for i in ids if (s := {j for j in ids if j != i and i in ahead[j]})}
