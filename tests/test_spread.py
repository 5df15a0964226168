import random

import pytest

from loomgraph.operators import analytics, labels, order, spread, traverse
from loomgraph.schema import EDGES, NODES, Graph
from loomgraph.scratch import Scratch


def built(spark, seed=0, n=30, m=75):
    """A random graph with cycles, loops, routes of one name, and ends that are no nodes."""
    rng = random.Random(seed)
    types = ["route", "component", "hook", "context", "file", "api", "channel"]
    nodes = [(f"n{i}", rng.choice(types), f"name{i % 37}", f"f{i % 9}" if i % 4 else None, None, None, None, None, i, None) for i in range(n)]
    ids = [x[0] for x in nodes] + ["ghost1", "ghost2"]
    kinds = ["renders", "uses", "calls", "invokes", "routes_to", "navigates_to", "defines"]
    edges = {(rng.choice(ids), rng.choice(ids), rng.choice(kinds)) for _ in range(m)}
    return nodes, sorted(edges), Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, None, None, None) for e in edges], EDGES))


def back(nodes, edges, root):
    """Ids that lead to root, walking on from nodes only."""
    known, seen, front = {x[0] for x in nodes}, {root}, [root]
    while front:
        front = [a for v in front for a, b, _ in edges if b == v and a not in seen]
        seen |= set(front)
        front = [v for v in dict.fromkeys(front) if v in known]
    return seen - {root}


@pytest.mark.parametrize("block", [20])
def test_dependents_and_counts_equal_single_walks(spark, monkeypatch, block):
    monkeypatch.setattr(spread, "BLOCK", block)
    nodes, edges, graph = built(spark)
    targets = spark.createDataFrame([(x[0],) for x in nodes] + [("ghost1",), (None,), ("n1",)], "id string")
    want = {x: back(nodes, edges, x) for x in [*[x[0] for x in nodes], "ghost1"]}
    kind = {x[0]: x[1] for x in nodes}
    got = {(r["root"], r["id"]) for r in traverse.dependents(graph, targets).collect()}
    assert got == {(a, b) for a in want for b in want[a] if b in kind}
    counts = {(r["root"], r["type"]): r["n"] for r in analytics.dependents_by_type(graph, targets).collect()}
    expected = {}
    for a, b in got:
        expected[a, kind[b]] = expected.get((a, kind[b]), 0) + 1
    assert counts == expected
    for r in analytics.impact(graph, targets).where("root IS NOT NULL").collect():
        touched = {x for x in want[r["root"]] if x in kind} | {r["root"]}
        ends = lambda k, t=touched: {b for a, b, x in edges if x == k and a in t}
        assert (r["n_apis"], r["n_channels"], r["n_contexts"]) == (len(ends("calls")), len(ends("invokes")), len({x for x in ends("uses") if kind.get(x) == "context"})), r


@pytest.mark.parametrize("block", [8])
def test_routes_that_lead_to_nodes(spark, monkeypatch, block):
    monkeypatch.setattr(spread, "BLOCK", block)
    nodes, edges, graph = built(spark, 1, 60, 140)
    kind, name = {x[0]: x[1] for x in nodes}, {x[0]: x[2] for x in nodes}
    ahead = {x: {y for y in [*kind, "ghost1", "ghost2"] if x in back(nodes, edges, y) and y != x} for x in kind if kind[x] == "route"}
    ids = spark.createDataFrame([(x,) for x in kind], "id string")
    for by, label in (("id", lambda x: x), ("name", name.get)):
        got = {r["id"]: r["routes"] for r in analytics.route_counts(graph, ids, by).collect()}
        want = {y: len({label(x) for x in ahead if y in ahead[x]}) for y in kind}
        if by == "name":  # a route that is reached by another of its name counts that name
            assert all(got.get(y, 0) == n for y, n in want.items() if kind[y] != "route")
        else:
            assert got == {y: n for y, n in want.items() if n}
    flows = {}
    for r in analytics.api_flow(graph).collect():
        flows.setdefault((r["api"], r["caller"]), []).append(r["route"])
    assert all(sorted(v) == sorted(x for x in ahead if c in ahead[x])[:3] for (_, c), v in flows.items()) and flows


def test_no_starts_and_no_edges(spark):
    nodes, edges, graph = built(spark)
    empty = spark.createDataFrame([], "id string")
    assert traverse.dependents(graph, empty).collect() == [] and analytics.impact(graph, empty).collect() == []
    assert analytics.impact(Graph(graph.nodes, graph.edges.limit(0)), empty.union(spark.createDataFrame([("n1",)], "id string"))).first()["n_dependents"] == 0


def test_positions_are_dense_and_in_order(spark):
    rows = [(random.Random(i).choice("aBÄzé") * (i % 4), i) for i in range(500)] + [(None, 500)]
    got = order.positions(spark.createDataFrame(rows, "s string, i int"), [spark_order("s"), spark_order("i")], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(501)) and [(r["s"] or "", r["i"]) for r in got] == sorted((s or "", i) for s, i in rows)


def spark_order(name):
    from pyspark.sql import functions as F

    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name == "s" else F.col(name)


def test_search_of_many_terms_equals_a_scan(spark):
    rng = random.Random(3)
    nodes = [(f"src/{x}#{x}", t, x, None, None, None, None, None, None, None) for i in range(120) for x, t in [("".join(rng.choice("abAB1") for _ in range(rng.randint(1, 6))) + str(i), rng.choice(["component", "file"]))]]
    graph = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([], EDGES))
    terms = ["a", "ab", "abb", "src", "bab1", "zzz", "1", "aab#", nodes[3][2].lower(), "\u0000", "c/a"]
    got = {}
    for r in labels.search_terms(graph, spark.createDataFrame([(t,) for t in terms], "term string")).collect():
        got.setdefault(r["term"], set()).add((r["id"], r["score"]))

    def score(node, t):
        name, key = node[2].lower(), node[0].lower()
        return 100 if t in (name, key) else 80 if name.startswith(t) else 60 if t in name else 40 if t in key else 0

    for t in terms:
        want = sorted(((-score(x, t), x[0]) for x in nodes if score(x, t)))[:10]
        assert got.get(t, set()) == {(i, -s) for s, i in want}, t


@pytest.mark.parametrize("few", [1_000_000, 7])
def test_search_writes_and_meets_no_more_than_its_terms_ask_for(spark, monkeypatch, few):
    """Numbers share their short runs of digits with all others: by those each of n terms would meet some n / 100 nodes."""
    rows = [(f"src/{i % 7}#{i:09}", "component", name, *[None] * 7) for i in range(400) for name in [f"Item#{i * 7919:09}" if i % 9 else None]]
    graph, saved, save = Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame([], EDGES)), [], Scratch.save
    terms = [f"{i * 7919:09}" for i in range(200)] + ["a term that is longer than any name or id, of more than forty-seven letters", "item#", "src/3#000000003", "m#000007"]
    monkeypatch.setattr(labels, "FEW_TERMS", few)
    monkeypatch.setattr(labels.Scratch, "save", lambda self, df: (saved.append(save(self, df)), saved[-1])[1])
    hits = labels.search_terms(graph, spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    got = {t: {(r["id"], r["score"]) for r in hits if r["term"] == t} for t in terms}

    def score(key, name, t):
        name = (name or "").lower()
        return 100 if t in (name, key) else 80 if name.startswith(t) else 60 if t in name else 40 if t in key else 0

    for t in terms:
        want = sorted((-score(x[0], x[2], t), x[0]) for x in rows if score(x[0], x[2], t))[:10]
        assert got[t] == {(i, -s) for s, i in want}, t
    assert sum(df.count() for df in saved) <= 2 * len(terms)
    assert labels.pieces(graph, list(labels.PIECES)).join(saved[-1].where("length(term) = 9"), "piece").count() <= 3 * len(terms)


def test_dependents_of_many_targets_by_cycles(spark, monkeypatch):
    """Targets of one cycle are one start; counts are those of a walk a target, ends that are no nodes included."""
    _, _, graph = built(spark, 3)
    targets = graph.nodes.select("id").unionByName(spark.createDataFrame([("ghost1",)], "id string"))
    rows = lambda: sorted((r["root"], r["type"], r["n"]) for r in analytics.dependents_by_type(graph, targets).collect())
    expected, starts, spread_ = rows(), [], analytics.spread
    monkeypatch.setattr(analytics, "MANY_TARGETS", 5)
    monkeypatch.setattr(analytics, "spread", lambda edges, some, **o: (starts.append(some.select("start").distinct().count()), spread_(edges, some, **o))[1])
    assert rows() == expected and expected
    assert starts[0] == 1 and starts[1] < graph.nodes.count()


def test_search_never_broadcasts_index_and_nodes(spark):
    """They weigh little in files and much in the driver: Spark, which goes by files, must not choose them."""
    graph, scratch = built(spark)[2], Scratch(spark, "test")
    graph = Graph(scratch.save(graph.nodes), scratch.save(graph.edges), written=True)
    found = labels.search_terms(graph, spark.createDataFrame([(f"name{i}",) for i in range(30)], "term string"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan
    assert found.select("term").distinct().count() == 30


def test_blueprint_votes(spark):
    from tests.graphs import shop

    rows = [("s", 1, "Cart List"), ("s", 2, "Button"), ("s", 3, "nothing at all"), ("t", 1, "OrdersPage"), ("u", 1, "??")]
    elements, screens = labels.blueprint(shop(spark), spark.createDataFrame(rows, "screen string, place int, label string"))
    got = {r["screen"]: (r["n_labels"], r["n_matched"], r["route"], r["votes"]) for r in screens.collect()}
    assert got == {"s": (3, 2, "route:/cart", 2), "t": (1, 1, "route:/cart", 1), "u": (1, 0, None, 0)}
    assert {(r["screen"], r["place"]): r["n_routes"] for r in elements.collect()}["s", 3] == 0


def test_shortest_paths_of_many_pairs_equal_single_searches(spark):
    nodes, edges, graph = built(spark, 5, 25, 60)
    steps = sorted((k, b, a) for a, b, k in edges if k in traverse.FLOW_KINDS)
    ids = [x[0] for x in nodes]
    pairs = [(a, b) for a in ids[:8] for b in ids[5:15]] + [("ghost1", "n3"), ("n3", "nowhere")]

    def search(start, goal):
        """Breadth first, keeping the smallest way by kind and id of each node."""
        ways, newest = {start: ()}, {start: ()}
        while newest and goal not in ways:
            found = {}
            for v, way in newest.items():
                for k, b, a in steps:
                    if a == v and b not in ways:
                        found[b] = min(found.get(b, way + ((k, b),)), way + ((k, b),))
            newest = found
            ways.update(found)
        return [start, *[b for _, b in ways[goal]]] if goal in ways and start != goal and len(ways[goal]) <= traverse.FLOW_DEPTH else []

    got = {}
    for r in traverse.shortest_paths(graph, spark.createDataFrame(pairs, "start string, goal string")).orderBy("hop").collect():
        got.setdefault((r["start"], r["goal"]), []).append(r["id"])
    want = {p: w for p in pairs if (w := search(*p))}
    assert got == want and max(map(len, want.values())) > 3
