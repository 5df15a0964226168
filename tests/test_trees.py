import random

from pyspark.sql import functions as F

from loomgraph.operators import intervals, refresh, trees


def test_preorder_equals_a_walk(spark):
    rng = random.Random(0)
    rows = []
    for t in range(4):
        for i in range([1, 40, 200, 60][t]):
            p = None if i == 0 or (t == 3 and i % 20 == 0) else i - 1 if t == 1 else rng.randrange(0, i)
            rows.append((f"t{t}", i, p, rng.random()))
    below, weight = {}, {(t, i): w for t, i, _, w in rows}
    for t, i, p, w in rows:
        below.setdefault((t, p), []).append(i)
    want = {}

    def walk(t, v, depth, count):
        place = count[0]
        count[0] += 1
        for c in sorted(below.get((t, v), []), key=lambda x: weight[t, x]):
            walk(t, c, depth + 1, count)
        want[t, v] = (place, depth, count[0] - 1)

    for t in range(4):
        count = [0]
        for r in sorted(below[f"t{t}", None], key=lambda x, t=t: weight[f"t{t}", x]):
            walk(f"t{t}", r, 0, count)
    df = spark.createDataFrame(rows, "tree string, node int, parent int, w double")
    got = {(r["tree"], r["node"]): (r["place"], r["depth"], r["last"]) for r in trees.preorder(df, [F.col("w")]).collect()}
    assert got == want
    loop = spark.createDataFrame([("a", 1, 2, 0.0), ("a", 2, 1, 0.0), ("b", 1, None, 0.0)], "tree string, node int, parent int, w double")
    assert [(r["tree"], r["place"]) for r in trees.preorder(loop, [F.col("w")]).collect()] == [("b", 0)]


def test_intervals_equal_every_pair(spark):
    rng = random.Random(1)
    ranges = [(k, s, s + rng.choice([0, 1, 5, 64, 1000, -3]), f"r{i}") for i in range(60) for k, s in [(rng.choice("ab"), rng.randrange(0, 500))]] + [("a", 0, 1 << 40, "all"), (None, 0, 9, "none")]
    points = [(rng.choice("abc"), i, rng.randrange(0, 1200)) for i in range(150)] + [("a", 999, None), (None, 998, 3)]
    p, r = spark.createDataFrame(points, "k string, id int, pos long"), spark.createDataFrame(ranges, "k string, start long, end long, name string")
    got = sorted((x["id"], x["name"]) for x in intervals.within(p, r, ["k"]).collect())
    want = sorted((i, n) for k, i, x in points if k and x is not None for q, s, e, n in ranges if q == k and s <= x < e)
    assert got == want and len(got) > 50
    for x in intervals.enclosing(p, r, ["k"], ["id"], "name").collect():
        held = [(s, e, n) for q, s, e, n in ranges if q == x["k"] is not None and x["pos"] is not None and s <= x["pos"] < e]
        outer = min(held, key=lambda y: (y[0], -y[1], y[2]), default=(0, 0, None))[2]
        inner = min(held, key=lambda y: (-y[0], y[1], y[2]), default=(0, 0, None))[2]
        assert (x["n"], x["outer"], x["inner"]) == (len(held), outer, inner)


def test_refresh_equals_a_full_build(spark, tmp_path):
    """A new route gives kept navigations another end, and a new file resolves an old import."""
    store = refresh.Store(spark, f"file://{tmp_path}/g")
    put = lambda seq, path, *facts: (seq, path, "put", [dict(zip(("fact", "name", "target"), x, strict=True)) for x in facts])
    steps = [
        [put(0, "a", ("node", "A", "component"), ("nav", "A", "/x/1"), ("import", None, "b")), put(0, "r", ("route", None, "/x/:id"))],
        [put(1, "s", ("route", None, "/:any/1")), put(1, "b", ("node", "B", "component"))],
        [put(2, "t", ("route", None, "/x/1")), (2, "s", "delete", None)],
        [(3, "t", "delete", None), (3, "b", "delete", None), put(4, "a", ("nav", "A", "/x/1"), ("nav", "A", "/x/1"), ("nav", "A", "/none"))],
    ]
    want = [
        {("A", "route:/x/:id", 1)},
        {("A", "route:/x/1", 1), ("a", "b", 1)},
        {("A", "route:/x/1", 1), ("a", "b", 1)},
        {("A", "route:/x/:id", 2), ("A", "route:/none", 1)},
    ]
    for i, rows in enumerate(steps):
        changes = spark.createDataFrame(rows, refresh.CHANGES)
        refresh.refresh(store, changes, i)
        if i == 2:
            refresh.refresh(store, changes, i)  # a batch that runs again changes nothing
        assert {(r["src"], r["dst"], r["n"]) for r in store.read("edges").collect()} == want[i], i
    assert {r["id"] for r in store.graph().nodes.collect()} == {"a", "r", "route:/x/:id"}


def test_a_batch_sums_no_log_of_facts(spark, tmp_path, monkeypatch):
    """Its own changes and the differences that moved files and routes make are enough; a put without facts is a file."""
    store, asked = refresh.Store(spark, f"file://{tmp_path}/g"), []
    read = store.read
    monkeypatch.setattr(store, "read", lambda table, *a: asked.append(table) or read(table, *a))
    nav = [{"fact": "nav", "name": "A", "target": "/x/1"}, {"fact": "import", "name": None, "target": "b"}]
    refresh.refresh(store, spark.createDataFrame([(0, "a", "put", nav), (0, "b", "put", None)], refresh.CHANGES), 0)
    refresh.refresh(store, spark.createDataFrame([(1, "a", "put", nav), (1, "r", "put", [{"fact": "route", "name": None, "target": "/x/:id"}]), (1, "b", "delete", None)], refresh.CHANGES), 1)
    assert asked == []
    assert {(r["src"], r["dst"], r["n"]) for r in read("edges").collect()} == {("A", "route:/x/:id", 1)}
    assert {(r["src"], r["dst"], r["n"]) for r in read("edges", 1).collect()} == {("A", "route:/x/1", 1), ("a", "b", 1)}
    assert {(r["id"], r["n"]) for r in read("nodes").collect()} == {("a", 1), ("r", 1), ("route:/x/:id", 1)}
