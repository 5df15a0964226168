import json
import os
import subprocess

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.operators import scene, temporal
from loomgraph.schema import NODES, Graph
from loomgraph.sources import store
from loomgraph.streaming import jobs
from tests.graphs import shop


def test_snapshots(spark, tmp_path):
    folder, graph = f"file://{tmp_path}/graph", shop(spark)
    name = store.save_graph(graph, folder, "root", "2026-01-01T00:00:00.000Z", "abc", ("frontend",))
    assert name == "2026-01-01T00-00-00-000Z" and store.save_graph(shop(spark), folder, "root", "2026-01-02T00:00:00.000Z") is None
    later = store.save_graph(shop(spark, without_nodes=("Orphan",)), folder, "root", "2026-01-03T00:00:00.000Z")
    assert [r["snapshot_id"] for r in store.snapshots(spark, folder).collect()] == [later, name]
    a, b = store.load_snapshot(spark, folder, name), store.load_snapshot(spark, folder, f"../x/{later}.json")
    assert [r["change"] for r in temporal.node_changes(a, b).collect()] == ["removed"]
    assert store.prune(spark, folder, keep=1) == [name] and store.snapshots(spark, folder).count() == 1


def test_content_keys_tell_rows_apart_whatever_their_order_without_json(spark, monkeypatch):
    ends, none = [("a", "b"), ("a:1", "b"), ("c", None)], spark.createDataFrame([], NODES)
    key = lambda rows: store.content_key(Graph(none, spark.createDataFrame(rows, "src string, dst string").withColumn("kind", F.lit("calls"))))
    place = F.struct(F.lit("f").alias("file"), F.lit(1).alias("line"))
    edges = spark.createDataFrame(ends, "src string, dst string")
    assert store.content_key(Graph(none, edges.withColumn("source", place))) != store.content_key(Graph(none, edges))
    assert len({key(ends), key(ends[:2]), key([*ends, ends[0]]), key([("a", "b"), ("a", "1:b"), ("c", None)]), key([("a", "b"), ("a:1", "b"), (None, "c")])}) == 5
    to_json, asked = F.to_json, []
    monkeypatch.setattr(store.F, "to_json", lambda x, *a: asked.append(x) or to_json(x, *a))
    assert key(ends) == key(ends[::-1]) and set(asked) == {"source"}  # JSON of whole rows took most of the time


def test_documents(spark, tmp_path):
    folder = f"{tmp_path}/graph"
    store.write_graph_json(shop(spark), folder, "r", F.lit("2026-01-01 00:00:00").cast("timestamp"), rows=4)
    docs = [json.loads(line) for part in (tmp_path / "graph").glob("part-*") for line in part.read_text().splitlines()]
    assert len(docs) > 4 and all(d["version"] == 2 and d["indexedAt"] == "2026-01-01T00:00:00.000Z" for d in docs)
    assert "loc" not in next(n for d in docs for n in d.get("nodes", []) if n["id"] == "route:/help")
    (tmp_path / "graph" / "old.json").write_text(json.dumps(docs[0] | {"version": 1}))
    back = store.read_graph_json(spark, folder)
    assert back.nodes.count() == 17 and back.edges.count() == 15


def test_ledger_and_images(spark, tmp_path):
    rows = spark.createDataFrame([("map", 5, 10), ("map", 6, 10)], "tool string, out long, base long").withColumn("t", F.current_timestamp())
    store.append_usage(rows, f"{tmp_path}/usage")
    (tmp_path / "usage" / "part-bad.json").write_text("{broken\n")
    assert store.read_usage(spark, f"{tmp_path}/usage").agg(F.sum("out")).first()[0] == 11
    (tmp_path / "img").mkdir()
    for name, size in (("a.png", 10), ("b.png", 99), ("c.gif", 5), ("d.webp", 0)):
        (tmp_path / "img" / name).write_bytes(b"x" * size)
    assert [r["path"].rsplit("/", 1)[-1] for r in store.images(spark, str(tmp_path / "img"), 50).collect()] == ["a.png"]


def test_git(spark, tmp_path):
    assert tuple(store.git_state(spark, str(tmp_path)).first()) == (None, None, None, None)
    subprocess.run(["git", "init", "-q", "-b", "main", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    row = store.git_state(spark, str(tmp_path)).first()
    assert row["branch"] == row["main_branch"] == "main" and row["head"] == row["main_head"]


def test_git_sidecar_and_metrics(spark, tmp_path):
    state = spark.createDataFrame([("main", "h", None, None)], "branch string, head string, main_branch string, main_head string")
    path = f"{tmp_path}/git"
    assert [store.save_git_state(state, path), store.save_git_state(state, path), store.save_git_state(state.withColumn("head", F.lit("i")), path)] == [True, False, True]
    store.append_metrics(state.select("head"), f"{tmp_path}/m")
    store.append_metrics(state.select("head"), f"{tmp_path}/m")
    assert store.read_metrics(spark, f"{tmp_path}/m", "head string").count() == 2


def test_markdown(spark):
    full = "\n".join(f"# {s}\nx" for s in store.SECTIONS)
    rows = [("plain", "plain", 7), ("```markdown\n# Screen Type\nLogin\n```", "# Screen Type\nLogin", 6), (full, full, 0), ("  # Layout \n", "# Layout", 6)]
    df = spark.createDataFrame(rows, "t string, want string, n int").withColumn("m", store.normalize_markdown(F.col("t")))
    for r in df.select("want", "n", "m", store.missing_sections(F.col("m")).alias("missing")).collect():
        assert r["m"] == r["want"] and len(r["missing"]) == r["n"]


def test_facets(spark):
    rows = [("a", "flex gap-2 p-4 px-3 text-sm text-2xl border unknown"), ("b", "flex-col flex"), ("c", "space-y-1.5 px-2 py-6"), ("d", "")]
    got = {(r["id"], r["facet"]): r["value"] for r in scene.class_facets(spark.createDataFrame(rows, "id string, classes string")).collect()}
    assert got == {("a", "dir"): "row", ("a", "gap"): "8", ("a", "pad"): "16", ("a", "size"): "2xl", ("a", "border"): "1", ("b", "dir"): "col", ("c", "dir"): "col", ("c", "gap"): "6", ("c", "pad"): "8"}


def test_layout(spark):
    schema = "tree string, id string, parent string, ord int, depth int, dir string, pad int, gap int, leaf_w double, leaf_h double"
    rows = [
        ("t", "root", None, 0, 0, "col", 10, 5, None, None), ("t", "row", "root", 0, 1, "row", 0, 4, None, None), ("t", "x", "row", 0, 2, None, None, None, 30.0, 20.0), ("t", "y", "row", 1, 2, None, None, None, 40.0, 10.0),
        ("t", "leaf", "root", 1, 1, None, None, None, 500.0, 8.0), ("u", "only", None, 0, 0, "col", 0, 0, None, None),
    ]
    got = {(r["tree"], r["id"]): (r["x"], r["y"], r["w"], r["h"]) for r in scene.layout(spark.createDataFrame(rows, schema), 200).collect()}
    assert got["t", "root"] == (0, 0, 200, 53) and got["t", "row"] == (10, 10, 180, 20) and got["t", "x"] == (10, 10, 30, 20)
    assert got["t", "y"] == (44, 15, 40, 10) and got["t", "leaf"] == (10, 35, 180, 8) and got["u", "only"] == (0, 0, 200, 0)


def test_frames_and_scores(spark):
    frame = "id string, text string, enabled boolean"
    a, b = spark.createDataFrame([("x", "1", True), ("y", "2", None)], frame), spark.createDataFrame([("x", "1", False), ("y", "2", None), ("z", "3", True)], frame)
    assert {(r["id"], r["change"]) for r in scene.frame_changes(a, b).collect()} == {("x", "changed"), ("y", "same"), ("z", "added")}
    assert scene.impact_ratio(scene.frame_changes(a, b)).first()["changed"] == 2 and scene.drifted(a, a).count() == 0 and scene.drifted(a, b).count() == 3
    seq = lambda s: spark.createDataFrame([(k, i, c) for k, w in s for i, c in enumerate(w)], "kf string, ord int, sig string")
    got = {r["kf"]: r["score"] for r in scene.alignment_scores(seq([("1", "abcbdab"), ("2", "ab")]), seq([("1", "bdcaba"), ("3", "q")])).collect()}
    assert got["1"] == pytest.approx(8 / 13) and got["2"] == 0 and got["3"] == 0
    pairs = spark.createDataFrame([("k", {"dir": "row", "gap": "4"}, {"dir": "row"}), ("n", {}, {})], "kf string, a map<string,string>, b map<string,string>")
    assert {r["kf"]: r["score"] for r in scene.facet_scores(pairs, scene.LAYOUT).collect()} == {"k": 0.5, "n": 1.0}
    deps = spark.createDataFrame([("n1", "text", ["saving", "x"]), ("n2", "on", ["saving"])], "node string, prop string, deps array<string>")
    tracked = spark.createDataFrame([("saving",)], "var string")
    assert scene.dependency_graph(deps, tracked).first()["bindings"] == ["n1.text", "n2.on"]
    assert jobs.dirty_bindings(deps.select("node", "prop", F.explode("deps").alias("var")), tracked).count() == 2
    done = spark.createDataFrame([("full", []), ("partial", ["expr-node", "spread"]), ("partial", ["expr-node"])], "status string, reasons array<string>")
    assert ("reason", "expr-node", 2) in {tuple(r) for r in scene.extraction_coverage(done).collect()}


def test_job_steps():
    steps = [("upload", None), ("upload", None), ("start", None), ("fail", "busy"), ("start", None), ("fail", "busy"), ("start", None), ("fail", "busy"), ("start", None)]
    status, attempts, waits = "", 0, []
    for event, error in steps:
        status, attempts, wait = jobs._advance(status, attempts, event, error)
        waits.append(wait)
    assert (status, attempts) == ("failed", 3) and [w for w in waits if w] == [2000, 4000]
    assert jobs._advance("processing", 1, "fail", "no-key")[0] == "failed" and jobs._advance("processing", 1, "finish", None)[0] == "done"


def test_streams(spark, tmp_path):
    lines = [("j1", "2026-01-01T00:00:00", "upload", None), ("j1", "2026-01-01T00:00:01", "start", None), ("j1", "2026-01-01T00:00:02", "fail", "busy"), ("j2", "2026-01-01T00:00:00", "upload", None)]
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "t", "event", "error"), x, strict=True))) for x in lines))
    stream = spark.readStream.schema(jobs.JOB_EVENTS).json(f"{tmp_path}/events")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    query = jobs.job_states(stream).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").start()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    jobs.run_until(query, lambda: spark.table("job_states").count() == 3, 120)
    got = sorted((r["job_id"], r["status"], r["attempts"], r["error"], r["delay_ms"]) for r in spark.table("job_states").collect())
    # the failed job waits, and when its timer rings it is queued again
    assert got == [("j1", "queued", 1, "busy", None), ("j1", "waiting", 1, "busy", 2000), ("j2", "queued", 0, None, None)]
    (tmp_path / "usage").mkdir()
    for i, t in enumerate(("2026-01-01T00:00:00", "2026-01-01T00:07:00", "2026-01-01T02:00:00")):
        (tmp_path / "usage" / f"{i}.json").write_text(json.dumps({"t": t, "tool": "map", "out": 1, "base": 2}))
    seen = []
    jobs.work_queue(spark, f"{tmp_path}/usage", "t timestamp, tool string, out long, base long", lambda df, i: seen.extend(df.collect()), f"{tmp_path}/c2").awaitTermination(120)
    assert len(seen) == 3
    query = jobs.usage_windows(jobs.usage_stream(spark, f"{tmp_path}/usage")).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    assert jobs.wait_for(query, 120) and [r["n"] for r in spark.table("windows").collect()] == [2]
    assert jobs.usage_totals(spark.read.schema("t timestamp, tool string, out long, base long").json(f"{tmp_path}/usage")).first()["n"] == 3


def test_jobs_take_what_came_in_at_once_and_say_when_time_is_up(spark, tmp_path):
    """What a batch writes is one batch for the next, however many files it is: batches don't grow with files."""
    queue = lambda folder: spark.range(40).repartition(40).select(F.col("id").cast("string").alias("job_id"), F.timestamp_micros(F.lit(0)).alias("t"), F.lit("upload").alias("event"), F.lit(None).cast("string").alias("error")).write.json(f"{folder}/in")
    finish = lambda queued: queued.select("job_id", F.lit("finish").alias("event"), F.lit(None).cast("string").alias("error"))
    folder = str(tmp_path / "jobs")
    queue(folder)
    out = lambda: spark.read.schema(jobs.JOB_STATES + ", batch int").parquet(f"{folder}/out")
    last = jobs.run_jobs(spark, folder, finish, lambda: os.path.exists(f"{folder}/out") and out().where("status = 'done'").count() == 40, 120)
    assert out().groupBy("status", "batch").count().orderBy("batch").select("status", "count").collect() == [("queued", 40), ("done", 40)]
    assert last["stateOperators"][0]["numRowsTotal"] == 0
    folder = str(tmp_path / "late")
    queue(folder)
    with pytest.raises(TimeoutError):
        jobs.run_jobs(spark, folder, finish, lambda: False, 1)


def test_a_jobs_start_and_end_differ_in_time_as_they_are_written(spark, tmp_path):
    """Tasks of a cluster that read parts of a file keep no order among each other, so the written time must tell."""
    folder = str(tmp_path / "jobs")
    spark.range(5).select(F.col("id").cast("string").alias("job_id"), F.timestamp_micros(F.lit(0)).alias("t"), F.lit("upload").alias("event"), F.lit(None).cast("string").alias("error")).write.json(f"{folder}/in")
    finish = lambda queued: queued.select("job_id", F.lit("finish").alias("event"), F.lit(None).cast("string").alias("error"))
    out = lambda: spark.read.schema(jobs.JOB_STATES).parquet(f"{folder}/out")
    jobs.run_jobs(spark, folder, finish, lambda: os.path.exists(f"{folder}/out") and out().where("status = 'done'").count() == 5, 120)
    written = spark.read.schema(jobs.JOB_EVENTS).json(f"{folder}/in").where("event <> 'upload'").groupBy("job_id").agg(F.min_by("event", "t").alias("first"), F.countDistinct("t").alias("times"))
    assert [(r["first"], r["times"]) for r in written.collect()] == [("start", 2)] * 5


class _Group:
    """A group's state and timers, as the machine is given them."""

    def __init__(self, machine):
        self.value, self.timers, self.now, self.machine = None, set(), 0, machine
        machine.init(self)

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def hear(self, *events):
        return [(r.job_id, r.status, r.attempts, r.delay_ms) for r in self.machine.handleInputRows((0,), iter([Row(job_id=j, t=t, event=e, error=None) for j, t, e in events]), self)]

    def ring(self):
        return [(r.job_id, r.status, r.attempts) for r in self.machine.handleExpiredTimer((0,), self, None)]


def test_jobs_of_a_group_share_a_state_and_go_their_own_ways():
    group = _Group(jobs.JobMachine(10_000))
    assert group.hear(("a", 1, "start"), ("a", 0, "upload"), ("b", 0, "upload"), (None, None, "upload"), ("x", 0, "start")) == [("a", "processing", 1, None), ("b", "queued", 0, None), (None, "queued", 0, None)]
    group.now = 1000
    assert group.hear(("a", 2, "fail"), ("b", 1, "start"), ("b", 2, "fail")) == [("a", "waiting", 1, 2000), ("b", "waiting", 1, 2000)] and group.timers == {3000}
    group.now = 2000
    assert group.hear(("b", 3, "start"), ("b", 4, "fail")) == [("b", "waiting", 2, 4000)] and group.timers == {3000, 6000}
    group.now = 3000
    assert group.ring() == [("a", "queued", 1)]  # b was started before its timer rang, and waits anew
    group.now = 6000
    assert group.ring() == [("b", "queued", 2)]
    group.now = 10_000  # the job without an id lapses, as nothing was heard of it; the others don't
    assert group.hear((None, 5, "start"), ("a", 5, "start"), ("a", 6, "finish")) == [("a", "done", 2, None)]
    assert [x[0] for x in group.value[0]] == ["b"]
    assert group.hear(("b", 7, "start"), ("b", 8, "finish")) == [("b", "done", 3, None)] and group.value is None
