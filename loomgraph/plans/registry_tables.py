"""Registered queries of text, frames, styles, stores, streams and reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomgraph.functions import paths
from loomgraph.operators import analytics, features, ledger, lookup, scene, temporal, traverse
from loomgraph.plans import report
from loomgraph.plans.registry import _FEATURE, _FLOW, _LINKS, _USAGE, CUT, FIRST_PART, GRAPH, REACH, SNAPSHOTS, _first_part, _saved, _usage, query
from loomgraph.schema import Graph
from loomgraph.scratch import Scratch
from loomgraph.sources import code, store
from loomgraph.sources.tabular import table
from loomgraph.streaming import jobs

# ---- text -------------------------------------------------------------------------------------------------------

#: Descriptions of parts in Markdown: a fence around some, sections that some lack, marked names.
_NOTES = r"""WITH d AS (SELECT p_partkey AS k, (CASE WHEN p_size % 3 = 0 THEN '```markdown' || chr(10) ELSE '  ' END) || '# Screen Type' || chr(10) || 'A **' || p_name || '** in `' || p_brand || '`' || chr(10) || (CASE WHEN p_size % 2 = 0 THEN '# Components' || chr(10) || '- **' || upper(p_name) || '**: the top bar' || chr(10) || '* ' || p_type || ' — chosen' || chr(10) || '- ' || p_name || ' (again)' || chr(10) || '- "' || p_brand || '" is no name' || chr(10) || '# Layout' || chr(10) || '- Not one: of them' || chr(10) ELSE '## Layout' || chr(10) END) || (CASE WHEN p_size % 3 = 0 THEN '```' || chr(10) ELSE '' END) AS text FROM part) """


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    third, even = F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0
    text = F.concat(
        F.when(third, "```markdown\n").otherwise("  "), F.lit("# Screen Type\nA **"), "p_name", F.lit("** in `"), "p_brand", F.lit("`\n"),
        F.when(even, F.concat(F.lit("# Components\n- **"), F.upper("p_name"), F.lit("**: the top bar\n* "), "p_type", F.lit(" — chosen\n- "), "p_name", F.lit(' (again)\n- "'), "p_brand", F.lit('" is no name\n# Layout\n- Not one: of them\n'))).otherwise("## Layout\n"), F.when(third, "```\n").otherwise(""),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.alias("text"))


@query(
    _NOTES
    + r""", m AS (SELECT k, CASE WHEN text LIKE '```%' THEN trim(substr(text, 13, length(text) - 16), chr(10)) ELSE trim(trim(text, chr(10)), ' ') END AS body FROM d)
SELECT k, rtrim(body, chr(10)) AS body, array_to_string(list_filter(['Screen Type', 'Screen Sketch', 'Components', 'Layout', 'Design Style', 'Problems', 'Suggestions'], lambda s: NOT contains(chr(10) || body, chr(10) || '# ' || s)), ', ') AS missing FROM m""",
    prefix="",
)
def note_sections(spark, sf):
    """[FLT-13, SET-06]"""
    rows = _notes(spark, sf).withColumn("body", store.normalize_markdown(F.col("text")))
    return rows.select("k", "body", F.array_join(store.missing_sections(F.col("body")), ", ").alias("missing"))


_CANDIDATES = r""", f AS (SELECT k, unnest(list_concat(list_transform(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1), lambda x: {'q': 0, 'x': x}), list_transform(regexp_extract_all(text, '"([^"\n]+)"', 1), lambda x: {'q': 1, 'x': x}), list_transform(regexp_extract_all(text, '`([^`\n]+)`', 1), lambda x: {'q': 2, 'x': x}),
list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^#+\s*.+$')), lambda l: {'q': 3, 'x': regexp_extract(l, '^#+\s*(.+)$', 1)}))) AS e, generate_subscripts(list_concat(regexp_extract_all(text, '\*\*([^*\n]+)\*\*', 1), regexp_extract_all(text, '"([^"\n]+)"', 1), regexp_extract_all(text, '`([^`\n]+)`', 1), list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^#+\s*.+$'))), 1) AS p FROM d),
u AS (SELECT k, p, trim(e.x) AS name FROM f WHERE length(trim(e.x)) BETWEEN 3 AND 40 QUALIFY row_number() OVER (PARTITION BY k, lower(trim(e.x)) ORDER BY p) = 1)"""


@query(_NOTES + _CANDIDATES + " SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY p) AS INT) AS place, name FROM u", prefix="")
def ui_candidates(spark, sf):
    """[FLT-08]"""
    return lookup.ui_candidates(_notes(spark, sf).withColumnRenamed("k", "doc_id"))


@query(
    _NOTES
    + _CANDIDATES
    + r""" SELECT k AS doc_id, CAST(unnest([1, 2]) AS INT) AS place, unnest([regexp_extract(text, '- \*\*([^*]+)\*\*', 1), regexp_extract(text, '\n\* (.*) — chosen', 1)]) AS name FROM d WHERE contains(text, '# Components')
UNION ALL SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY p) AS INT), name FROM u JOIN d USING (k) WHERE NOT contains(text, '# Components')""",
    prefix="",
)
def component_names(spark, sf):
    """[FLT-09]"""
    return lookup.component_names(_notes(spark, sf).withColumnRenamed("k", "doc_id"))


@query("SELECT s_suppkey, replace(replace(replace(replace('<b a=\"' || s_name || '\">&' || s_acctbal, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS xml, '/v1/s' || s_suppkey || '/:id' AS route FROM supplier", prefix="")
def escaped_names(spark, sf):
    """[SCL-02, SCL-16, PRV-34]"""
    xml = paths.escape_xml(F.concat(F.lit('<b a="'), "s_name", F.lit('">&'), F.col("s_acctbal").cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", xml.alias("xml"), code.join_route(F.lit("/v1/"), F.concat(F.lit("/s"), F.col("s_suppkey").cast("string")), F.lit(""), F.lit(":id/")).alias("route"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM ts) % 1000 AS INT)::VARCHAR, 3, '0') || 'Z' AS at, format('{:,}', CAST(floor(value * 1000) AS BIGINT)) AS amount FROM events", prefix="")
def event_labels(spark, sf):
    """[SCL-08, SCL-10]"""
    return table(spark, sf, "events").select("event_id", paths.iso_time(F.col("ts")).alias("at"), report.thousands(F.floor(F.col("value") * 1000)).alias("amount"))


# ---- styles and frames ------------------------------------------------------------------------------------------

_CLASSES = "WITH c AS (SELECT p_partkey AS id, (CASE WHEN p_size % 2 = 0 THEN 'flex gap-' || (p_size % 7) ELSE 'flex-col space-y-' || (p_size % 5) END) || ' p-' || (p_size % 4) || ' px-6 ' || (CASE WHEN p_size > 25 THEN 'text-sm text-2xl border ' ELSE '' END) || replace(p_name, ' ', '-') AS classes, p_brand AS app FROM part) "


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    first = F.when(size % 2 == 0, F.concat(F.lit("flex gap-"), (size % 7).cast("string"))).otherwise(F.concat(F.lit("flex-col space-y-"), (size % 5).cast("string")))
    classes = F.concat(first, F.lit(" p-"), (size % 4).cast("string"), F.lit(" px-6 "), F.when(size > 25, "text-sm text-2xl border ").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), classes.alias("classes"), F.col("p_brand").alias("app"))


@query(
    _CLASSES.replace("p_brand AS app", "p_size")
    + "SELECT id, 'dir' AS facet, CASE WHEN p_size % 2 = 0 THEN 'row' ELSE 'col' END AS value FROM c UNION ALL SELECT id, 'gap', (4 * (CASE WHEN p_size % 2 = 0 THEN p_size % 7 ELSE p_size % 5 END))::VARCHAR FROM c UNION ALL SELECT id, 'pad', (4 * (p_size % 4))::VARCHAR FROM c UNION ALL SELECT id, 'size', '2xl' FROM c WHERE p_size > 25 UNION ALL SELECT id, 'border', '1' FROM c WHERE p_size > 25",
    prefix="",
)
def class_facets(spark, sf):
    """[FLT-14, FLT-15, RND-18]"""
    return scene.class_facets(_classes(spark, sf))


@query(_CLASSES + "SELECT app, c, count(*) AS n FROM (SELECT app, unnest(string_split(classes, ' ')) AS c FROM c) WHERE NOT regexp_matches(c, '^(flex|flex-col|text-sm|text-2xl|border|(gap|space-y|p|px)-[0-9]+)$') GROUP BY app, c QUALIFY row_number() OVER (PARTITION BY app ORDER BY n DESC, c) <= 22", prefix="")
def class_coverage(spark, sf):
    """[AGG-26]"""
    return scene.class_coverage(_classes(spark, sf).select("app", F.explode(F.split("classes", " ")).alias("c")))


_FRAME = "SELECT o_custkey AS id, count(*)::VARCHAR AS text, max(o_orderpriority) > '3' AS enabled FROM orders WHERE o_orderdate < TIMESTAMP '{day}' GROUP BY o_custkey"


def _frame(spark: SparkSession, sf: str, day: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp"))
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("string").alias("text"), (F.max("o_orderpriority") > "3").alias("enabled"))


_FRAMES = f"WITH a AS ({_FRAME.format(day='1995-06-01')}), b AS ({_FRAME.format(day='1995-09-01')}), ch AS (SELECT b.id, CASE WHEN a.id IS NULL THEN 'added' WHEN a.text <> b.text OR a.enabled <> b.enabled THEN 'changed' ELSE 'same' END AS change FROM b LEFT JOIN a USING (id)) "


def _frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _frame(spark, sf, "1995-06-01"), _frame(spark, sf, "1995-09-01")


@query(_FRAMES + "SELECT * FROM ch", prefix="")
def frame_changes(spark, sf):
    """[JON-14]"""
    return scene.frame_changes(*_frames(spark, sf))


@query(_FRAMES + "SELECT count(*) FILTER (WHERE change <> 'same') AS changed, count(*) AS total, count(*) FILTER (WHERE change <> 'same') / count(*) AS ratio FROM ch", prefix="")
def frame_impact(spark, sf):
    """[AGG-31]"""
    return scene.impact_ratio(scene.frame_changes(*_frames(spark, sf)))


@query(_FRAMES + "SELECT *, 'golden' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'frame' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)", prefix="")
def golden_drift(spark, sf):
    """[RND-17]"""
    return scene.drifted(*_frames(spark, sf))


@query(
    "WITH p AS (SELECT n_name AS kf, c_mktsegment AS d1, CASE WHEN c_acctbal > 0 THEN 'row' END AS g1, CASE WHEN c_acctbal < 5000 THEN 'MACHINERY' END AS d2, CASE WHEN c_acctbal > 2500 THEN 'row' END AS g2 FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT kf, d1 AS x, d2 AS y FROM p UNION ALL SELECT kf, g1, g2 FROM p) SELECT kf, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL OR y IS NOT NULL) > 0 THEN count(*) FILTER (WHERE x = y) / count(*) FILTER (WHERE x IS NOT NULL OR y IS NOT NULL) ELSE 1.0 END AS score FROM e GROUP BY kf",
    prefix="",
)
def facet_scores(spark, sf):
    """[AGG-27, AGG-28]"""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda c: F.when(c, "row")
    pairs = rows.select(F.col("n_name").alias("kf"), F.create_map(F.lit("dir"), "c_mktsegment", F.lit("gap"), row(F.col("c_acctbal") > 0)).alias("a"), F.create_map(F.lit("dir"), F.when(F.col("c_acctbal") < 5000, "MACHINERY"), F.lit("gap"), row(F.col("c_acctbal") > 2500)).alias("b"))
    return scene.facet_scores(pairs, ("dir", "gap"))


_ALIGN = "WITH RECURSIVE a AS (SELECT o_custkey AS kf, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS sig FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT o_custkey AS kf, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j, o_orderpriority AS sig FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'), bl AS (SELECT kf, list(sig ORDER BY j) AS s FROM b GROUP BY kf), "


@query(
    _ALIGN
    + """n AS (SELECT kf, count(*) AS n FROM a GROUP BY kf), k AS (SELECT kf, n, coalesce(s, []) AS s FROM n LEFT JOIN bl USING (kf)),
t(kf, i, line) AS (SELECT kf, 0::BIGINT, list_transform(range(0, len(s) + 1), lambda x: 0::BIGINT) FROM k UNION ALL SELECT t.kf, t.i + 1, list_reduce(list_transform(range(1, len(s) + 1), lambda j: [greatest(line[j + 1], line[j] + CASE WHEN s[j] = a.sig THEN 1 ELSE 0 END)]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0::BIGINT]) FROM t JOIN a ON a.kf = t.kf AND a.i = t.i + 1 JOIN k ON k.kf = t.kf),
f AS (SELECT t.kf, line[len(line)] AS c, k.n, len(k.s) AS m FROM t JOIN k ON k.kf = t.kf AND t.i = k.n) SELECT kf, 2 * c / (n + m) AS score FROM f UNION ALL SELECT kf, 0.0 FROM bl WHERE kf NOT IN (SELECT kf FROM n)""",
    prefix="",
)
def alignment_scores(spark, sf):
    """[JON-15, RND-16, AGG-29]"""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("kf"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("sig"), "o_orderdate")
    return scene.alignment_scores(orders.where("o_orderdate < '1996-01-01'"), orders.where("o_orderdate >= '2001-01-01'"))


_BOUND = "WITH b AS (SELECT DISTINCT 'c' || o_custkey AS node, 'total' AS prop, unnest([o_orderstatus, o_orderpriority]) AS var FROM orders), t AS (SELECT DISTINCT o_orderpriority AS var FROM orders WHERE o_totalprice > 400000) "


@query(_BOUND + "SELECT var, list_sort(list(DISTINCT node || '.' || prop))::VARCHAR AS bindings FROM b WHERE var IN (SELECT var FROM t) GROUP BY var", prefix="")
def dependency_graph(spark, sf):
    """[AGG-30]"""
    bindings = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.lit("total").alias("prop"), F.array("o_orderstatus", "o_orderpriority").alias("deps"))
    tracked = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("var")).distinct()
    return scene.dependency_graph(bindings, tracked).select("var", F.concat(F.lit("["), F.array_join("bindings", ", "), F.lit("]")).alias("bindings"))


@query(_BOUND + "SELECT DISTINCT node, prop FROM b WHERE var IN (SELECT var FROM t)", prefix="")
def dirty_bindings(spark, sf):
    """[STM-06]"""
    orders = table(spark, sf, "orders")
    bindings = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.lit("total").alias("prop"), F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("var"))
    return jobs.dirty_bindings(bindings, orders.where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("var")).distinct())


@query("SELECT 'status' AS kind, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL (SELECT 'reason', r, count(*) FROM (SELECT o_orderpriority AS r FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'late' FROM orders WHERE o_orderstatus = 'P') GROUP BY r ORDER BY 3 DESC, 2 LIMIT 12)", prefix="")
def extraction_coverage(spark, sf):
    """[AGG-25]"""
    reasons = F.when(F.col("o_orderstatus") == "P", F.array("o_orderpriority", F.lit("late"))).when(F.col("o_orderstatus") == "O", F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return scene.extraction_coverage(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), reasons.alias("reasons")))


# ---- positions --------------------------------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup') SELECT event_id, coalesce((SELECT 's' || max(d.event_id) FROM d WHERE d.user_id = e.user_id AND d.event_id <= e.event_id), 'u' || user_id) AS owner FROM events e WHERE event_type <> 'signup'",
    prefix="",
)
def last_owner_before(spark, sf):
    """Each event's last sign-up of its user, an as-of join by the events' order. [PRV-24, JON-11, JON-12, WIN-06]"""
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("offset"), "event_id", "event_type")
    declared = rows.where("event_type = 'signup'").select("path", "offset", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("owner"))
    return code.owned(rows.where("event_type <> 'signup'"), declared).select("event_id", "owner")


# ---- stores -----------------------------------------------------------------------------------------------------


@query(" SELECT 'before' AS which, type, count(*) AS n, 2 AS snapshots FROM nodes_a GROUP BY type UNION ALL SELECT 'after', type, count(*), 2 FROM nodes_b GROUP BY type", SNAPSHOTS)
def stored_snapshots(spark, sf):
    """Two graphs saved, a third that equals the second not, the list, and both read back by name. [SNK-01, SNK-02, SRC-08, SRC-09, WIN-09]"""
    folder = Scratch(spark, "snapshots").path + "/graph"
    before, after = _saved(spark, sf, until=CUT, called_only=True), _saved(spark, sf, called_only=True)
    first = store.save_graph(before, folder, "root", "1995-03-01T00:00:00.000Z")
    second = store.save_graph(after, folder, "root", "2001-12-01T00:00:00.000Z")
    again = store.save_graph(Graph(after.nodes.orderBy("name"), after.edges.orderBy("dst")), folder, "root", "2001-12-02T00:00:00.000Z")
    n = store.snapshots(spark, folder).count() + (again is not None)
    out = None
    for which, name in (("before", first), ("after", second)):
        one = store.load_snapshot(spark, folder, f"x/{name}.json").nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("which"), "type", "n", F.lit(n).alias("snapshots"))
        out = one if out is None else out.unionByName(one)
    return out


@query(" SELECT src, kind, dst, (SELECT type FROM nodes WHERE id = src) AS type FROM edges")
def graph_document(spark, sf):
    """The graph as JSON documents, read back. [SRC-07, SRC-14, SCL-12]"""
    folder = Scratch(spark, "documents").path + "/graph"
    store.write_graph_json(_saved(spark, sf), folder, "root", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    graph = store.read_graph_json(spark, folder)
    return graph.edges.select("src", "kind", "dst").join(graph.nodes.select(F.col("id").alias("src"), "type"), "src")


@query(_USAGE + "SELECT tool, count(*) AS n, sum(out)::BIGINT AS out, sum(base)::BIGINT AS base FROM u GROUP BY tool", prefix="")
def usage_ledger(spark, sf):
    """Usage appended as JSON in two goes, with a broken line between, and read back. [SRC-10, SNK-04, SNK-05]"""
    folder = Scratch(spark, "ledger").path + "/usage"
    usage = _usage(spark, sf)
    store.append_usage(usage.where("tool = 'map'"), folder)
    store.append_usage(usage.where("tool <> 'map'"), folder)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(folder)
    return jobs.usage_totals(store.read_usage(spark, folder))


@query("SELECT day, CASE WHEN branch <> (SELECT branch FROM s) THEN 'branch' WHEN head <> (SELECT head FROM s) THEN 'head' WHEN main_head <> (SELECT main_head FROM s) THEN 'main' END AS reason, branch <> (SELECT branch FROM s) OR head <> (SELECT head FROM s) OR main_head <> (SELECT main_head FROM s) AS written FROM d", "WITH d AS (SELECT o_orderpriority AS day, o_orderpriority[1] < '3' AS low, CASE WHEN o_orderpriority[1] < '3' THEN 'low' ELSE 'main' END AS branch, CASE WHEN o_orderpriority[1] = '4' THEN 'x' ELSE 'h' END AS head, CASE WHEN count(*) > 0 AND o_orderpriority[1] = '5' THEN 'y' ELSE 'm' END AS main_head FROM orders GROUP BY o_orderpriority), s AS (SELECT 'main' AS branch, 'h' AS head, 'm' AS main_head) ")
def git_drift(spark, sf):
    """Positions by order priority against a stored one: why an index is stale, and whether the sidecar is written anew. [SET-08, SNK-03]"""
    digit = F.substring("o_orderpriority", 1, 1)
    position = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("day")).agg(F.first(digit).alias("d"))
    position = position.select("day", F.when(F.col("d") < "3", "low").otherwise("main").alias("branch"), F.when(F.col("d") == "4", "x").otherwise("h").alias("head"), F.when(F.col("d") == "5", "y").otherwise("m").alias("main_head"))
    scratch = Scratch(spark, "git")
    stored = spark.range(1).select(F.lit("main").alias("branch"), F.lit("h").alias("head"), F.lit("m").alias("main_head"))
    out = None
    for i, day in enumerate(sorted(r["day"] for r in position.select("day").collect())):  # as many as there are priorities
        now = position.where(F.col("day") == day).drop("day")
        path = f"{scratch.path}/side-{i}"
        store.save_git_state(stored, path)
        written = store.save_git_state(now, path)
        one = temporal.drift(stored, now).select(F.lit(day).alias("day"), "reason", F.lit(written).alias("written"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderpriority AS kf, count(*) AS overall, CAST(count(*) - first(g.n) AS BIGINT) AS delta, CAST(2 AS BIGINT) AS runs FROM orders JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) g ON g.p = o_orderpriority GROUP BY o_orderpriority", prefix="")
def metrics_history(spark, sf):
    """Scores appended to a history, the first run blessed as golden, the second compared with it. [SNK-11, RND-17]"""
    folder = Scratch(spark, "metrics").path
    per = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("kf")).agg(F.count(F.lit(1)).alias("overall"))
    orders = table(spark, sf, "orders")
    first, second = per(orders.where("o_orderdate < '1996-01-01'")), per(orders)
    for run, rows in ((1, first), (2, second)):
        store.append_metrics(rows.withColumn("run", F.lit(run)), f"{folder}/history")
    store.bless(first, f"{folder}/golden")
    runs = store.read_metrics(spark, f"{folder}/history", "kf string, overall long, run int").groupBy("kf").agg(F.count(F.lit(1)).alias("runs"))
    golden = spark.read.parquet(f"{folder}/golden").select("kf", F.col("overall").alias("golden"))
    return second.join(golden, "kf").join(runs, "kf").select("kf", "overall", (F.col("overall") - F.col("golden")).alias("delta"), "runs")


@query(" , d AS (SELECT DISTINCT 'supplier/' || s_suppkey AS path FROM supplier WHERE s_acctbal < 0) SELECT src, kind, dst FROM edges WHERE split_part(src, '#', 1) NOT IN (SELECT path FROM d)")
def carried_over_edges(spark, sf):
    """[PRV-11, PRV-12]"""
    dirty = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path"))
    return temporal.carried_over(_saved(spark, sf).edges, dirty).select("src", "kind", "dst")


@query(
    REACH + ", f AS (SELECT 'coast' AS feature, 'route:/asia' AS route UNION ALL SELECT 'coast', 'route:/africa' UNION ALL SELECT 'inland', 'route:/europe'), mem AS (SELECT feature, route AS id FROM f UNION SELECT feature, subtree.id FROM subtree JOIN f USING (route)) SELECT feature, count(*) AS n_members, count(*) FILTER (WHERE k > 1) AS n_shared FROM mem JOIN (SELECT id, count(*) AS k FROM mem GROUP BY id) USING (id) GROUP BY feature"
)
def configured_features(spark, sf):
    """Features of a user's file, written from the regions and read back. [FEA-01, FEA-03]"""
    path = Scratch(spark, "features").path + "/config"
    feature = F.when(F.col("r_name").isin("ASIA", "AFRICA"), "coast").when(F.col("r_name") == "EUROPE", "inland")
    rows = table(spark, sf, "region").select(feature.alias("name"), F.concat(F.lit("/"), F.lower("r_name")).alias("route")).where("name IS NOT NULL")
    rows.groupBy("name").agg(F.collect_list("route").alias("routes")).write.json(path)
    graph = _saved(spark, sf)
    return features.feature_list(graph, features.load_features(spark, path, graph))


# ---- streams ----------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a stream of files, and a folder for what it writes."""
    folder = Scratch(spark, name).path
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


def _in_time(spark: SparkSession, rows: DataFrame, column: str, name: str, steps: int = 4) -> tuple[DataFrame, str]:
    """The rows as a stream of several files, which come in as many micro-batches as there are steps, each of a later range of time."""
    folder = Scratch(spark, name).path
    bounds = rows.agg(F.percentile_approx(F.col(column).cast("double"), [i / steps for i in range(1, steps)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(bounds)), None]
    at, files = F.col(column).cast("double"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        part.repartition(files).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


def _numbered(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("batch", IntegerType())])


def _finished(stream: DataFrame, folder: str, mode: str, schema) -> DataFrame:
    """What the stream's last micro-batches wrote, each batch under its number."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    if not jobs.wait_for(run, 3600):
        raise TimeoutError("the stream didn't end")
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query(_USAGE + "SELECT tool, count(*) AS n, sum(out)::BIGINT AS out, sum(base)::BIGINT AS base FROM u GROUP BY tool", prefix="")
def usage_totals_stream(spark, sf):
    """[STM-04, STM-07]"""
    stream, folder = _streamed(spark, _usage(spark, sf), "totals")
    totals = jobs.usage_totals(stream)
    rows = _finished(totals, folder, "complete", _numbered(totals))
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch").drop("batch")


@query(_USAGE + ", w AS (SELECT time_bucket(INTERVAL '10 minutes', t) AS start, tool, count(*) AS n, sum(out)::BIGINT AS out FROM u GROUP BY ALL) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, tool, n, out FROM w WHERE start + INTERVAL '10 minutes' <= (SELECT max(t) FROM u) - INTERVAL '10 minutes'", prefix="")
def usage_windows_stream(spark, sf):
    """Windows that the watermark has closed."""
    usage = _usage(spark, sf).withColumn("t", F.col("t").cast("timestamp"))
    stream, folder = _in_time(spark, usage, "t", "windows")
    windows = jobs.usage_windows(stream)
    rows = _finished(windows, folder, "append", windows.schema)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tool", "n", "out")


_JOBS = """WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'click' THEN 'start' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'fail' END AS event, CASE WHEN event_type = 'error' THEN CASE WHEN value > 95 THEN 'no-key' ELSE 'busy' END END AS error FROM events),
r(job, k, status, attempts) AS (SELECT DISTINCT job, 0::BIGINT, '', 0 FROM e UNION ALL SELECT r.job, e.k, CASE WHEN event = 'upload' AND status IN ('', 'done', 'failed') THEN 'queued' WHEN event = 'start' AND status = 'queued' THEN 'processing' WHEN event = 'finish' AND status = 'processing' THEN 'done' WHEN event = 'fail' AND status = 'processing' THEN CASE WHEN error = 'no-key' OR attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END, CASE WHEN event = 'start' AND status = 'queued' THEN attempts + 1 WHEN event = 'upload' AND status IN ('', 'done', 'failed') THEN 0 ELSE attempts END FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1)
"""


@query(_JOBS + "SELECT 'j' || job AS job_id, status, attempts FROM r WHERE status <> '' QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1", prefix="")
def job_states_stream(spark, sf):
    """[STM-02, STM-03]"""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "upload").when(kind.isin("click", "view"), "start").when(kind == "purchase", "finish").otherwise("fail")
    error = F.when(kind == "error", F.when(F.col("value") > 95, "no-key").otherwise("busy"))
    rows = table(spark, sf, "events").select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), F.col("ts").cast("timestamp").alias("t"), event.alias("event"), error.alias("error"))
    # a file holds whole jobs, so that their events come in order; files come in several micro-batches
    folder = Scratch(spark, "jobs").path
    rows.repartition(3 * jobs.CONCURRENCY, "job_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", jobs.CONCURRENCY).parquet(f"{folder}/in")
    before, total = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), rows.count()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    try:
        states = jobs.job_states(stream)
        run = states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    jobs.run_until(run, lambda: jobs.rows_read(run) >= total, 3600)
    rows = spark.read.schema(_numbered(states)).parquet(f"{folder}/out")
    last = Window.partitionBy("job_id").orderBy(F.desc("batch"))
    # a job that waits for another attempt counts as queued, whether its timer has rung in the meantime or not
    status = F.when(F.col("status") == "waiting", "queued").otherwise(F.col("status")).alias("status")
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").select("job_id", status, "attempts")


@query("SELECT o_orderpriority AS tool, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY o_orderpriority", prefix="")
def work_queue_results(spark, sf):
    """Jobs taken from files a few at a time, each micro-batch's results stored under its number. [STM-01, SNK-09]"""
    folder = Scratch(spark, "queue").path
    jobs_ = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("tool"))
    jobs_.repartition(8).write.json(f"{folder}/in")

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    if not jobs.wait_for(jobs.work_queue(spark, f"{folder}/in", "key long, tool string", handle, f"{folder}/state"), 3600):
        raise TimeoutError("the queue didn't empty")
    return spark.read.parquet(f"{folder}/out").groupBy("tool").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


# ---- reports ----------------------------------------------------------------------------------------------------


@query(
    REACH
    + _LINKS
    + """, l AS (SELECT src, dst FROM links ORDER BY src, dst LIMIT 22), m AS (SELECT *, 'n_' || regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') AS n FROM nodes WHERE id IN (SELECT src FROM l UNION SELECT dst FROM l))
SELECT '  ' || n || '(["' || name || '"])' AS line FROM m UNION ALL SELECT '  ' || a.n || ' --> ' || b.n FROM l JOIN m a ON a.id = l.src JOIN m b ON b.id = l.dst UNION ALL SELECT unnest(['```mermaid', 'flowchart LR', '```'])"""
)
def navigation_chart(spark, sf):
    """The lines of the chart of links between routes. [DIA-01, DIA-02, DIA-03, SNK-08]"""
    graph = _saved(spark, sf)
    text = report.flowchart(graph, analytics.route_links(graph).withColumn("label", F.lit("")))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(_USAGE + ", s AS (SELECT tool, sum(base) - sum(out) AS saved FROM u GROUP BY tool) SELECT '  \"' || tool || '\" : ' || greatest(0, saved)::BIGINT AS line FROM s", prefix="")
def savings_pie(spark, sf):
    """[DIA-04]"""
    text = report.savings(_usage(spark, sf))
    return spark.createDataFrame([(line,) for line in text.split("\n") if line.startswith('  "')], "line string")


@query(
    _FLOW
    + f""", tail(id, hop) AS (SELECT id, hop FROM level WHERE id = {FIRST_PART} UNION SELECT l.id, l.hop FROM tail JOIN flows e ON e.dst = tail.id JOIN level l ON l.id = e.src AND l.hop = tail.hop - 1),
way(id, hop, k, ids) AS (SELECT 'route:/asia', 0, CAST([] AS VARCHAR[]), ['route:/asia'] UNION ALL SELECT e.dst, way.hop + 1, list_concat(k, [e.kind, e.dst]), list_append(ids, e.dst) FROM way JOIN flows e ON e.src = way.id JOIN tail t ON t.id = e.dst AND t.hop = way.hop + 1),
best AS (SELECT ids FROM way WHERE id = {FIRST_PART} ORDER BY k LIMIT 1) SELECT src, dst, kind AS label FROM edges WHERE kind IN ('calls', 'navigates_to') AND src IN (SELECT unnest(ids) FROM best) AND dst NOT IN (SELECT unnest(ids) FROM best) ORDER BY src, dst, label LIMIT 22"""
)
def flow_beside(spark, sf):
    """Calls and other ways off the shortest flow. [TRV-07]"""
    graph = _saved(spark, sf)
    return traverse.beside(graph, traverse.shortest_path(graph, "route:/asia", _first_part(spark, sf)))


@query(
    """ SELECT * FROM (SELECT action, id, verdict FROM (SELECT 'split' AS action, id, CASE WHEN coalesce(loc, 0) >= 150 OR (SELECT count(*) FROM edges WHERE src = nodes.id AND kind = 'renders') >= 5 THEN 'worth it' ELSE 'leave' END AS verdict FROM nodes WHERE file = 'nation'
UNION ALL SELECT 'remove', id, 'High' FROM nodes WHERE file = 'nation'))"""
)
def what_if_actions(spark, sf):
    """Verdicts of two simulations by one dispatcher. [AGG-15]"""
    graph = _saved(spark, sf)
    goal = graph.nodes.where("file = 'nation'").select("id")
    split = analytics.what_if(graph, "split", goal).select(F.lit("split").alias("action"), "id", F.when(F.col("worth"), "worth it").otherwise("leave").alias("verdict"))
    remove = analytics.what_if(graph, "remove", goal).select(F.lit("remove").alias("action"), F.col("root").alias("id"), F.col("risk").alias("verdict"))
    return split.unionByName(remove)
