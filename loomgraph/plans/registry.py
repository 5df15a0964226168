"""Registered queries over the driver's tables and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import analytics, features, labels, ledger, lookup, merge, temporal, traverse
from loomgraph.schema import NODE_TYPES, Graph, violations
from loomgraph.scratch import Scratch, partitioned
from loomgraph.sources import pages as page_source
from loomgraph.sources.tabular import TableGraph, joined_lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUT = "1995-03-01"

# ---- the graph in SQL -------------------------------------------------------------------------------------------


def _graph_sql(suffix: str = "", until: str = "", called_only: bool = False) -> str:
    """The provider's two tables as DuckDB common table expressions."""
    when = f" AND l_shipdate < TIMESTAMP '{until}'" if until else ""
    parts = f"(SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lines{suffix}))" if called_only else "part"
    return f"""
lines{suffix} AS (SELECT DISTINCT o_custkey, o_orderpriority, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE true{when}),
parts{suffix} AS (SELECT * FROM {parts}),
pairs{suffix} AS (SELECT DISTINCT 'supplier/' || a AS src, 'supplier/' || b AS dst FROM (SELECT l_suppkey AS a, s_nationkey AS m, lead(l_suppkey) OVER w AS b, lead(s_nationkey) OVER w AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE a <> b AND m = n),
channels{suffix} AS (SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'channel:status/' || o_orderstatus AS dst, 'invokes' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'native/' || n_name, 'channel:status/' || flag, 'handles' FROM (SELECT l_suppkey, l_linestatus AS flag FROM lineitem UNION SELECT l_suppkey, l_returnflag FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nodes{suffix} AS (
  SELECT 'route:/' || replace(lower(r_name), ' ', '-') AS id, 'route' AS type, '/' || replace(lower(r_name), ' ', '-') AS name, 'region' AS file, NULL::INT AS loc, NULL::VARCHAR AS shape, NULL::BOOLEAN AS declared FROM region
  UNION ALL SELECT 'nation#' || n_name, 'component', n_name, 'nation', NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer#' || c_custkey, 'component', c_name, 'customer', greatest(1, floor(c_acctbal / 60))::INT, substr(sha1(c_mktsegment || '>' || c_nationkey), 1, 12), NULL FROM customer
  UNION ALL SELECT 'api:GET /part/' || p_partkey, 'api', 'GET /part/' || p_partkey, NULL, NULL, NULL, p_size > 25 FROM parts{suffix}
  UNION ALL SELECT DISTINCT 'brand#' || p_brand, 'context', p_brand, 'brand', NULL::INT, NULL, NULL::BOOLEAN FROM parts{suffix}
  UNION ALL SELECT 'supplier/' || s_suppkey, 'file', s_name, 'supplier/' || s_suppkey, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'api:POST /part/' || p_partkey, 'api', 'POST /part/' || p_partkey, NULL, NULL, NULL, true FROM part WHERE p_size > 40
  UNION ALL SELECT 'api:GET /:method/part/' || n_nationkey, 'api', 'GET /:method/part/' || n_nationkey, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'hook#use' || h, 'hook', 'use' || h, 'hook', NULL, NULL, NULL FROM (SELECT o_orderpriority AS h FROM orders UNION SELECT c_mktsegment FROM customer)
  UNION ALL SELECT 'native/' || n_name, 'native', n_name, 'native/' || n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT DISTINCT dst, 'channel', substr(dst, 9), NULL, NULL::INT, NULL, NULL::BOOLEAN FROM channels{suffix}),
edges{suffix} AS (
  SELECT 'route:/' || replace(lower(r_name), ' ', '-') AS src, 'nation#' || n_name AS dst, 'routes_to' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'nation#' || n_name, 'customer#' || c_custkey, 'renders' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'customer#' || o_custkey, 'api:GET /part/' || l_partkey, 'calls' FROM lines{suffix}
  UNION ALL SELECT DISTINCT 'customer#' || o_custkey, 'brand#' || p_brand, 'uses' FROM lines{suffix} JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT 'hook#use' || o_orderpriority, 'brand#' || p_brand, 'uses' FROM lines{suffix} JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT 'customer#' || o_custkey, 'hook#use' || o_orderpriority, 'uses' FROM lines{suffix}
  UNION ALL SELECT 'nation#' || n_name, 'api:GET /:method/part/' || n_nationkey, 'calls' FROM nation
  UNION ALL SELECT src, dst, kind FROM channels{suffix}
  UNION ALL SELECT src, dst, 'imports' FROM pairs{suffix}
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation#' || n_name, 'defines' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'customer#' || o_custkey, 'route:/' || replace(lower(r_name), ' ', '-'), 'navigates_to' FROM lines{suffix} JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


GRAPH = "WITH RECURSIVE" + _graph_sql()
SNAPSHOTS = "WITH RECURSIVE" + _graph_sql("_a", CUT, True) + "," + _graph_sql("_b", "", True)
REACH = """, tree(route, id, d) AS (SELECT src, dst, 0 FROM edges WHERE kind = 'routes_to' UNION SELECT tree.route, e.dst, d + 1 FROM tree JOIN edges e ON e.src = tree.id AND e.kind IN ('renders', 'defines') WHERE d < 10),
subtree AS (SELECT DISTINCT route, id FROM tree WHERE id IN (SELECT id FROM nodes))"""


def _dependents(seeds: str) -> str:
    return f""", goal AS ({seeds}), back(root, id) AS (SELECT id, id FROM goal UNION SELECT back.root, e.src FROM back JOIN edges e ON e.dst = back.id),
deps AS (SELECT root, n.id, n.type, n.name, n.file FROM back JOIN nodes n ON n.id = back.id WHERE root <> back.id)"""


ASKED = "SELECT id FROM nodes WHERE type = 'context' OR file = 'nation'"
FIRST_PART = "'api:GET /part/' || (SELECT min(p_partkey) FROM part)"


def _asked(graph: Graph) -> DataFrame:
    """Every context and every nation's component."""
    return graph.nodes.where("type = 'context' OR file = 'nation'").select("id")


def _first_part(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "part").agg(F.concat(F.lit("api:GET /part/"), F.min("p_partkey").cast("string"))).first()[0]


_compiled: dict[tuple, Graph] = {}
_lines: dict[tuple, DataFrame] = {}


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    """The joined lines as a written table, once a session and folder: all graphs of the folder share them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _lines:
        with partitioned(spark, [f"{sf}/lineitem.parquet", f"{sf}/orders.parquet"]):
            _lines[key] = Scratch(spark, "lines").save(joined_lines(spark, sf))
    return _lines[key]


def _saved(spark: SparkSession, sf: str, **options) -> Graph:
    """The graph as written tables, once a session, folder and options: its many readers share them, and only what is read is made."""
    key = (spark.sparkContext.applicationId, sf, *sorted(options.items()))
    if key not in _compiled:
        _compiled[key] = TableGraph(spark, sf, lambda: _joined(spark, sf), whole=(lambda: _saved(spark, sf)) if options else None, **options)
    return _compiled[key]


def query(sql: str | None = None, prefix: str = GRAPH):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = prefix + sql if prefix else sql
        return f

    return register


# ---- construction -----------------------------------------------------------------------------------------------


@query(" SELECT type, count(*) AS n FROM nodes GROUP BY type")
def nodes_by_type(spark, sf):
    return _saved(spark, sf).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, sf):
    return _saved(spark, sf).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT " + ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in NODE_TYPES) + ", count(*) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE dst LIKE 'api:GET /:%') AS n_low_confidence FROM nodes")
def index_counts(spark, sf):
    return merge.counts(_saved(spark, sf))


@query(" SELECT type, CASE type WHEN 'route' THEN 'entry-point' WHEN 'api' THEN 'http-boundary' WHEN 'hook' THEN 'business-logic' WHEN 'context' THEN 'state' END AS role, count(*) AS n FROM nodes GROUP BY ALL")
def normalized_roles(spark, sf):
    return merge.normalize_roles(_saved(spark, sf).nodes).groupBy("type", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT src, kind, dst, CAST(arg_min(l_linenumber, ord) AS INT) AS line FROM (SELECT 'customer#' || o_custkey AS src, 'calls' AS kind, 'api:GET /part/' || l_partkey AS dst, l_linenumber, {'o': l_orderkey, 'l': l_linenumber, 's': l_suppkey, 'p': l_extendedprice} AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY src, kind, dst",
    prefix="",
)
def edge_dedup_first_wins(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.concat(F.lit("customer#"), F.col("o_custkey").cast("string")).alias("src"), F.lit("calls").alias("kind"), F.concat(F.lit("api:GET /part/"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"))
    return merge.dedup_edges(rows).select("src", "kind", "dst", "line")


@query(
    """WITH RECURSIVE r AS (SELECT 'api:' || p_type || '/' || p_brand AS id, p_name AS name, p_size > 25 AS declared, CASE WHEN p_partkey % 3 = 0 THEN 'part/' || p_partkey END AS file, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS k FROM part),
f(id, k, name, declared, file) AS (SELECT id, k, name, declared, file FROM r WHERE k = 1 UNION ALL SELECT f.id, r.k, CASE WHEN w THEN coalesce(r.name, f.name) ELSE f.name END, CASE WHEN w THEN coalesce(r.declared, f.declared) ELSE f.declared END, CASE WHEN w THEN coalesce(r.file, f.file) ELSE f.file END
  FROM f JOIN r ON r.id = f.id AND r.k = f.k + 1, LATERAL (SELECT (coalesce(r.declared, false) AND NOT coalesce(f.declared, false)) OR (r.file IS NOT NULL AND f.file IS NULL) AS w))
SELECT id, name, declared, file FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""",
    prefix="",
)
def node_merge_declared_wins(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lit("api:"), "p_type", F.lit("/"), "p_brand").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("declared"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("file"))
    return merge.merge_nodes(rows)


@query(" SELECT id, CASE WHEN id LIKE 'route:%' THEN 'route' ELSE 'api' END AS type, regexp_replace(id, '^(route|api):', '') AS name FROM (SELECT DISTINCT dst AS id FROM edges WHERE dst LIKE 'api:%') WHERE id NOT IN (SELECT id FROM nodes WHERE declared)")
def repair_dangling_endpoints(spark, sf):
    graph = _saved(spark, sf)
    return merge.repair(Graph(graph.nodes.where((F.col("type") != "api") | F.col("declared")), graph.edges))


@query(""" SELECT 'repeated_id' AS rule, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'repeated_edge', (SELECT count(*) FROM edges WHERE kind = 'handles') UNION ALL SELECT 'unknown_type', (SELECT count(*) FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'unknown_role', (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') UNION ALL SELECT 'unknown_kind', (SELECT count(*) FROM edges WHERE kind = 'defines') UNION ALL SELECT 'confidence', (SELECT count(*) FROM edges WHERE kind = 'invokes') UNION ALL SELECT 'dangling', (SELECT count(*) FROM nation)""")
def graph_invariants(spark, sf):
    """Each rule over a graph that is damaged in a way for each rule; the sound one is asserted in tests."""
    graph = _saved(spark, sf)
    customer = F.col("file") == "customer"
    poor = table(spark, sf, "customer").select(F.concat(F.lit("customer#"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") < 0).alias("poor"), (F.col("c_mktsegment") == "MACHINERY").alias("machines"))
    nodes = graph.nodes.where(F.col("type") != "native").join(poor, "id", "left").withColumns({"type": F.when(customer & F.col("poor"), "person").otherwise(F.col("type")), "role": F.when(customer & F.col("machines"), "boss")}).drop("poor", "machines")
    nodes = nodes.unionByName(nodes.where(F.col("id").startswith("api:GET /part/")))
    edges = graph.edges.withColumns({"kind": F.when(F.col("kind") == "defines", "owns").otherwise(F.col("kind")), "confidence": F.when(F.col("kind") == "invokes", 1.5).otherwise(F.col("confidence"))})
    return violations(Graph(nodes, edges.unionByName(edges.where("kind = 'handles'"))))


# ---- lookup -----------------------------------------------------------------------------------------------------


@query(" SELECT dst, kind FROM edges WHERE src = 'nation#NATION_1'")
def out_edges(spark, sf):
    return lookup.out_edges(_saved(spark, sf), "nation#NATION_1").select("dst", "kind")


@query(" SELECT src, kind FROM edges WHERE dst = 'nation#NATION_1'")
def in_edges(spark, sf):
    return lookup.in_edges(_saved(spark, sf), "nation#NATION_1").select("src", "kind")


@query(" SELECT dst AS id FROM edges WHERE src = 'nation#NATION_1' UNION SELECT src FROM edges WHERE dst = 'nation#NATION_1'")
def neighbours(spark, sf):
    return lookup.neighbours(_saved(spark, sf), "nation#NATION_1")


@query(" SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def node_panel_counts(spark, sf):
    return lookup.panel(_saved(spark, sf))


@query(" SELECT id, name FROM nodes WHERE type = 'route'")
def all_routes(spark, sf):
    return lookup.routes(_saved(spark, sf)).select("id", "name")


@query(""" , s AS (SELECT id, type, CASE WHEN lower(name) = '7' OR lower(id) = '7' THEN 100 WHEN lower(id) LIKE '%#7' THEN 80 WHEN lower(id) LIKE '%/7' THEN 60 END AS score FROM nodes)
SELECT id, CAST(score * 10 - CASE type WHEN 'component' THEN 0 WHEN 'route' THEN 1 WHEN 'hook' THEN 2 WHEN 'context' THEN 3 WHEN 'api' THEN 4 WHEN 'file' THEN 5 ELSE 9 END AS INT) AS rank FROM s WHERE score IS NOT NULL""")
def resolve_target(spark, sf):
    return lookup.resolve(_saved(spark, sf), "7").select("id", F.col("rank").cast("int").alias("rank"))


_SCORE = "CASE WHEN lower(name) = '{q}' OR lower(id) = '{q}' THEN 100 WHEN starts_with(lower(name), '{q}') THEN 80 WHEN contains(lower(name), '{q}') THEN 60 WHEN contains(lower(id), '{q}') THEN 40 ELSE 0 END"


@query(f" SELECT id, type, name, {_SCORE.format(q='brand#1')} AS score FROM nodes WHERE {_SCORE.format(q='brand#1')} > 0 ORDER BY score DESC, id LIMIT 20")
def search_ranked(spark, sf):
    return lookup.search(_saved(spark, sf), "Brand#1 ")


@query(""" , w AS (SELECT id FROM nodes WHERE type = 'component' AND file = 'nation'), r AS (SELECT src AS id, 0 AS side, kind, dst AS other FROM edges WHERE src IN (SELECT id FROM w) UNION ALL SELECT dst, 1, kind, src FROM edges WHERE dst IN (SELECT id FROM w)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, kind, other) AS place FROM r)
SELECT k.id, CAST(place AS INT) AS place, CASE side WHEN 0 THEN kind || ' → ' || coalesce(n.name, other) ELSE '← ' || kind || ' by ' || coalesce(n.name, other) END AS relation FROM k LEFT JOIN nodes n ON n.id = other WHERE place <= 6""")
def search_relations(spark, sf):
    graph = _saved(spark, sf)
    return lookup.relations(graph, graph.nodes.where("file = 'nation'"))


_UI = [("brand#1 nation", 2), ("brand", 1), ("nation", 1)]


@query(
    " , h AS ("
    + " UNION ALL ".join(f"(SELECT id, type, {w} * {_SCORE.format(q=q)} AS s FROM nodes WHERE {_SCORE.format(q=q)} > 0 ORDER BY s DESC, id LIMIT 10)" for q, w in _UI)
    + ") SELECT id, sum(s)::BIGINT AS score FROM h WHERE type <> 'file' GROUP BY id HAVING sum(s) >= 60 ORDER BY score DESC, id LIMIT 5"
)
def ui_match_scores(spark, sf):
    found = labels.match_labels(_saved(spark, sf), spark.createDataFrame([("Brand#1 Nation",)], "label string"))
    return found.select("id", "score")


@query(" SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def degree_all(spark, sf):
    return analytics.degree(_saved(spark, sf))


@query(" , k AS (SELECT id FROM nodes WHERE type IN ('route', 'component', 'api')), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
def degree_filtered(spark, sf):
    return analytics.degree(lookup.filtered(_saved(spark, sf), ["route", "component", "api"]))


# ---- findings ---------------------------------------------------------------------------------------------------


@query(" SELECT id, type FROM nodes WHERE type = 'component' AND id NOT IN (SELECT dst FROM edges WHERE kind IN ('renders', 'routes_to')) UNION ALL SELECT id, type FROM nodes WHERE type = 'hook' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'uses') UNION ALL SELECT id, type FROM nodes WHERE type = 'component' AND loc >= 150 AND id NOT IN (SELECT src FROM edges WHERE kind = 'calls')")
def dead_components(spark, sf):
    """Components that nothing renders, and large ones that call nothing, by the same anti joins."""
    graph = _saved(spark, sf)
    quiet = graph.nodes.where("type = 'component' AND loc >= 150").join(graph.of_kinds("calls").select(F.col("src").alias("id")), "id", "left_anti")
    return analytics.dead_code(graph).unionByName(quiet.select("id", "type"))


_UNUSED = """, idle AS (SELECT id, list_filter(string_split(name, '/'), lambda x: x <> '') AS a FROM nodes WHERE type = 'api' AND declared AND id NOT IN (SELECT dst FROM edges WHERE kind = 'calls')),
called AS (SELECT DISTINCT list_filter(string_split(string_split(name, ' ')[-1], '/'), lambda x: x <> '') AS b FROM nodes WHERE type = 'api' AND id IN (SELECT dst FROM edges WHERE kind = 'calls')),
unused AS (SELECT id FROM idle WHERE NOT EXISTS (SELECT 1 FROM called WHERE len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR a[i][1] = ':' OR b[i][1] = ':')) = len(a)))"""


@query(_UNUSED + " SELECT id FROM unused")
def unused_apis(spark, sf):
    return analytics.unused_apis(_saved(spark, sf))


@query(" SELECT count(*) AS n_called, count(*) FILTER (WHERE declared) AS n_declared FROM nodes WHERE type = 'api' AND id IN (SELECT dst FROM edges WHERE kind = 'calls')")
def called_apis(spark, sf):
    return analytics.called_apis(_saved(spark, sf)).agg(F.count(F.lit(1)).alias("n_called"), F.count_if("declared").alias("n_declared"))


@query(" SELECT id FROM nodes WHERE type = 'context' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'uses') UNION ALL SELECT id FROM nodes WHERE type = 'file' AND id NOT IN (SELECT src FROM edges WHERE kind = 'imports')")
def orphan_nodes(spark, sf):
    graph = _saved(spark, sf)
    contexts = graph.nodes.where("type = 'context'").join(graph.of_kinds("uses").select(F.col("dst").alias("id")), "id", "left_anti")
    files = graph.nodes.where("type = 'file'").join(graph.of_kinds("imports").select(F.col("src").alias("id")), "id", "left_anti")
    return contexts.select("id").unionByName(files.select("id"))


@query(" SELECT id, loc FROM nodes WHERE loc >= 150")
def large_nodes(spark, sf):
    return analytics.large_nodes(_saved(spark, sf))


@query(" SELECT name, count(*) AS n FROM (SELECT name FROM nodes WHERE type = 'component' UNION ALL SELECT p_name FROM part) GROUP BY name HAVING count(*) > 1")
def duplicate_names(spark, sf):
    graph = _saved(spark, sf)
    parts = table(spark, sf, "part").select(F.lit("component").alias("type"), F.col("p_name").alias("name"), F.lit("part").alias("file"))
    return analytics.duplicate_names(Graph(graph.nodes.select("type", "name", "file").unionByName(parts), graph.edges))


@query(" SELECT shape, count(*) AS n, count(DISTINCT name) AS n_names FROM nodes WHERE type = 'component' AND shape <> '' GROUP BY shape HAVING count(*) > 1 AND count(DISTINCT name) > 1")
def structural_duplicates(spark, sf):
    return analytics.structural_duplicates(_saved(spark, sf))


@query(
    """, top AS (SELECT dst AS id, count(*) AS renderers FROM edges WHERE kind IN ('renders', 'routes_to') AND dst IN (SELECT id FROM nodes WHERE type = 'component') GROUP BY dst ORDER BY renderers DESC, id LIMIT 8)"""
    + _dependents("SELECT id FROM top").removeprefix(",").join([",", ""])
    + " SELECT top.id, renderers, (SELECT count(*) FROM deps WHERE root = top.id AND type = 'route') AS routes, repeat('★', CAST(least(5, 1 + floor(renderers / 3)) AS INT)) AS stars FROM top"
)
def usage_heatmap(spark, sf):
    return analytics.heatmap(_saved(spark, sf))


@query(" SELECT dst AS id, count(*) AS consumers, count(*) >= 15 AS warning FROM edges WHERE kind = 'uses' AND dst IN (SELECT id FROM nodes WHERE type = 'context') GROUP BY dst ORDER BY consumers DESC, id LIMIT 6")
def state_fanout(spark, sf):
    return analytics.state_fanout(_saved(spark, sf))


# ---- traversal --------------------------------------------------------------------------------------------------


@query(REACH + " SELECT route, id FROM subtree")
def route_reach(spark, sf):
    return traverse.route_subtrees(_saved(spark, sf))


@query(REACH + " SELECT DISTINCT route, e.dst AS api FROM subtree JOIN edges e ON e.src = id AND kind = 'calls'")
def route_api_calls(spark, sf):
    return analytics.route_apis(_saved(spark, sf))


_LINKS = ", links AS (SELECT DISTINCT o.route AS src, e.dst FROM (SELECT route, id FROM subtree UNION SELECT id, id FROM nodes WHERE type = 'route') o JOIN edges e ON e.src = o.id AND e.kind = 'navigates_to' WHERE o.route <> e.dst AND e.dst IN (SELECT id FROM nodes WHERE type = 'route'))"


@query(REACH + _LINKS + " SELECT src, dst FROM links")
def route_nav_links(spark, sf):
    return analytics.route_links(_saved(spark, sf))


_RISK = "CASE WHEN {r} >= 3 OR {d} >= 20 THEN 'High' WHEN {r} >= 1 OR {d} >= 6 THEN 'Medium' ELSE 'Low' END"


@query(
    REACH
    + _LINKS
    + """, a AS (SELECT route, count(DISTINCT e.dst) AS n FROM subtree JOIN edges e ON e.src = id AND kind = 'calls' GROUP BY route), l AS (SELECT dst AS route, count(*) AS n FROM links GROUP BY dst),
p AS (SELECT route, count(*) AS n_nodes, count(*) FILTER (WHERE type = 'component') AS n_components FROM subtree JOIN nodes USING (id) GROUP BY route)
SELECT p.route, n_nodes, n_components, coalesce(a.n, 0) AS n_apis, coalesce(l.n, 0) AS n_links, """
    + _RISK.format(r="coalesce(l.n, 0)", d="(coalesce(l.n, 0) + coalesce(a.n, 0))")
    + " AS risk FROM p LEFT JOIN a USING (route) LEFT JOIN l USING (route)"
)
def route_risk(spark, sf):
    return analytics.route_risk(_saved(spark, sf))


@query(_dependents(ASKED) + " SELECT root, id, type FROM deps")
def dependents_of(spark, sf):
    graph = _saved(spark, sf)
    return traverse.dependents(graph, _asked(graph)).select("root", "id", "type")


@query(_dependents(ASKED) + " SELECT root, type, count(*) AS n FROM deps GROUP BY ALL")
def impact_by_type(spark, sf):
    graph = _saved(spark, sf)
    return analytics.dependents_by_type(graph, _asked(graph))


@query(
    _dependents(ASKED)
    + """, p AS (SELECT goal.id AS root, count(deps.id) AS n_dependents, count(deps.id) FILTER (WHERE type = 'route') AS n_routes, count(deps.id) FILTER (WHERE type = 'component') AS n_components, count(deps.id) FILTER (WHERE type = 'file') AS n_files FROM goal LEFT JOIN deps ON root = goal.id GROUP BY goal.id),
t AS (SELECT root, id FROM deps UNION SELECT id, id FROM goal), u AS (SELECT root, count(DISTINCT e.dst) FILTER (WHERE kind = 'calls') AS n_apis, count(DISTINCT e.dst) FILTER (WHERE kind = 'uses' AND e.dst IN (SELECT id FROM nodes WHERE type = 'context')) AS n_contexts, count(DISTINCT e.dst) FILTER (WHERE kind = 'invokes') AS n_channels FROM t JOIN edges e ON e.src = t.id GROUP BY root)
SELECT p.*, coalesce(n_apis, 0) AS n_apis, coalesce(n_contexts, 0) AS n_contexts, coalesce(n_channels, 0) AS n_channels, """
    + _RISK.format(r="n_routes", d="n_dependents")
    + " AS risk, CASE WHEN n_dependents > 15 OR n_routes >= 3 THEN 'L' WHEN n_dependents >= 5 THEN 'M' ELSE 'S' END AS complexity FROM p LEFT JOIN u USING (root)"
)
def impact_risk(spark, sf):
    graph = _saved(spark, sf)
    return analytics.impact(graph, _asked(graph))


_RENDER = ", below(root, id, d) AS (SELECT id, id, 0 FROM nodes WHERE type = 'component' AND file = 'nation' UNION SELECT root, e.dst, d + 1 FROM below JOIN edges e ON e.src = below.id AND e.kind = 'renders' WHERE d < {depth})"


@query(_RENDER.format(depth=10) + " SELECT root, id, CAST(min(d) AS INT) AS depth FROM below WHERE root <> id GROUP BY ALL")
def render_subtree(spark, sf):
    graph = _saved(spark, sf)
    return traverse.render_subtree(graph, graph.nodes.where("file = 'nation'"))


@query(_RENDER.format(depth=3) + " SELECT d AS level, count(*) AS n FROM below WHERE d > 0 GROUP BY d")
def composition_levels(spark, sf):
    graph = _saved(spark, sf)
    return traverse.render_subtree(graph, graph.nodes.where("file = 'nation'"), traverse.COMPOSITION_DEPTH).groupBy(F.col("depth").alias("level")).agg(F.count(F.lit(1)).alias("n"))


_FLOW = f""", flows AS (SELECT src, dst, kind FROM edges WHERE kind IN ('navigates_to', 'routes_to', 'renders', 'calls')), flow(id, hop) AS (SELECT 'route:/asia', 0 UNION SELECT e.dst, hop + 1 FROM flow JOIN flows e ON e.src = flow.id WHERE hop < 12 AND NOT EXISTS (SELECT 1 FROM flow f WHERE f.id = {FIRST_PART})),
level AS (SELECT id, min(hop) AS hop FROM flow GROUP BY id)"""


@query(_FLOW + f" SELECT CAST(hop AS INT) AS hops FROM level WHERE id = {FIRST_PART}")
def shortest_flow_length(spark, sf):
    return traverse.shortest_path(_saved(spark, sf), "route:/asia", _first_part(spark, sf)).agg(F.max("hop").alias("hops"))


@query(
    _FLOW
    + f""", tail(id, hop) AS (SELECT id, hop FROM level WHERE id = {FIRST_PART} UNION SELECT l.id, l.hop FROM tail JOIN flows e ON e.dst = tail.id JOIN level l ON l.id = e.src AND l.hop = tail.hop - 1),
way(id, hop, k, ids) AS (SELECT 'route:/asia', 0, CAST([] AS VARCHAR[]), ['route:/asia'] UNION ALL SELECT e.dst, way.hop + 1, list_concat(k, [e.kind, e.dst]), list_append(ids, e.dst) FROM way JOIN flows e ON e.src = way.id JOIN tail t ON t.id = e.dst AND t.hop = way.hop + 1),
best AS (SELECT ids FROM way WHERE id = {FIRST_PART} ORDER BY k LIMIT 1) SELECT CAST(generate_subscripts(ids, 1) - 1 AS INT) AS hop, unnest(ids) AS id FROM best"""
)
def shortest_flow_path(spark, sf):
    return traverse.shortest_path(_saved(spark, sf), "route:/asia", _first_part(spark, sf))


@query(
    REACH
    + """, links AS (SELECT DISTINCT o.route AS src, e.dst FROM (SELECT route, id FROM subtree UNION SELECT id, id FROM nodes WHERE type = 'route') o JOIN edges e ON e.src = o.id AND e.kind = 'navigates_to' WHERE o.route <> e.dst AND e.dst IN (SELECT id FROM nodes WHERE type = 'route')),
go(id, k) AS (SELECT 'route:/asia', 0 UNION SELECT l.dst, k + 1 FROM go JOIN links l ON l.src = go.id WHERE k < 4), seen AS (SELECT id, min(k) AS k FROM go GROUP BY id)
SELECT CAST(a.k AS INT) AS round, (SELECT min(l.src) FROM links l JOIN seen b ON b.id = l.src AND b.k = a.k - 1 WHERE l.dst = a.id) AS src, a.id AS dst FROM seen a WHERE a.k > 0 ORDER BY round, src, dst LIMIT 22"""
)
def journey_tree(spark, sf):
    return traverse.journeys(analytics.route_links(_saved(spark, sf)), "route:/asia")


@query(" SELECT id, CASE WHEN i AND NOT h THEN 'dangling' ELSE 'orphan' END AS gap FROM (SELECT id, id IN (SELECT dst FROM edges WHERE kind = 'invokes') AS i, id IN (SELECT dst FROM edges WHERE kind = 'handles') AS h FROM nodes WHERE type = 'channel') WHERE i <> h")
def channel_gaps(spark, sf):
    return analytics.channel_gaps(_saved(spark, sf))


_CYCLES = """, se AS (SELECT src AS s, dst AS t FROM edges WHERE kind = 'imports'), r(s, t) AS (SELECT s, t FROM se UNION SELECT r.s, se.t FROM r JOIN se ON r.t = se.s),
m AS (SELECT a.s AS member, least(a.s, min(a.t)) AS cycle FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY a.s)"""


@query(_CYCLES + " SELECT cycle, member FROM m WHERE cycle IN (SELECT cycle FROM m GROUP BY cycle HAVING count(*) > 1)")
def import_cycles(spark, sf):
    return traverse.cycles(_saved(spark, sf))


@query(
    _CYCLES
    + _UNUSED
    + """, f AS (SELECT (SELECT count(*) FROM (SELECT cycle FROM m GROUP BY cycle HAVING count(*) > 1)) AS cycles, (SELECT count(*) FROM nodes WHERE type = 'component' AND id NOT IN (SELECT dst FROM edges WHERE kind IN ('renders', 'routes_to'))) + (SELECT count(*) FROM nodes WHERE type = 'hook' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'uses')) AS dead,
(SELECT count(*) FROM nodes WHERE loc >= 150) AS large, (SELECT count(*) FROM unused) AS unused_apis, (SELECT count(*) FROM (SELECT name FROM nodes WHERE type = 'component' GROUP BY name HAVING count(*) > 1)) AS duplicate_names,
(SELECT count(*) FROM (SELECT shape FROM nodes WHERE type = 'component' AND shape <> '' GROUP BY shape HAVING count(*) > 1 AND count(DISTINCT name) > 1)) AS duplicate_shapes, (SELECT count(*) FROM nodes WHERE type = 'channel' AND id IN (SELECT dst FROM edges WHERE kind = 'invokes') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'handles')) AS dangling_channels, (SELECT count(*) FROM nodes WHERE type = 'channel' AND id IN (SELECT dst FROM edges WHERE kind = 'handles') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'invokes')) AS orphan_handlers),
g AS (SELECT *, greatest(0, 100 - least(24, 8 * cycles) - least(16, 2 * dead) - least(15, 3 * large) - least(10, 2 * unused_apis) - least(10, 2 * duplicate_names) - least(10, 2 * duplicate_shapes) - least(12, 4 * dangling_channels) - least(6, 2 * orphan_handlers)) AS score FROM f)
SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'needs attention' END AS grade FROM g"""
)
def architecture_score(spark, sf):
    return analytics.architecture_score(_saved(spark, sf))


# ---- what if ----------------------------------------------------------------------------------------------------


@query(
    _dependents(ASKED)
    + """, dir AS (SELECT g.id AS root, n.file FROM goal g JOIN edges e ON e.dst = g.id JOIN nodes n ON n.id = e.src WHERE n.type <> 'file'),
fl AS (SELECT root, file FROM dir UNION SELECT g.id, n.file FROM goal g JOIN nodes n ON n.id = g.id),
p AS (SELECT g.id AS root, (SELECT count(*) FROM dir WHERE dir.root = g.id) AS n_direct, (SELECT count(DISTINCT file) FROM fl WHERE fl.root = g.id AND file <> '') AS n_files, (SELECT count(*) FROM deps WHERE deps.root = g.id) AS n_dependents,
(SELECT count(*) FROM deps WHERE deps.root = g.id AND type = 'component') AS n_components, (SELECT count(DISTINCT name) FROM deps WHERE deps.root = g.id AND type = 'route') AS n_routes FROM goal g)
SELECT *, (SELECT count(*) FROM nodes WHERE type = 'route') - n_routes AS n_safe_routes, """
    + _RISK.format(r="n_routes", d="n_dependents")
    + " AS risk FROM p"
)
def what_if_remove(spark, sf):
    graph = _saved(spark, sf)
    return analytics.what_if_remove(graph, _asked(graph))


@query(""" , o AS (SELECT src AS id, count(*) FILTER (WHERE kind = 'renders') AS children, count(*) FILTER (WHERE kind = 'uses') AS state, count(*) FILTER (WHERE kind = 'calls') AS apis FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS call_sites FROM edges WHERE kind IN ('renders', 'routes_to') GROUP BY dst)
SELECT n.id, loc, coalesce(children, 0) AS children, coalesce(state, 0) AS state, coalesce(apis, 0) AS apis, coalesce(call_sites, 0) AS call_sites, coalesce(loc, 0) >= 150 OR coalesce(children, 0) >= 5 AS worth FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE type = 'component'""")
def what_if_split(spark, sf):
    graph = _saved(spark, sf)
    return analytics.what_if_split(graph, graph.nodes.where("type = 'component'"))


@query(
    REACH
    + """, t AS (SELECT id, loc, id IN (SELECT id FROM subtree WHERE route <> 'route:/asia') AS shared FROM subtree JOIN nodes USING (id) WHERE route = 'route:/asia' AND type = 'component')
SELECT count(*) FILTER (WHERE NOT shared) AS exclusive, CAST(coalesce(sum(loc) FILTER (WHERE NOT shared), 0) AS BIGINT) AS exclusive_loc, count(*) FILTER (WHERE shared) AS shared, (SELECT count(*) FROM edges WHERE kind = 'navigates_to' AND dst = 'route:/asia') AS entries,
count(*) FILTER (WHERE NOT shared) >= 3 OR coalesce(sum(loc) FILTER (WHERE NOT shared), 0) > 200 AS worthwhile FROM t"""
)
def what_if_lazy_load(spark, sf):
    return analytics.what_if_lazy_load(_saved(spark, sf), "route:/asia")


@query(
    _dependents("SELECT id FROM nodes WHERE type IN ('context', 'hook')")
    + """ SELECT g.id, (SELECT count(*) FROM edges WHERE kind = 'uses' AND dst = g.id) AS consumers, (SELECT count(DISTINCT name) FROM deps WHERE root = g.id AND type = 'route') AS routes,
CASE WHEN (SELECT count(*) FROM edges WHERE kind = 'uses' AND dst = g.id) <= 1 THEN 'local' WHEN (SELECT count(DISTINCT name) FROM deps WHERE root = g.id AND type = 'route') <= 1 THEN 'lift' ELSE 'context' END AS placement FROM goal g"""
)
def state_placement(spark, sf):
    return analytics.state_placement(_saved(spark, sf))


@query(""" , i AS (SELECT dst AS id, count(*) FILTER (WHERE kind IN ('renders', 'routes_to')) AS r, count(*) AS n FROM edges GROUP BY dst), c AS (SELECT src AS id, count(*) AS a FROM edges WHERE kind = 'calls' GROUP BY src), j AS (SELECT nodes.id, type, loc, coalesce(r, 0) AS r, coalesce(n, 0) AS n, coalesce(a, 0) AS a FROM nodes LEFT JOIN i USING (id) LEFT JOIN c USING (id))
SELECT id, 'split' AS advice FROM j WHERE loc >= 150 UNION ALL SELECT id, 'blast-radius' FROM j WHERE r >= 5 UNION ALL SELECT id, 'dead' FROM j WHERE type = 'component' AND r = 0 AND n <= 1 UNION ALL SELECT id, 'consolidate' FROM j WHERE a >= 3""")
def recommendations(spark, sf):
    return analytics.recommendations(_saved(spark, sf))


@query(_RENDER.format(depth=3) + ", one AS (SELECT DISTINCT root, e.src, e.kind, e.dst FROM below JOIN edges e ON e.src = below.id AND e.kind IN ('uses', 'calls')) SELECT * FROM one UNION SELECT root, e.src, e.kind, e.dst FROM one JOIN nodes n ON n.id = one.dst AND n.type = 'hook' AND one.kind = 'uses' JOIN edges e ON e.src = n.id AND e.kind IN ('uses', 'calls')")
def data_flow(spark, sf):
    graph = _saved(spark, sf)
    return analytics.data_flow(graph, graph.nodes.where("file = 'nation'"))


@query(
    REACH
    + """, s AS (SELECT id AS root, route, row_number() OVER (PARTITION BY id ORDER BY route) AS k FROM subtree WHERE id LIKE 'nation#%'), c AS (SELECT dst AS route, src AS caller, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges WHERE kind = 'navigates_to')
SELECT root, s.route, caller FROM s JOIN c ON c.route = s.route AND c.k <= 5 WHERE s.k <= 3"""
)
def navigation_in(spark, sf):
    graph = _saved(spark, sf)
    return analytics.navigation_in(graph, graph.nodes.where("file = 'nation'"))


@query(
    ", cl AS (SELECT dst AS api, src AS caller, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM edges WHERE kind = 'calls')"
    + _dependents("SELECT DISTINCT caller AS id FROM cl WHERE k <= 8")
    + ", rt AS (SELECT root, id AS route, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM deps WHERE type = 'route') SELECT api, caller, route FROM cl JOIN rt ON rt.root = caller AND rt.k <= 3 WHERE cl.k <= 8"
)
def api_flow(spark, sf):
    return analytics.api_flow(_saved(spark, sf))


# ---- snapshots --------------------------------------------------------------------------------------------------


def _pair(spark: SparkSession, sf: str) -> tuple[Graph, Graph]:
    return _saved(spark, sf, until=CUT, called_only=True), _saved(spark, sf, called_only=True)


@query(" SELECT 'added' AS change, type, id FROM nodes_b WHERE id NOT IN (SELECT id FROM nodes_a) UNION ALL SELECT 'removed', type, id FROM nodes_a WHERE id NOT IN (SELECT id FROM nodes_b)", SNAPSHOTS)
def graph_diff_nodes(spark, sf):
    return temporal.node_changes(*_pair(spark, sf))


@query(" , n AS (SELECT (SELECT count(*) FROM nodes_b) AS nb, (SELECT count(*) FROM nodes_a) AS na, (SELECT count(*) FROM edges_b) AS eb, (SELECT count(*) FROM edges_a) AS ea) SELECT nb AS n_nodes, '+' || (nb - na) AS node_delta, eb AS n_edges, '+' || (eb - ea) AS edge_delta FROM n", SNAPSHOTS)
def graph_diff_totals(spark, sf):
    return temporal.totals(*_pair(spark, sf))


@query(
    """ , da AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges_a UNION ALL SELECT dst FROM edges_a) GROUP BY id), db AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges_b UNION ALL SELECT dst FROM edges_b) GROUP BY id)
SELECT n.id, coalesce(db.d, 0) - coalesce(da.d, 0) AS delta FROM nodes_b n LEFT JOIN da ON da.id = n.id LEFT JOIN db ON db.id = n.id WHERE type = 'component' AND n.id IN (SELECT id FROM nodes_a) AND coalesce(db.d, 0) <> coalesce(da.d, 0) ORDER BY abs(delta) DESC, n.id LIMIT 8""",
    SNAPSHOTS,
)
def graph_diff_movers(spark, sf):
    return temporal.movers(*_pair(spark, sf))


@query(
    """WITH n AS (SELECT DISTINCT strftime(o_orderdate, '%Y') AS s, 'api:/part/' || l_partkey AS id, '/part/' || l_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT s, lag(s) OVER (ORDER BY s) AS p, lead(s) OVER (ORDER BY s) AS f FROM (SELECT DISTINCT s FROM n)),
x AS (SELECT n.s, 'added' AS change, id, name FROM n JOIN s USING (s) WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.s = p AND m.id = n.id) UNION ALL SELECT f, 'removed', id, name FROM n JOIN s USING (s) WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.s = f AND m.id = n.id)),
k AS (SELECT *, row_number() OVER (PARTITION BY s, change ORDER BY id) AS k FROM x)
SELECT s AS snapshot_id, change, 'api' AS type, count(*) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 4) AS names, greatest(0, count(*) - 4) AS more FROM k GROUP BY s, change""",
    prefix="",
)
def graph_timeline(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("/part/"), F.col("l_partkey").cast("string"))
    nodes = rows.select(F.date_format("o_orderdate", "yyyy").alias("snapshot_id"), F.concat(F.lit("api:"), name).alias("id"), F.lit("api").alias("type"), name.alias("name")).distinct()
    nodes = Scratch(spark, "timeline").save(nodes)
    return temporal.timeline(nodes, nodes.select("snapshot_id").distinct())


_FILES = "SELECT 'customer/' || o_custkey AS path, count(*)::VARCHAR AS hash FROM orders WHERE o_orderdate < TIMESTAMP '{day}' GROUP BY o_custkey"
_DAYS = ("1997-06-01", "1997-07-01")


def _files(spark: SparkSession, sf: str, day: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp"))
    return rows.groupBy(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path")).agg(F.count(F.lit(1)).cast("string").alias("hash"))


@query(f"WITH a AS ({_FILES.format(day=_DAYS[0])}), b AS ({_FILES.format(day=_DAYS[1])}) SELECT a.path, CASE WHEN b.hash IS NULL THEN 'gone' ELSE 'changed' END AS why FROM a LEFT JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash", prefix="")
def stale_files(spark, sf):
    return temporal.stale_files(*(_files(spark, sf, d) for d in _DAYS))


@query(
    f"""WITH a AS ({_FILES.format(day=_DAYS[0])}), b AS ({_FILES.format(day=_DAYS[1])}), i AS (SELECT DISTINCT 'customer/' || c_custkey AS src, 'customer/' || (c_custkey // 2) AS dst FROM customer), m AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'deleted' ELSE 'changed' END AS why FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash),
d AS (SELECT path, why FROM m WHERE why <> 'deleted' UNION ALL SELECT DISTINCT src, 'importer' FROM i JOIN m ON m.path = i.dst AND m.why <> 'new' WHERE src NOT IN (SELECT path FROM m) AND src IN (SELECT path FROM b))
SELECT path, why, (SELECT count(*) FROM d) <= 0.4 * (SELECT count(*) FROM b) AS incremental FROM d""",
    prefix="",
)
def dirty_files(spark, sf):
    imports = table(spark, sf, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("customer/"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("dst")).distinct()
    return temporal.dirty_files(*(_files(spark, sf, d) for d in _DAYS), imports)


# ---- features ---------------------------------------------------------------------------------------------------


_FEATURE = ", f AS (SELECT coalesce(nullif(split_part(name, '/', 2), ''), 'root') AS feature, id AS route FROM nodes WHERE type = 'route'), mem AS (SELECT feature, route AS id FROM f UNION SELECT feature, subtree.id FROM subtree JOIN f USING (route))"


@query(REACH + _FEATURE + " SELECT feature, count(*) AS n_members, count(*) FILTER (WHERE k > 1) AS n_shared FROM mem JOIN (SELECT id, count(*) AS k FROM mem GROUP BY id) USING (id) GROUP BY feature")
def feature_members(spark, sf):
    graph = _saved(spark, sf)
    return features.feature_list(graph, features.derive_features(graph))


@query(REACH + _FEATURE + " SELECT m.feature, e.src, e.kind, e.dst FROM mem m JOIN edges e ON e.dst = m.id WHERE NOT EXISTS (SELECT 1 FROM mem x WHERE x.feature = m.feature AND x.id = e.src)")
def feature_entry_points(spark, sf):
    graph = _saved(spark, sf)
    return features.entry_points(graph, features.derive_features(graph))


# ---- ledgers and text -------------------------------------------------------------------------------------------


_USAGE = "WITH u AS (SELECT ts AS t, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'impact' WHEN 'purchase' THEN 'trace' WHEN 'signup' THEN 'map' ELSE 'index_project' END AS tool, CAST(ceil(value / 4) AS BIGINT) AS out, CAST(600 * CASE event_type WHEN 'click' THEN 8 WHEN 'view' THEN 25 WHEN 'purchase' THEN 42 WHEN 'signup' THEN 30 ELSE 0 END AS BIGINT) AS base, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ms FROM events) "


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "impact").when(F.col("event_type") == "purchase", "trace").when(F.col("event_type") == "signup", "map").otherwise("index_project")
    return table(spark, sf, "events").select(F.col("ts").alias("t"), tool.alias("tool"), F.ceil(F.col("value") / 4).cast("long").alias("out"), ledger.baseline(tool).cast("long").alias("base"), F.get_json_object("props", "$.k").cast("long").alias("ms"))


@query(_USAGE + "SELECT tool, count(*) AS n, sum(out)::BIGINT AS out, sum(base)::BIGINT AS base, (sum(base) - sum(out))::BIGINT AS saved FROM u GROUP BY tool", prefix="")
def savings_by_tool(spark, sf):
    return ledger.savings_by_tool(_usage(spark, sf))


@query(
    _USAGE
    + "SELECT count(*) FILTER (WHERE tool <> 'index_project') AS queries, sum(out)::BIGINT AS out, sum(base)::BIGINT AS base, greatest(0, floor((sum(base) - sum(out)) / 600 + 0.5))::BIGINT AS files_avoided, floor((sum(base) - sum(out)) / sum(base) * 100 + 0.5)::BIGINT AS reduction, list_sort(list(ms))[CAST(floor(count(ms) / 2) AS INT) + 1] AS median_ms FROM u",
    prefix="",
)
def savings_summary(spark, sf):
    return ledger.savings_summary(_usage(spark, sf))


@query(_USAGE + "SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS at, tool, out, base, ms FROM (SELECT * FROM u ORDER BY t DESC, tool DESC, out DESC, base DESC, ms DESC LIMIT 1000)", prefix="")
def ledger_retention(spark, sf):
    return ledger.retained(_usage(spark, sf)).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("at"), "tool", "out", "base", "ms")


@query("SELECT doc_id, CAST(ceil((length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)", prefix="")
def doc_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ledger.text_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("SELECT doc_id, CASE WHEN i > 0 THEN floor(greatest(0.0, (i - n) / i * 100) * 100 + 0.5) / 100 ELSE 0.0 END AS percent FROM (SELECT doc_id, 258 * ceil(n_chars / 768)::BIGINT AS i, ceil(n_chars / 4)::BIGINT AS n FROM documents)", prefix="")
def doc_savings_percent(spark, sf):
    image = (F.ceil(F.col("n_chars") / 768) * ledger.TILE_TOKENS).cast("long")
    return table(spark, sf, "documents").select("doc_id", ledger.savings_percent(image, F.ceil(F.col("n_chars") / 4).cast("long")).cast("double").alias("percent"))


@query("SELECT s_suppkey, CASE WHEN w <= 384 AND h <= 384 THEN 258 ELSE ceil(w / 768)::BIGINT * ceil(h / 768)::BIGINT * 258 END AS tokens FROM (SELECT s_suppkey, 1 + s_suppkey * 37 % 3000 AS w, 1 + s_suppkey * 61 % 2000 AS h FROM supplier)", prefix="")
def image_token_estimate(spark, sf):
    w, h = 1 + F.col("s_suppkey") * 37 % 3000, 1 + F.col("s_suppkey") * 61 % 2000
    return table(spark, sf, "supplier").select("s_suppkey", ledger.image_tokens(w, h).alias("tokens"))


# ---- pages ------------------------------------------------------------------------------------------------------


_PATH = "CASE WHEN starts_with({u}, '/') THEN regexp_extract({u}, '^([^?#]*)', 1) WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN coalesce(nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') END"


def _route_sql(u: str) -> str:
    path = _PATH.format(u=u)
    return f"CASE WHEN {path} IS NULL THEN NULL ELSE coalesce(nullif(regexp_replace(regexp_replace({path}, '[?#].*$', ''), '/+$', ''), ''), '/') END"


@query(f"SELECT page_id, {_route_sql('url')} AS route FROM pages", prefix="")
def page_routes(spark, sf):
    return page_source.page_routes(table(spark, sf, "pages"))


_TAGS = "WITH t AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)) AS tags FROM pages), s AS (SELECT page_id, CAST(len(tags) AS INT) AS n_elements, CASE WHEN len(tags) >= 4 THEN substr(sha1(array_to_string(tags, '>')), 1, 12) END AS shape FROM t) "


@query(_TAGS + "SELECT page_id, n_elements, shape FROM s", prefix="")
def page_shapes(spark, sf):
    return page_source.page_shapes(table(spark, sf, "pages"))


@query(_TAGS + "SELECT shape, count(*) AS n FROM s WHERE shape IS NOT NULL GROUP BY shape HAVING count(*) > 1", prefix="")
def page_shape_groups(spark, sf):
    return page_source.page_shapes(table(spark, sf, "pages")).where(F.col("shape").isNotNull()).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


@query(
    f"""WITH h AS (SELECT {_route_sql('url')} AS src, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS href FROM pages), e AS (SELECT src, {_route_sql('href')} AS dst FROM h) SELECT src, dst, count(*) AS n FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL""",
    prefix="",
)
def page_nav_edges(spark, sf):
    return page_source.page_links(table(spark, sf, "pages"))


_SHAPES = "WITH t AS (SELECT DISTINCT '/' || (c_custkey % 40) || '/' || CASE WHEN c_custkey % 7 = 0 THEN ':id' ELSE c_mktsegment END AS target FROM customer), r AS (SELECT DISTINCT '/' || (p_partkey % 50) || '/' || CASE WHEN p_partkey % 50 < 20 THEN ':x' ELSE p_type END AS route FROM part) "


@query(
    _SHAPES
    + """, m AS (SELECT target, route FROM t JOIN r ON (split_part(target, '/', 2) = split_part(route, '/', 2)) AND (split_part(target, '/', 3) = split_part(route, '/', 3) OR split_part(target, '/', 3)[1] = ':' OR split_part(route, '/', 3)[1] = ':') WHERE target NOT IN (SELECT route FROM r)),
o AS (SELECT target, min(route) AS route FROM m GROUP BY target HAVING count(*) = 1)
SELECT t.target, CASE WHEN t.target IN (SELECT route FROM r) THEN t.target ELSE coalesce(o.route, t.target) END AS route, CAST(CASE WHEN t.target IN (SELECT route FROM r) THEN 1.0 WHEN o.route IS NOT NULL THEN 0.8 END AS DOUBLE) AS confidence FROM t LEFT JOIN o USING (target)""",
    prefix="",
)
def path_shape_matches(spark, sf):
    targets = table(spark, sf, "customer").select(F.concat(F.lit("/"), (F.col("c_custkey") % 40).cast("string"), F.lit("/"), F.when(F.col("c_custkey") % 7 == 0, ":id").otherwise(F.col("c_mktsegment"))).alias("target"))
    routes = table(spark, sf, "part").select(F.concat(F.lit("/"), (F.col("p_partkey") % 50).cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 50 < 20, ":x").otherwise(F.col("p_type"))).alias("route"))
    return page_source.canonical_routes(targets, routes)


@query("SELECT page_id, 'n_' || regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS node FROM pages", prefix="")
def mermaid_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.mermaid_id(F.col("url")).alias("node"))
