"""Registered queries of the code providers, over source files that are written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans.project import source_files
from loomgraph.plans.registry import query
from loomgraph.scratch import Scratch
from loomgraph.sources import code

_ROWS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, 'app/n' || c_nationkey || '/c' || c_custkey || '/page.tsx' AS page FROM customer),
nx AS (SELECT c.k, coalesce(d.n, c.n) AS n2, coalesce(d.k, c.k) AS k2 FROM c LEFT JOIN c d ON d.k = c.k + 1),
p AS (SELECT n_nationkey AS n, n_regionkey AS r, 'src/n' || n_nationkey || '.tsx' AS f FROM nation), r AS (SELECT DISTINCT r FROM p), g AS (SELECT DISTINCT seg, 'src/hooks/use' || seg || '.ts' AS f FROM c), s AS (SELECT s_suppkey AS k, s_nationkey AS n, r FROM supplier JOIN p ON n = s_nationkey)
"""
_FRONT_EDGES = """SELECT page AS src, 'defines' AS kind, page || '#Page' || k AS dst FROM c UNION ALL SELECT f, 'defines', f || '#Nation' || n FROM p UNION ALL SELECT f, 'defines', f || '#use' || seg FROM g UNION ALL SELECT 'src/ctx' || r || '.ts', 'defines', 'src/ctx' || r || '.ts#Region' || r FROM r
UNION ALL SELECT page, 'imports', f FROM c JOIN p USING (n) UNION ALL SELECT page, 'imports', f FROM c JOIN g USING (seg) UNION ALL SELECT f, 'imports', 'src/ctx' || r || '.ts' FROM p
UNION ALL SELECT 'route:/n' || n || '/c' || k, 'routes_to', page || '#Page' || k FROM c UNION ALL SELECT page || '#Page' || k, 'renders', f || '#Nation' || n FROM c JOIN p USING (n)
UNION ALL SELECT page || '#Page' || k, 'uses', f || '#use' || seg FROM c JOIN g USING (seg) UNION ALL SELECT f || '#Nation' || n, 'uses', 'src/ctx' || r || '.ts#Region' || r FROM p
UNION ALL SELECT page || '#Page' || k, 'calls', 'api:POST /api/customers/' || k FROM c UNION ALL SELECT f || '#use' || seg, 'calls', 'api:GET /segments/' || seg FROM g
UNION ALL SELECT page || '#Page' || k, 'navigates_to', 'route:/n' || n2 || '/c' || k2 FROM c JOIN nx USING (k)"""
_NEST_EDGES = """SELECT 'api:GET /v1/s' || k || '/:id' AS src, 'routes_to' AS kind, 'server/s' || k || '.controller.ts#S' || k || 'Controller' AS dst FROM s UNION ALL SELECT 'api:POST /v1/s' || k, 'routes_to', 'server/s' || k || '.controller.ts#S' || k || 'Controller' FROM s
UNION ALL SELECT 'server/s' || k || '.controller.ts#S' || k || 'Controller', 'injects', 'server/r' || r || '.service.ts#R' || r || 'Service' FROM s UNION ALL SELECT 'server/r' || r || '.service.ts#R' || r || 'Service', 'uses', 'server/r' || r || '.service.ts#E' || r FROM r
UNION ALL SELECT 'server/r' || r || '.service.ts#R' || r || 'Module', 'contains', 'server/r' || r || '.service.ts#R' || r || 'Service' FROM r UNION ALL SELECT 'server/r' || r || '.service.ts#R' || r || 'Module', 'imports', 'server/main.ts#Root' FROM r"""
_DART_EDGES = """SELECT 'lib/s' || k || '.dart' AS src, 'defines' AS kind, 'lib/s' || k || '.dart#S' || k AS dst FROM s UNION ALL SELECT 'lib/n' || n || '.dart', 'defines', 'lib/n' || n || '.dart#N' || n FROM p UNION ALL SELECT 'lib/r' || r || '.dart', 'defines', 'lib/r' || r || '.dart#' || x FROM (SELECT r, unnest(['R' || r, 'r' || r || 'Provider']) AS x FROM r)
UNION ALL SELECT 'route:/n' || n, 'routes_to', 'lib/n' || n || '.dart#N' || n FROM p UNION ALL SELECT 'lib/s' || k || '.dart', 'imports', 'lib/n' || n || '.dart' FROM s UNION ALL SELECT 'lib/s' || k || '.dart#S' || k, 'renders', 'lib/n' || n || '.dart#N' || n FROM s
UNION ALL SELECT 'lib/s' || k || '.dart#S' || k, 'navigates_to', 'route:/n' || n FROM s UNION ALL SELECT 'lib/s' || k || '.dart#S' || k, 'calls', 'api:GET /s/' || k FROM s UNION ALL SELECT 'lib/s' || k || '.dart#S' || k, 'invokes', 'channel:app/r' || r FROM s
UNION ALL SELECT 'lib/n' || n || '.dart#N' || n, 'uses', 'lib/r' || r || '.dart#r' || r || 'Provider' FROM p"""
_NATIVE_EDGES = "SELECT 'android/R' || r || '.kt' AS src, 'handles' AS kind, 'channel:app/r' || r AS dst FROM r UNION ALL SELECT 'ios/R' || r || '.swift', 'handles', 'channel:ios/r' || r FROM r"


def _project(spark, sf):
    """The files that discovery would find, as a written table, which the providers' many joins share."""
    return Scratch(spark, "project").save(source_files(spark, sf).where(code.is_source(F.col("path"))))


def _edges(graph):
    return graph.edges.select("src", "kind", "dst").distinct()


@query(_ROWS + _FRONT_EDGES, prefix="")
def frontend_edges(spark, sf):
    """[PRV-13, PRV-15, PRV-17, PRV-19, PRV-21..PRV-29]"""
    return _edges(code.frontend(_project(spark, sf)))


@query(
    _ROWS
    + """SELECT page || '#Page' || k AS id, 'component' AS type, 'Page' || k AS name, true AS is_default_export, CAST(7 AS INT) AS loc FROM c UNION ALL SELECT f || '#Nation' || n, 'component', 'Nation' || n, false, 5 FROM p UNION ALL SELECT 'src/ctx' || r || '.ts#Region' || r, 'context', 'Region' || r, false, 2 FROM r
UNION ALL SELECT f || '#use' || seg, 'hook', 'use' || seg, false, 4 FROM g UNION ALL SELECT DISTINCT 'api:ROUTE /api/r' || r, 'api', '/api/r' || r, false, 0 FROM r""",
    prefix="",
)
def frontend_declarations(spark, sf):
    """Declared components, hooks, contexts and served endpoints with their lines. [PRV-13, PRV-16, PRV-21]"""
    nodes = code.frontend(_project(spark, sf)).nodes
    return nodes.where("type IN ('component', 'hook', 'context') OR (type = 'api' AND declared)").select("id", "type", "name", F.coalesce("is_default_export", F.lit(False)).alias("is_default_export"), F.coalesce("loc", F.lit(0)).alias("loc"))


@query(_ROWS + _NEST_EDGES, prefix="")
def nestjs_edges(spark, sf):
    """[PRV-30..PRV-34]"""
    return _edges(code.nestjs(_project(spark, sf)))


@query(_ROWS + _DART_EDGES, prefix="")
def dart_edges(spark, sf):
    """[PRV-35..PRV-40]"""
    return _edges(code.dart(_project(spark, sf)))


@query(_ROWS + "SELECT 'lib/s' || k || '.dart#S' || k AS id, CAST(9 AS INT) AS loc FROM s UNION ALL SELECT 'lib/n' || n || '.dart#N' || n, 1 FROM p", prefix="")
def dart_widgets(spark, sf):
    """Widgets with their lines, up to the next class. [PRV-36, PRV-43, PRV-44, WIN-05]"""
    return code.dart(_project(spark, sf)).nodes.where("type = 'component'").select("id", "loc")


@query(_ROWS + _NATIVE_EDGES, prefix="")
def native_edges(spark, sf):
    """[PRV-41, PRV-42]"""
    return _edges(code.native(_project(spark, sf)))


@query(_ROWS + f"SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM ({_FRONT_EDGES} UNION ALL {_NEST_EDGES} UNION ALL {_DART_EDGES} UNION ALL {_NATIVE_EDGES})) GROUP BY kind", prefix="")
def project_edges_by_kind(spark, sf):
    """All providers' outputs merged. [PRV-05, SET-01]"""
    return code.index_project(_project(spark, sf)).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    _ROWS
    + """, n AS (SELECT 'file' AS type, page AS id FROM c UNION ALL SELECT 'file', f FROM p UNION ALL SELECT 'file', f FROM g UNION ALL SELECT 'file', x FROM (SELECT unnest(['src/ctx' || r || '.ts', 'app/api/r' || r || '/route.ts', 'server/r' || r || '.service.ts', 'lib/r' || r || '.dart']) AS x FROM r) UNION ALL SELECT 'file', 'server/main.ts'
UNION ALL SELECT 'file', unnest(['server/s' || k || '.controller.ts', 'lib/s' || k || '.dart']) FROM s UNION ALL SELECT 'file', 'lib/n' || n || '.dart' FROM p UNION ALL SELECT 'component', page FROM c UNION ALL SELECT 'component', f FROM p UNION ALL SELECT 'component', 's' || k FROM s UNION ALL SELECT 'component', 'n' || n FROM p
UNION ALL SELECT 'hook', f FROM g UNION ALL SELECT 'context', 'r' || r FROM r UNION ALL SELECT 'context', x FROM (SELECT unnest(['d' || r, 'p' || r]) AS x FROM r) UNION ALL SELECT 'route', page FROM c UNION ALL SELECT 'route', '/n' || n FROM p
UNION ALL SELECT 'api', 'c' || k FROM c UNION ALL SELECT 'api', seg FROM g UNION ALL SELECT 'api', 'r' || r FROM r UNION ALL SELECT 'api', unnest(['g' || k, 'p' || k, 'd' || k]) FROM s UNION ALL SELECT 'controller', 's' || k FROM s UNION ALL SELECT 'service', 'r' || r FROM r UNION ALL SELECT 'entity', 'r' || r FROM r
UNION ALL SELECT 'module', 'r' || r FROM r UNION ALL SELECT 'module', 'root' UNION ALL SELECT 'native', unnest(['a' || r, 'i' || r]) FROM r UNION ALL SELECT 'channel', unnest(['a' || r, 'i' || r]) FROM r) SELECT type, count(*) AS n FROM n GROUP BY type""",
    prefix="",
)
def project_nodes_by_type(spark, sf):
    """[PRV-02, PRV-05, PRV-06, SET-01]"""
    return code.index_project(_project(spark, sf)).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(_ROWS + "SELECT 'frontend' AS provider, (SELECT count(*) FROM c) + (SELECT count(*) FROM p) + (SELECT count(*) FROM g) + 2 * (SELECT count(*) FROM r) + (SELECT count(*) FROM s) + (SELECT count(*) FROM r) + 1 AS n UNION ALL SELECT 'nestjs', (SELECT count(*) FROM s) + (SELECT count(*) FROM r) + 1 UNION ALL SELECT 'dart', (SELECT count(*) FROM s) + (SELECT count(*) FROM p) + (SELECT count(*) FROM r) UNION ALL SELECT 'native', 2 * (SELECT count(*) FROM r)", prefix="")
def provider_files(spark, sf):
    """Files that each provider reads: its extensions, without tests, generated files and skipped folders. [SRC-01..SRC-06]"""
    files = _project(spark, sf)
    out = None
    for name in code.ORDER:
        one = code.files_of(files, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("provider"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(_ROWS + "SELECT 'flutter' AS framework, 'shop' AS package WHERE (SELECT count(*) FROM s) > 0", prefix="")
def project_framework(spark, sf):
    """[API-24, SRC-11]"""
    files = _project(spark, sf)
    return code.framework_of(files).join(code.package_name(files))
