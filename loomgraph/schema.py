"""The graph's tables, closed vocabularies and invariants."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id string, type string, name string, file string, role string, framework string, is_default_export boolean, shape string, loc int, declared boolean"
EDGES = "src string, dst string, kind string, source struct<file:string,line:int>, confidence double, reason string"
FILES = "snapshot_id string, path string, hash string"
SNAPSHOTS = "snapshot_id string, version int, root string, indexed_at timestamp, commit string, providers array<string>, content_key string"
USAGE = "t timestamp, tool string, out long, base long, ms long"

#: Vocabularies of the graph document, version 2.
VERSION = 2
NODE_TYPES = ("file", "component", "route", "api", "hook", "context", "controller", "service", "module", "entity", "channel", "native")
ROLES = ("entry-point", "http-boundary", "business-logic", "composition-root", "data-model", "state")
EDGE_KINDS = ("imports", "defines", "renders", "routes_to", "navigates_to", "uses", "calls", "injects", "contains", "invokes", "handles")


@dataclass(frozen=True)
class Graph:
    """nodes: at least id, type, name; edges: at least src, dst, kind. written: both are tables, so reading them again is cheap."""

    nodes: DataFrame
    edges: DataFrame
    written: bool = False
    #: Types of the nodes at the start and end of each kind's edges, if a provider vouches for them.
    ends: ClassVar[dict[str, tuple[set[str], set[str]]] | None] = None

    def of_kinds(self, *kinds: str) -> DataFrame:
        """The edges of some kinds; a graph that keeps kinds apart reads no others."""
        return self.edges.where(F.col("kind").isin(*kinds))


def complete(df: DataFrame, ddl: str) -> DataFrame:
    """The DDL's columns in its order; those that are missing are null."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def violations(graph: Graph) -> DataFrame:
    """rule and n: repeated ids, repeated edges, unknown types, roles and kinds, confidences outside (0, 1], structural edges to nothing."""
    nodes, edges = complete(graph.nodes, NODES), complete(graph.edges, EDGES)
    ends = edges.where(~F.col("kind").isin("navigates_to", "calls")).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    checks = {
        "repeated_id": nodes.groupBy("id").count().where("count > 1"),
        "repeated_edge": edges.groupBy("src", "kind", "dst").count().where("count > 1"),
        "unknown_type": nodes.where(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))),
        "unknown_role": nodes.where(F.col("role").isNotNull() & ~F.col("role").isin(*ROLES)),
        "unknown_kind": edges.where(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False))),
        "confidence": edges.where((F.col("confidence") <= 0) | (F.col("confidence") > 1)),
        "dangling": ends.join(nodes, "id", "left_anti"),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
