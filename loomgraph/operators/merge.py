"""What providers' outputs go through: node merge, first-wins edges, repair of missing ends, roles, order and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import NODE_TYPES, Graph

#: The role that a type has unless a provider said otherwise.
ROLE_OF = {"route": "entry-point", "api": "http-boundary", "controller": "http-boundary", "service": "business-logic", "hook": "business-logic", "module": "composition-root", "entity": "data-model", "context": "state"}


def merge_nodes(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row an id, folded in order: a later one only replaces what it has, and only if it is declared or has a file where the kept one is not or has none. [PRV-02, WIN-02, JON-13, SCL-13]"""
    fields = [c for c in rows.columns if c not in ("id", order)]
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("all"))
    first = F.element_at("all", 1)

    def fold(kept, new):
        wins = (F.coalesce(new["declared"], F.lit(False)) & ~F.coalesce(kept["declared"], F.lit(False))) | (new["file"].isNotNull() & kept["file"].isNull())
        return F.when(wins, F.struct(kept[order].alias(order), *[F.coalesce(new[f], kept[f]).alias(f) for f in fields])).otherwise(kept)

    merged = listed.select("id", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), first, fold).alias("n"))
    return merged.select("id", *[F.col(f"n.{f}").alias(f) for f in fields])


def dedup_edges(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The first edge of each (src, kind, dst). [PRV-03, WIN-01]"""
    first = Window.partitionBy("src", "kind", "dst").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def repair(graph: Graph) -> DataFrame:
    """id, type and name of routes and apis that edges name and no node has. [PRV-06]"""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    named = ends.where(F.col("id").startswith("route:") | F.col("id").startswith("api:")).join(graph.nodes.select("id"), "id", "left_anti")
    return named.select("id", F.when(F.col("id").startswith("route:"), "route").otherwise("api").alias("type"), F.regexp_replace("id", "^(route|api):", "").alias("name"))


def normalize_roles(nodes: DataFrame) -> DataFrame:
    """Adds the role of the type where there is none. [PRV-07]"""
    role = F.lit(None).cast("string")
    for kind, value in ROLE_OF.items():
        role = F.when(F.col("type") == kind, value).otherwise(role)
    return nodes.withColumn("role", F.coalesce("role", role) if "role" in nodes.columns else role)


def counts(graph: Graph) -> DataFrame:
    """One row: nodes of each type, edges and edges of low confidence. [PRV-09, AGG-34]"""
    by_type = graph.nodes.agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in NODE_TYPES], F.count(F.lit(1)).alias("n_nodes"))
    low = F.count_if(F.col("confidence") < 1) if "confidence" in graph.edges.columns else F.lit(0).cast("long")
    return by_type.join(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"), low.alias("n_low_confidence")))
