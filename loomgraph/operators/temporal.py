"""Snapshots compared: added and removed nodes, coupling, timelines, stale files and moved branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.analytics import degree
from loomgraph.schema import Graph

#: Movers and names shown.
MOVERS, NAMES_SHOWN = 8, 4
#: Types that a timeline names.
TIMELINE_TYPES = ("route", "component", "context", "hook", "api", "controller", "service", "module", "entity")


def node_changes(before: Graph, after: Graph) -> DataFrame:
    """change, type and id of nodes in only one of two graphs. [SET-02, JON-07]"""
    a, b = before.nodes.select("id", "type"), after.nodes.select("id", "type")
    added = b.join(a.select("id"), "id", "left_anti").select(F.lit("added").alias("change"), "type", "id")
    return added.unionByName(a.join(b.select("id"), "id", "left_anti").select(F.lit("removed").alias("change"), "type", "id"))


def signed(n):
    """[SCL-09]"""
    return F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"))


def totals(before: Graph, after: Graph) -> DataFrame:
    """One row: nodes and edges of the later graph and their signed differences. [SET-03]"""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(after.nodes, "n_nodes").join(n(after.edges, "n_edges")).join(n(before.nodes, "b_nodes")).join(n(before.edges, "b_edges"))
    return row.select("n_nodes", signed(F.col("n_nodes") - F.col("b_nodes")).alias("node_delta"), "n_edges", signed(F.col("n_edges") - F.col("b_edges")).alias("edge_delta"))


def movers(before: Graph, after: Graph, limit: int = MOVERS) -> DataFrame:
    """Components in both graphs whose degree moved most. [SET-03, JON-08, SRT-03]"""
    both = after.nodes.where(F.col("type") == "component").select("id").join(before.nodes.select("id"), "id", "left_semi")
    rows = both.join(degree(after).withColumnRenamed("degree", "a"), "id", "left").join(degree(before).withColumnRenamed("degree", "b"), "id", "left")
    rows = rows.select("id", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta")).where(F.col("delta") != 0)
    return rows.orderBy(F.desc(F.abs("delta")), "id").limit(limit)


def timeline(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snapshot_id, change, type, n, names and more: what each snapshot added to and removed from the one before. [SET-04, WIN-03, WIN-04, SCL-15]

    nodes: snapshot_id, id, type, name. snapshots: snapshot_id. Up to four names are shown; `more` counts the others.
    """
    order = Window.orderBy("snapshot_id")  # a row a snapshot
    steps = snapshots.select("snapshot_id", F.lag("snapshot_id").over(order).alias("previous"), F.lead("snapshot_id").over(order).alias("following"))
    here = nodes.join(steps, "snapshot_id").where(F.col("type").isin(*TIMELINE_TYPES))
    had = nodes.select(F.col("snapshot_id").alias("previous"), "id")
    added = here.where(F.col("previous").isNotNull()).join(had, ["previous", "id"], "left_anti").select("snapshot_id", F.lit("added").alias("change"), "type", "id", "name")
    has = nodes.select(F.col("snapshot_id").alias("following"), "id")
    removed = here.where(F.col("following").isNotNull()).join(has, ["following", "id"], "left_anti").select(F.col("following").alias("snapshot_id"), F.lit("removed").alias("change"), "type", "id", "name")
    rows = added.unionByName(removed).withColumn("k", F.row_number().over(Window.partitionBy("snapshot_id", "change", "type").orderBy("id")))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= NAMES_SHOWN, F.struct("k", "name")))), lambda x: x["name"]), ", ")
    return rows.groupBy("snapshot_id", "change", "type").agg(F.count(F.lit(1)).alias("n"), names.alias("names")).withColumn("more", F.greatest(F.lit(0), F.col("n") - NAMES_SHOWN))


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and why of stored files that changed or are gone; new files are not seen. [SET-07]"""
    rows = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "left")
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("new").isNull(), "gone").otherwise("changed").alias("why"))


def dirty_files(stored: DataFrame, current: DataFrame, imports: DataFrame, share: float = 0.4) -> DataFrame:
    """path, why and incremental: files to read again. [PRV-10, STM-05]

    New and changed files, and those that import a changed or deleted one (imports: src, dst); incremental says whether
    they are no more than `share` of all current files.
    """
    both = stored.select("path", F.col("hash").alias("old")).join(current.select("path", F.col("hash").alias("new")), "path", "full_outer")
    moved = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").otherwise("changed").alias("why"))
    importers = imports.join(moved.where(F.col("why") != "new").select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path")).distinct()
    importers = importers.join(moved.select("path"), "path", "left_anti").join(current.select("path"), "path", "left_semi").withColumn("why", F.lit("importer"))
    dirty = moved.where(F.col("why") != "deleted").unionByName(importers)
    n = dirty.agg(F.count(F.lit(1)).alias("n_dirty")).join(current.agg(F.count(F.lit(1)).alias("n_all")))
    return dirty.join(F.broadcast(n)).select("path", "why", (F.col("n_dirty") <= share * F.col("n_all")).alias("incremental"))


def carried_over(edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """Edges whose owner file, the part of src before '#', is not read again. [PRV-11, PRV-12]"""
    return edges.withColumn("owner", F.element_at(F.split("src", "#"), 1)).join(dirty.select(F.col("path").alias("owner")), "owner", "left_anti").drop("owner")


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """reason: of one-row tables branch, head, main_head, the first that moved; null if none did or it isn't known. [SET-08]"""
    a, b = stored.alias("a"), current.alias("b")
    moved = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull() & (F.col(f"a.{c}") != F.col(f"b.{c}"))
    return a.join(b).select(F.when(moved("branch"), "branch").when(moved("head"), "head").when(moved("main_head"), "main").alias("reason"))
