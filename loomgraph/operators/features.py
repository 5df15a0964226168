"""Features: groups of routes and what they own and share. Their semantics are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import traverse as walk
from loomgraph.schema import Graph


def derive_features(graph: Graph) -> DataFrame:
    """feature and route: routes by their first path segment, `root` for none. [FEA-02]"""
    first = F.get(F.filter(F.split("name", "/"), lambda s: s != ""), F.lit(0))
    return graph.nodes.where(F.col("type") == "route").select(F.coalesce(first, F.lit("root")).alias("feature"), F.col("id").alias("route"))


def load_features(spark: SparkSession, path: str, graph: Graph) -> DataFrame | None:
    """feature and route of a user's file: JSON rows with a name and routes (paths or ids); None without a file. [FEA-01]

    Routes that the graph doesn't have are left out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema("name string, routes array<string>").json(path).select(F.col("name").alias("feature"), F.explode("routes").alias("at"))
    route = F.when(F.col("at").startswith("route:"), F.col("at")).otherwise(F.concat(F.lit("route:"), "at"))
    known = graph.nodes.where(F.col("type") == "route").select(F.col("id").alias("route"))
    return rows.select("feature", route.alias("route")).distinct().join(known, "route", "left_semi")


def members(graph: Graph, features: DataFrame) -> DataFrame:
    """feature and id of the routes of a feature and all that they show. [FEA-03]"""
    tree = walk.route_subtrees(graph).join(features, "route").select("feature", "id")
    return features.select("feature", F.col("route").alias("id")).unionByName(tree).distinct()


def feature_list(graph: Graph, features: DataFrame) -> DataFrame:
    """feature, n_members and n_shared: members that another feature has too. [FEA-03]"""
    own = members(graph, features)
    shared = own.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return own.join(shared, "id").groupBy("feature").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("k") > 1).alias("n_shared"))


def entry_points(graph: Graph, features: DataFrame) -> DataFrame:
    """feature, src, kind and dst of edges into a feature from nodes outside it. [FEA-04]"""
    own = members(graph, features)
    into = graph.edges.join(own.withColumnRenamed("id", "dst"), "dst")
    return into.join(own.withColumnRenamed("id", "src"), ["feature", "src"], "left_anti").select("feature", "src", "kind", "dst")


def find_feature(features: DataFrame, name: str) -> DataFrame:
    """The feature of that name in any letter case. [FEA-05]"""
    return features.where(F.lower("feature") == name.lower())
