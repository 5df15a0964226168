"""A provider over raw web pages: their routes, shapes and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import normalize_route, same_shape, segments, to_pathname

#: Elements that a shape needs, hex digits that it keeps.
LEAST_ELEMENTS, SHAPE_DIGITS = 4, 12


def page_shapes(pages: DataFrame) -> DataFrame:
    """page_id, n_elements and shape: a fingerprint of the page's opening tags in order; null for fewer than four. [PRV-14]"""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    rows = pages.select("page_id", F.transform(tags, lambda t: F.lower(t)).alias("tags"))
    shape = F.when(F.size("tags") >= LEAST_ELEMENTS, F.substring(F.sha1(F.array_join("tags", ">")), 1, SHAPE_DIGITS))
    return rows.select("page_id", F.size("tags").alias("n_elements"), shape.alias("shape"))


def page_routes(pages: DataFrame) -> DataFrame:
    """page_id and route of each page's URL. [PRV-04, PRV-18]"""
    return pages.select("page_id", normalize_route(to_pathname(F.col("url"))).alias("route"))


def page_links(pages: DataFrame) -> DataFrame:
    """src (the page's route), dst (the link's) and n links, within the site: hrefs that are paths. [PRV-25]"""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    rows = pages.select(normalize_route(to_pathname(F.col("url"))).alias("src"), F.explode(hrefs).alias("href"))
    rows = rows.select("src", normalize_route(to_pathname(F.col("href"))).alias("dst"))
    return rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def canonical_routes(targets: DataFrame, routes: DataFrame) -> DataFrame:
    """target, route and confidence: the equal route, else the only one of its shape (0.8), else the target itself. [PRV-20]

    Routes meet targets of as many segments whose literal first segment agrees, so that no two tables are crossed.
    """
    t = targets.select("target").distinct().withColumn("a", segments(F.col("target"))).withColumn("exact", F.col("target"))
    r = routes.select("route").distinct().withColumn("b", segments(F.col("route")))
    agree = same_shape(F.col("a"), F.col("b"))
    same = t.join(r.select(F.col("route").alias("exact"), F.lit(True).alias("hit")), "exact", "left")
    key = lambda s: F.when(F.size(s) == 0, "").when(F.get(s, F.lit(0)).startswith(":"), "*").otherwise(F.get(s, F.lit(0)))
    miss = same.where(F.col("hit").isNull()).withColumn("n", F.size("a"))
    miss = miss.withColumn("k", F.explode(F.array_distinct(F.array(key(F.col("a")), F.lit("*")))))
    wide = r.withColumn("n", F.size("b")).withColumn("k", key(F.col("b")))
    starred = same.where(F.col("hit").isNull() & F.get("a", F.lit(0)).startswith(":")).withColumn("n", F.size("a")).select("target", "a", "n")
    near = miss.join(wide, ["n", "k"]).where(agree).select("target", "route").unionByName(starred.join(wide, "n").where(agree).select("target", "route")).distinct()
    only = near.groupBy("target").agg(F.count(F.lit(1)).alias("c"), F.min("route").alias("route")).where(F.col("c") == 1).select("target", F.col("route").alias("fuzzy"))
    rows = same.select("target", "hit").join(only, "target", "left")
    return rows.select("target", F.when(F.col("hit"), F.col("target")).otherwise(F.coalesce("fuzzy", "target")).alias("route"), F.when(F.col("hit"), 1.0).when(F.col("fuzzy").isNotNull(), 0.8).alias("confidence"))
