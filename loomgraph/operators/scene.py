"""Interface trees as tables: style facets, layout by levels, frame comparison and fidelity scores.

A tree has a row a node: tree, id, parent (null for the root), ord, depth. Whole levels are measured and placed at
once, over all trees, so a round is a join and there are as many rounds as levels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.scratch import Scratch, ship

#: Style classes and the facet that each sets; pixels of a step; facets that are compared.
CLASS_FACETS = {
    "flex-col": ("dir", "col"), "flex-row": ("dir", "row"), "justify-between": ("justify", "space-between"), "justify-end": ("justify", "end"), "justify-center": ("justify", "center"), "items-center": ("align", "center"),
    "text-xs": ("size", "xs"), "text-sm": ("size", "sm"), "text-base": ("size", "base"), "text-lg": ("size", "lg"), "text-xl": ("size", "xl"), "text-2xl": ("size", "2xl"), "text-3xl": ("size", "3xl"),
    "font-medium": ("weight", "500"), "font-semibold": ("weight", "600"), "text-muted-foreground": ("color", "muted-foreground"), "text-destructive": ("color", "destructive"),
    "rounded-lg": ("radius", "8"), "rounded-md": ("radius", "6"), "rounded": ("radius", "4"), "border": ("border", "1"),
}
STEP = 4
LAYOUT, STYLE = ("dir", "gap", "pad", "justify", "align"), ("size", "weight", "color", "radius", "border")
CHAR_WIDTH, LINE_HEIGHT = {"2xl": 12.0, "base": 8.0, "sm": 6.4, "xs": 5.6}, {"2xl": 32, "base": 24, "sm": 20, "xs": 16}


def class_facets(classes: DataFrame) -> DataFrame:
    """id, facet and value of a table of id and classes (a string of them): of one facet the last class wins. [FLT-14, FLT-15, RND-18]"""
    rows = classes.select("id", F.posexplode(F.split(F.trim("classes"), r"\s+")).alias("at", "c")).where("c <> ''")
    known = F.create_map(*[F.lit(x) for c, (f, v) in CLASS_FACETS.items() for x in (c, f"{f}={v}")])
    steps = F.floor(F.regexp_extract("c", r"-(\d+(?:\.\d+)?)$", 1).try_cast("double") * STEP + 0.5).cast("string")
    gap, pad = F.concat(F.lit("gap="), steps), F.concat(F.lit("pad="), steps)
    number = r"-\d+(?:\.\d+)?$"
    pairs = (
        F.when(F.col("c") == "flex", F.array(F.lit("dir?=row")))
        .when(F.col("c").rlike("^gap" + number) | F.col("c").rlike("^space-x" + number), F.array(gap))
        .when(F.col("c").rlike("^space-y" + number), F.array(F.lit("dir=col"), gap))
        .when(F.col("c").rlike(r"^p-\d+$"), F.array(pad))
        .when(F.col("c").rlike(r"^p[xy]-\d+$"), F.array(F.replace(pad, F.lit("="), F.lit("?="))))
        .otherwise(F.array(known[F.col("c")]))
    )
    each = rows.select("id", "at", F.explode(pairs).alias("p")).where("p IS NOT NULL")
    each = each.select("id", "at", F.regexp_replace(F.element_at(F.split("p", "="), 1), r"\?", "").alias("facet"), F.element_at(F.split("p", "="), 2).alias("value"), F.col("p").contains("?=").alias("weak"))
    # a weak value holds only where no other class sets the facet
    order = F.struct(~F.col("weak"), F.when(F.col("weak"), -F.col("at")).otherwise(F.col("at")))
    return each.groupBy("id", "facet").agg(F.max_by("value", order).alias("value"))


def class_coverage(tokens: DataFrame, top: int = 22) -> DataFrame:
    """app, class and n of the class tokens (app, c) that no facet knows, the most frequent ones of each app. [AGG-26]"""
    known = F.col("c").isin(*CLASS_FACETS, "flex") | F.col("c").rlike(r"^(?:gap|space-[xy]|p|px|py)-\d+(?:\.\d+)?$")
    rows = tokens.where(~known).groupBy("app", "c").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("n"), "c"))).where(F.col("k") <= top).drop("k")


def text_size(text: Column, size: Column, available: Column) -> tuple[Column, Column]:
    """Width and height of wrapped text. [RND-09]"""
    wide, high = F.lit(6.4), F.lit(20)
    for k in CHAR_WIDTH:
        wide, high = F.when(size == k, CHAR_WIDTH[k]).otherwise(wide), F.when(size == k, LINE_HEIGHT[k]).otherwise(high)
    full = F.length(text) * wide
    return F.least(full, available), F.greatest(F.lit(1), F.ceil(full / F.greatest(available, F.lit(1)))) * high


def layout(nodes: DataFrame, width: float) -> DataFrame:
    """tree, id, x, y, w and h of every node. [RND-09, RND-10]

    nodes: tree, id, parent, ord, depth, dir (row or col), pad, gap, leaf_w and leaf_h (null for boxes). A box is as wide as
    its parent's inside; its height is the sum of its children's heights and gaps, or in a row their largest, and its padding.
    """
    scratch = Scratch(nodes.sparkSession, "layout")
    levels = int(nodes.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0])
    base = scratch.save(nodes.withColumns({"pad": F.coalesce("pad", F.lit(0)), "gap": F.coalesce("gap", F.lit(0)), "dir": F.coalesce("dir", F.lit("col"))}))
    parent = base.select("tree", F.col("id").alias("parent"), F.col("pad").alias("p_pad"), F.col("dir").alias("p_dir"), F.col("gap").alias("p_gap"))
    # widths from the root down
    wide = scratch.save(base.where("depth = 0").select("*", F.lit(float(width)).alias("w"), F.lit(float(width)).alias("room")))
    done = wide
    for d in range(1, levels + 1):
        above = wide.select("tree", F.col("id").alias("parent"), (F.col("room") - 2 * F.col("pad")).alias("room"))
        wide = scratch.save(base.where(F.col("depth") == d).join(above, ["tree", "parent"]).withColumn("w", F.when(F.col("leaf_w").isNotNull(), F.least(F.col("leaf_w"), F.col("room"))).otherwise(F.col("room"))).select(*base.columns, "w", "room"))
        done = done.unionByName(wide)
    done = scratch.save(done)
    # heights from the leaves up
    below = None
    heights = None
    for d in range(levels, -1, -1):
        level = done.where(F.col("depth") == d)
        if below is not None:
            sums = below.groupBy("tree", F.col("parent").alias("id")).agg(F.sum("h").alias("s"), F.max("h").alias("m"), F.count(F.lit(1)).alias("k"))
            level = level.join(sums, ["tree", "id"], "left")
        else:
            level = level.withColumns({"s": F.lit(0.0), "m": F.lit(0.0), "k": F.lit(0)})
        inner = F.when(F.col("dir") == "row", F.coalesce("m", F.lit(0.0))).otherwise(F.coalesce("s", F.lit(0.0)) + F.col("gap") * F.greatest(F.lit(0), F.coalesce("k", F.lit(0)) - 1))
        below = scratch.save(level.withColumn("h", F.coalesce(F.col("leaf_h").cast("double"), inner + 2 * F.col("pad"))).select(*done.columns, "h"))
        heights = below if heights is None else heights.unionByName(below)
    if heights is None:
        return nodes.sparkSession.createDataFrame([], "tree string, id string, x double, y double, w double, h double")
    # offsets within the parent by running sums, then down the levels
    before = Window.partitionBy("tree", "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = heights.join(parent, ["tree", "parent"], "left").withColumn("n_before", F.row_number().over(Window.partitionBy("tree", "parent").orderBy("ord")) - 1)
    gaps = F.col("n_before") * F.col("p_gap")
    is_row = F.col("p_dir") == "row"
    placed = placed.withColumns({"dx": F.col("p_pad") + F.when(is_row, F.coalesce(F.sum("w").over(before), F.lit(0.0)) + gaps).otherwise(0), "dy": F.col("p_pad") + F.when(is_row, 0).otherwise(F.coalesce(F.sum("h").over(before), F.lit(0.0)) + gaps)})
    tall = heights.select("tree", F.col("id").alias("parent"), (F.col("h") - 2 * F.col("pad")).alias("inside"))
    placed = placed.join(tall, ["tree", "parent"], "left").withColumn("dy", F.when(is_row, F.col("dy") + (F.col("inside") - F.col("h")) / 2).otherwise(F.col("dy")))
    placed = scratch.save(placed.select("tree", "id", "parent", "depth", "w", "h", "dx", "dy"))
    at = scratch.save(placed.where("depth = 0").select("tree", "id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "w", "h"))
    out = at
    for d in range(1, levels + 1):
        above = at.select("tree", F.col("id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
        at = scratch.save(placed.where(F.col("depth") == d).join(above, ["tree", "parent"]).select("tree", "id", (F.col("px") + F.col("dx")).alias("x"), (F.col("py") + F.col("dy")).alias("y"), "w", "h"))
        out = out.unionByName(at)
    return out


def frame_changes(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("text", "enabled")) -> DataFrame:
    """id and change of the later frame's nodes: added, changed or same; removed ones are not reported. [JON-14]"""
    old = before.select("id", F.struct(*columns).alias("old"))
    rows = after.select("id", F.struct(*columns).alias("new")).join(old, "id", "left")
    return rows.select("id", F.when(F.col("old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same").alias("change"))


def impact_ratio(changes: DataFrame) -> DataFrame:
    """One row: changed, total and their ratio. [AGG-31]"""
    return changes.agg(F.count_if(F.col("change") != "same").alias("changed"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.col("changed") / F.greatest(F.col("total"), F.lit(1)))


def drifted(golden: DataFrame, frame: DataFrame) -> DataFrame:
    """Rows in only one of two frames, with which one. [RND-17]"""
    return golden.exceptAll(frame).withColumn("only_in", F.lit("golden")).unionByName(frame.exceptAll(golden).withColumn("only_in", F.lit("frame")))


def facet_scores(pairs: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """kf and score of aligned pairs (kf, a and b as maps): equal facets among those that either side has; 1 if there are none. [AGG-27, AGG-28]"""
    each = pairs.select("kf", F.explode(F.array(*[F.struct(F.element_at("a", F.lit(f)).alias("x"), F.element_at("b", F.lit(f)).alias("y")) for f in facets])).alias("p"))
    rows = each.groupBy("kf").agg(F.count_if(F.col("p.x").isNotNull() | F.col("p.y").isNotNull()).alias("n"), F.count_if(F.col("p.x") == F.col("p.y")).alias("eq"))
    return rows.select("kf", F.when(F.col("n") > 0, F.col("eq") / F.col("n")).otherwise(1.0).alias("score"))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    right = np.array([codes[x] for x in b], np.int64)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (right == codes[x]))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def alignment_scores(ours: DataFrame, real: DataFrame) -> DataFrame:
    """kf and score, twice the common subsequence over both lengths, of two sequences (kf, ord, sig). [JON-15, RND-16, AGG-29]

    A frame's sequence has as many rows as an interface has nodes; frames are spread over tasks.
    """

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (list(t.sort_values("ord")["sig"]) for t in (a, b))
        kf = (a if len(a) else b)["kf"].iloc[0]
        return pd.DataFrame({"kf": [kf], "score": [2 * _common(x, y) / (len(x) + len(y))]})

    ship(ours.sparkSession)
    columns, kind = ["kf", "ord", "sig"], ours.schema["kf"].dataType.simpleString()
    return ours.select(columns).groupBy("kf").cogroup(real.select(columns).groupBy("kf")).applyInPandas(score, f"kf {kind}, score double")


def dependency_graph(bindings: DataFrame, tracked: DataFrame) -> DataFrame:
    """var and its bindings, of bindings (node, prop, deps: array) that depend on tracked variables (var). [AGG-30]"""
    each = bindings.select("node", "prop", F.explode("deps").alias("var")).join(tracked, "var", "left_semi")
    return each.groupBy("var").agg(F.sort_array(F.collect_set(F.concat_ws(".", "node", "prop"))).alias("bindings"))


def extraction_coverage(results: DataFrame, top: int = 12) -> DataFrame:
    """kind, label and n of extraction results (status, reasons: array): each status, then the most frequent reasons. [AGG-25]"""
    by_status = results.groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "label", "n")
    reasons = results.select(F.explode("reasons").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)
    return by_status.unionByName(reasons.select(F.lit("reason").alias("kind"), "label", "n"))
