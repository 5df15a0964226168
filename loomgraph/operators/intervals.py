"""Joins of positions with the ranges that hold them, as equi-joins of binary blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks: a range may be up to 2 ** LEVELS - 1 long.
LEVELS = 44


def cover(start: Column, end: Column) -> Column:
    """The blocks (level, block) of 2 ** level positions that together hold start to end - 1, each once: at most two of a level.

    From the start blocks grow as far as they begin at a multiple of their size, then shrink to the end. Empty for end <= start.
    """

    def step(state: Column, level: Column, only_odd: bool) -> Column:
        at, size = state["at"], F.call_function("shiftleft", F.lit(1).cast("long"), level)
        block = F.call_function("shiftright", at, level)
        fits = at + size <= end
        taken = fits & ((F.call_function("bit_get", at, level) == 1) if only_odd else F.lit(True))
        more = F.concat(state["blocks"], F.array(F.struct(level.alias("level"), block.alias("block"))))
        return F.struct(F.when(taken, at + size).otherwise(at).alias("at"), F.when(taken, more).otherwise(state["blocks"]).alias("blocks"))

    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<level:int,block:bigint>>").alias("blocks"))
    up = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero, lambda s, level: step(s, level, True))
    return F.aggregate(F.sequence(F.lit(LEVELS - 1), F.lit(0), F.lit(-1)), up, lambda s, level: step(s, level, False))["blocks"]


def within(points: DataFrame, ranges: DataFrame, keys: list[str], position: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Each point beside each range of its keys that holds it: start <= position < end. [JON-11]

    Points have the keys and a position, ranges the keys, start and end (whole numbers); the other columns of both are kept and must
    have different names. A range is cut into blocks of sizes of powers of two, of which a point is in one at most; the two meet
    by equal keys, level and block. So nested, adjacent and long ranges cost no more than their blocks, and no two tables are
    crossed. Null keys, positions and ends meet nothing; a range whose end isn't behind its start holds nothing.
    """
    blocks = ranges.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(cover(F.col(start), F.col(end)))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    # a point asks at the levels that ranges have, LEVELS of them at most
    levels = blocks.agg(F.sort_array(F.collect_set("_level")).alias("_levels"))
    asked = points.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")  # one row
    asked = asked.withColumn("_block", F.call_function("shiftright", F.col(position).cast("long"), F.col("_level")))
    return asked.join(blocks, [*keys, "_level", "_block"]).drop("_level", "_block")


def enclosing(points: DataFrame, ranges: DataFrame, keys: list[str], point: list[str], name: str, position: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Per point (keys, the columns of `point`, position): n ranges that hold it, the first declared of them (outer) and the innermost (inner), by `name`.

    Outer is the one that starts first, of those the longest; inner the one that starts last, of those the shortest; then by name. A point
    behind the end of a range isn't in it, however near its start is. Points in no range have 0 and nulls. [PRV-24]
    """
    met = within(points, ranges.select(*keys, start, end, name), keys, position, start, end)
    group = [*keys, *point, position]
    first = F.min_by(name, F.struct(F.col(start), -F.col(end), F.col(name))).alias("outer")
    last = F.min_by(name, F.struct(-F.col(start), F.col(end), F.col(name))).alias("inner")
    found = met.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), first, last)
    return points.select(*group).join(found, group, "left").select(*group, F.coalesce("n", F.lit(0)).alias("n"), "outer", "inner")
