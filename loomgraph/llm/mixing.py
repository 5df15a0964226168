"""Mixing sources to target weights: entropy balancing by Newton iterations on the dual, rounded into copies."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, Scratch, doc_key, fresh_name, rank_within, running_sums, table

#: No document is taken more often, and no source more than so many times its size.
MOST = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Newton ends when each source's expected words are this near its target, relatively, or its dual is known to TIGHT.
NEAR, TIGHT = 1e-7, 1e-13
#: Keys of taken documents, and sources, broadcast at most; beyond, the join is shuffled.
BROADCAST_KEYS, BROADCAST_SOURCES = 1_000_000, 100_000


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, doc_key, source and size: the text's words, 0 for a null text."""
    return documents.select("doc_id", doc_key().alias("doc_key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of every source (null last), from source totals.

    All words are shared by weight; a source stops at `most` times its size and the excess is shared anew by weight
    among those below. With sources in the order of size over weight the ones that stop are the first k: k is the
    first at which the share that is left stops no other.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.coalesce(F.col("source").cast("binary"), F.lit("").cast("binary"))]
    rows = running_sums(totals, by_name, {"number": F.lit(1)}, scratch, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"weight": weight, "stop": most * F.col("source_size").cast("double")}).withColumn("ratio", F.col("source_size") / F.col("weight"))
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rows = running_sums(rows, [F.col("ratio"), *by_name], {"upto": F.col("stop"), "weight_upto": F.col("weight")}, scratch, "ratios")
    before, after = F.col("upto") - F.col("stop"), F.lit(whole[1]) - F.col("weight_upto") + F.col("weight")
    rows = rows.withColumn("level", (F.lit(whole[0]) - before) / after)
    free = rows.where(F.col("weight") * F.col("level") <= F.col("stop")).agg(F.min(F.struct("upto", "level"))["level"]).first()[0]
    share = F.col("stop") if free is None else F.least(F.col("stop"), F.col("weight") * free)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(share)
    return scratch.save(rows.select("source", "source_size", target.alias("target")), "targets")


def balance(sizes: DataFrame, goals: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """source, size, n and rate: what entropy balancing takes of each of the n documents of a size.

    Rates minimise the sum of rate * (log rate - 1) within [0, most] while each source's words, rate * size summed, meet
    its target. The dual has one variable a source and rates are least(most, exp(dual * size / mean size)). Documents
    of one source and size share a rate, so each Newton step is one aggregation of the table of their counts. A step
    that leaves the bracket of the root is replaced by its middle, so the steps end; a source at `most` times its size takes that rate.
    """
    classes = sizes.where(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    classes = scratch.save(classes, "classes")
    start = classes.groupBy("source").agg(F.sum("n").alias("docs"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
    start = start.join(goals, start["source"].eqNullSafe(goals["source"])).select(goals["source"], "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"), "smallest")
    # every rate reaches `most` once dual * smallest / mean >= log(most)
    bound = F.log(F.lit(float(most))) * F.col("mean") / F.col("smallest")
    full = F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))
    first = F.when(full, bound).otherwise(F.log(F.col("target") / F.col("source_size")))
    start = start.select("source", "target", "mean", first.alias("dual"), F.lit(-745.0).alias("low"), bound.alias("high"), full.alias("done"))
    dual, (sources,) = scratch.observed(start, "dual-0")
    beside = F.broadcast if sources <= BROADCAST_SOURCES else lambda dual: dual.hint("shuffle_hash")
    for step in itertools.count(1):
        at = classes.join(beside(dual), classes["source"].eqNullSafe(dual["source"])).select(dual["*"], "size", "n")
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("dual") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("source", "target", "mean", "dual", "low", "high", "done").agg(
            F.sum(words * F.least(F.lit(float(most)), raw)).alias("got"), F.sum(F.when(raw < most, words * x * raw).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        sums = sums.withColumns({"low": F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("dual")).otherwise(F.col("high")), "done": F.col("done") | (F.abs(gap) <= NEAR * F.col("target")) | (F.col("high") - F.col("low") <= TIGHT * (1 + F.abs("dual")))})
        newton = F.col("dual") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        following = F.when(F.col("done"), F.col("dual")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        dual, (moving,) = scratch.observed(sums.select("source", "target", "mean", following.alias("dual"), "low", "high", "done"), f"dual-{step}", F.count_if(~F.col("done")))
        scratch.drop(f"dual-{step - 1}")
        if not moving:
            break
    at = classes.join(beside(dual), classes["source"].eqNullSafe(dual["source"])).select(classes["*"], "target", "mean", "dual")
    return at.select("source", "size", "n", "target", F.least(F.lit(float(most)), F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(50.0)))).alias("rate"))


def copies_by_class(rates: DataFrame, most: int = MOST) -> DataFrame:
    """source, size, n and copies: whole copies of all n documents of a class together.

    A source has at most one row a size of text, however many documents it has. Along rising sizes its running sum of expected copies is rounded, which leaves an error of at most one copy
    anywhere; what words are then still missing or too many are added to or taken from classes along rising sizes, as
    long as one copy of a document fits.
    """
    order = Window.partitionBy("source").orderBy("size")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rates.withColumn("sum", F.sum(F.col("n") * F.col("rate")).over(upto))
    rows = rows.withColumn("k", F.floor(F.col("sum") + 0.5) - F.floor(F.coalesce(F.lag("sum").over(order), F.lit(0.0)) + 0.5))
    rows = rows.withColumn("k", F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") * most)))
    error = F.floor(F.col("target") + 0.5) - F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("source"))
    rows = rows.withColumn("error", error.cast("long"))
    room = F.when(F.col("error") > 0, F.least(F.col("n"), F.col("n") * most - F.col("k"))).otherwise(F.least(F.col("n"), F.col("k")))
    rows = rows.withColumn("room", room.cast("long"))
    rows = rows.withColumn("reach", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
    change = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("error") - F.col("reach")) / F.col("size"))))
    return rows.select("source", "size", "n", (F.col("k") + F.signum("error") * change).cast("long").alias("copies"))


def mix_documents(documents: DataFrame, scratch: Scratch | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, doc_key, source, size, source_size, target and copies of every row of documents.

    Null sources are one source, last in order. Null and empty texts have size 0 and no copies; texts of any length count
    whole. Of a class's documents those first in an order of hashed ids take the copies left over; equal rows take some
    each. The same table gives the same copies. An empty table gives no rows. Columns beside doc_id, text and source,
    whatever their names, are not read.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    sizes = scratch.save(sized(documents), "sizes")
    goals = targets(sizes, scratch, weights, most)
    n_sources = goals.count()
    taken = scratch.save(copies_by_class(balance(sizes, goals, scratch, most), most), "copies")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = rank_within(sizes, ["source", "size"], [F.col("doc_key"), F.col("doc_id")], parts, "rank")
    # as the classes may hold many documents, they are joined by part of the rank's hash too
    salt = F.pmod(F.xxhash64("rank"), F.lit(64)).cast("int")
    spread = taken.withColumn("salt", F.explode(F.when(F.col("n") > 64, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    spread = spread.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "copies", F.col("salt").alias("t"))
    large = F.lit(64)
    sizes_of = ranked.withColumn("salt", salt)
    joined = sizes_of.join(spread.where(F.col("n") > large).hint("shuffle_merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")), "left")
    joined = joined.select("doc_id", "doc_key", "source", "size", "rank", F.col("n").alias("n1"), F.col("copies").alias("c1"))
    small = spread.where(F.col("n") <= large).select("s", "z", "n", "copies")
    joined = joined.join(small.hint("shuffle_merge"), F.col("n1").isNull() & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    n, c = F.coalesce("n1", "n"), F.coalesce("c1", "copies")
    each = F.coalesce(F.floor(c / n) + F.when(F.col("rank") < c % n, 1).otherwise(0), F.lit(0)).cast("long")
    rows = joined.select("doc_id", "doc_key", "source", "size", each.alias("copies"))
    goals = goals.select(F.col("source").alias("g"), "source_size", "target")
    return rows.join(F.broadcast(goals) if n_sources <= BROADCAST_SOURCES else goals, F.col("source").eqNullSafe(F.col("g"))).drop("g")


def resampled(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns, whatever these are called.

    Null and empty texts have no words and are never taken; repeated rows are taken as often as their copies add up to. An
    empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "resampled")
    rows = mix_documents(documents, scratch, weights, most).groupBy("doc_key").agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    once = F.col("_rows") == 1
    taken, (n_once, n_repeated) = scratch.observed(rows.where(F.col("_copies") > 0), "taken", F.count_if(once), F.count_if(~once))
    taken = taken.withColumnRenamed("doc_key", "_key")
    scratch.drop("sizes", "copies", "classes", "sources", "ratios", "targets")
    repeated = taken.where(~once)
    row = fresh_name(documents, "_row")
    keyed = documents.select(doc_key().alias("_own"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row))

    def drawn(side: DataFrame, n: int, rows: DataFrame) -> DataFrame:
        side = F.broadcast(side) if n <= BROADCAST_KEYS else side
        return rows.join(side, F.col("_own") == F.col("_key")).select(row, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(f"{row}.*")

    out = drawn(taken.where(once), n_once, keyed)
    if n_repeated:
        out = out.unionByName(drawn(repeated, n_repeated, keyed.join(repeated.select("_key"), F.col("_own") == F.col("_key"), "left_semi").dropDuplicates(["_own"])))
    return out


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_documents over all `documents`; its docstring gives the results for nulls, empty and long texts, ties, repeats and empty tables."""
    rows = mix_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
