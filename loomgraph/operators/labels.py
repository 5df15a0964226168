"""Search of many terms at once by their rarest pieces, and what the labels of a drawing mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import traverse
from loomgraph.operators.spread import set_bits
from loomgraph.schema import Graph
from loomgraph.scratch import Scratch

#: Hits that a term keeps, matches that a label keeps and their least score, labels of a screen that count.
TERM_HITS, MATCHES, LEAST_MATCH, SCREEN_LABELS = 10, 5, 60, 15
#: Lengths of the pieces that a term is found by: the longest that it has, so at most a third of a term of up to 47 letters is left to check.
PIECES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Terms whose pieces' hashes are sent to every task at once; beyond it the texts are read several times.
FEW_TERMS = 1_000_000
#: Pieces are counted by so many remainders of their hashes, which tells the common ones from the others.
REMAINDERS = 1 << 16


def pieces(graph: Graph, lengths: list[int]) -> DataFrame:
    """id, type, field, text, at and piece (its hash): each piece of these lengths of each node's lower-cased name and id, and the letter it begins at."""
    texts = graph.nodes.select("id", "type", F.explode(F.array(F.struct(F.lit("name").alias("field"), F.lower("name").alias("text")), F.struct(F.lit("id").alias("field"), F.lower("id").alias("text")))).alias("t"))
    sized = texts.select("id", "type", "t.field", "t.text", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("size")).where(F.length("text") >= F.col("size"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)).alias("at"))
    return placed.select("id", "type", "field", "text", "at", F.xxhash64(F.col("text").substr(F.col("at"), F.col("size"))).alias("piece"))


def search_terms(graph: Graph, terms: DataFrame, most: int = TERM_HITS) -> DataFrame:
    """term, id, type and score of the best `most` nodes of each term (column term, lower-cased): 100 for a name or id that is the term,
    80 for a name that starts with it, 60 for one that holds it, 40 for an id that does; of equal scores the smaller id. [FLT-05]

    A term meets the texts by the rarest of its longest pieces, so a common one costs nothing where a rare one stands beside it. Pieces of
    texts are never written: those that no term is found by drop out where they are made, and what is left is checked in the place
    where the piece says the term must begin. A term's hits are cut to `most` before they are shuffled.

    Nodes hold some hundred times what their files weigh, so Spark, which goes by files, is told not to broadcast them: hashes of
    pieces are, FEW_TERMS at a time.
    """
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "labels")
    size = F.lit(PIECES[0])
    for n in PIECES[1:]:
        size = F.when(F.length("term") >= n, n).otherwise(size)
    terms = scratch.save(terms.select("term").where(F.length("term") > 0).distinct().withColumn("size", size))
    asked, lengths = terms.count(), sorted(r["size"] for r in terms.select("size").distinct().collect())
    if not asked:
        return spark.createDataFrame([], "term string, id string, type string, score int")
    made = pieces(graph, lengths)
    remainder = F.pmod("piece", F.lit(REMAINDERS)).alias("remainder")
    own = terms.select("term", "size", F.explode(F.sequence(F.lit(0), F.length("term") - F.col("size"))).alias("offset"))
    own = own.select("term", "offset", F.xxhash64(F.col("term").substr(F.col("offset") + 1, F.col("size"))).alias("piece"))
    counts = made.groupBy(remainder).agg(F.count(F.lit(1)).alias("n"))
    chosen = own.withColumn("remainder", remainder).join(counts, "remainder", "left").groupBy("term").agg(F.min_by(F.struct("piece", "offset"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"))).alias("p"))
    chosen = scratch.save(chosen.select("term", "p.piece", "p.offset"))
    rounds, met = -(-asked // FEW_TERMS), None
    for k in range(rounds):
        some = chosen.where(F.pmod("piece", F.lit(rounds)) == k) if rounds > 1 else chosen
        one = made.join(F.broadcast(some.select("piece").distinct()), "piece", "left_semi").hint("merge").join(some, "piece")
        met = one if met is None else met.unionByName(one)
    start = F.col("at") - F.col("offset")
    there = (start > 0) & (F.col("text").substr(start, F.length("term")) == F.col("term"))
    score = F.when(F.col("text") == F.col("term"), 100).when((F.col("field") == "name") & (start == 1), 80).when(F.col("field") == "name", 60).otherwise(40)
    scored = met.where(there).groupBy("term", "id", "type").agg(F.max(score).alias("score"))
    first = Window.partitionBy("term").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("place")


def terms_of(label: Column) -> Column:
    """What a label asks for: itself with weight 2 and each run of three or more ASCII letters or digits in it with weight 1, lower-cased."""
    tokens = F.filter(F.regexp_extract_all(label, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    phrase = F.array(F.struct(F.lower(F.trim(label)).alias("term"), F.lit(2).alias("weight")))
    return F.concat(phrase, F.transform(tokens, lambda x: F.struct(F.lower(x).alias("term"), F.lit(1).alias("weight"))))


def match_labels(graph: Graph, labels: DataFrame) -> DataFrame:
    """label, place, id, type and score: the nodes that each label (column label) may be, at most MATCHES, best first. [FLT-07]

    Terms that labels share are searched once. A term's best hits count before files drop out.
    """
    asked = labels.select("label").distinct().select("label", F.inline(terms_of(F.col("label")))).groupBy("label", "term").agg(F.sum("weight").alias("weight"))
    hits = search_terms(graph, asked)
    total = asked.join(hits.where(F.col("type") != "file"), "term").groupBy("label", "id", "type").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
    best = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return total.where(F.col("score") >= LEAST_MATCH).withColumn("place", F.row_number().over(best)).where(F.col("place") <= MATCHES).select("label", "place", "id", "type", "score")


def blueprint(graph: Graph, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What screens' labels (screen, place, label) mean, and where. [AGG-19]

    Elements: screen, place, label, id and n_routes, the first SCREEN_LABELS of a screen; id is null without a match. Screens: screen,
    n_labels, n_matched, route and votes: the route that most of the matches are on, of equal ones that voted for first, then the
    smaller id. Routes of a match are bits of its row, taken apart for matches alone.
    """
    scratch = Scratch(graph.nodes.sparkSession, "blueprint")
    first = Window.partitionBy("screen").orderBy("place", "label")
    asked = labels.withColumn("k", F.row_number().over(first)).where(F.col("k") <= SCREEN_LABELS).drop("k")
    best = match_labels(graph, asked).where("place = 1").select("label", "id")
    matched = scratch.save(asked.join(best, "label", "left").select("screen", "place", "label", "id"))
    wanted = matched.select(F.col("id").alias("node")).where("node IS NOT NULL").distinct()
    on = None
    for found in traverse.route_bits(graph, wanted.withColumnRenamed("node", "id")):
        rows = found.nodes.join(wanted, "node", "left_semi").select("node", *found.bits()).select(F.col("node").alias("id"), F.explode(set_bits(found.words)).alias("bit"))
        one = rows.join(F.broadcast(found.starts), "bit").select("id", F.col("start").alias("route"))
        on = one if on is None else on.unionByName(one)
    on = scratch.save(graph.nodes.sparkSession.createDataFrame([], "id string, route string") if on is None else on)
    counts = on.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    elements = matched.join(counts, "id", "left").select("screen", "place", "label", "id", F.coalesce("n", F.lit(0)).alias("n_routes"))
    votes = matched.join(on, "id").groupBy("screen", "route").agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("since"))
    top = votes.groupBy("screen").agg(F.min_by(F.struct("route", "votes"), F.struct((-F.col("votes")).alias("v"), "since", "route")).alias("t"))
    screens = matched.groupBy("screen").agg(F.count(F.lit(1)).alias("n_labels"), F.count("id").alias("n_matched")).join(top, "screen", "left")
    return elements, screens.select("screen", "n_labels", "n_matched", F.col("t.route").alias("route"), F.coalesce("t.votes", F.lit(0)).alias("votes"))
