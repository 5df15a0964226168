"""N-gram Jaccard join with set-relation skipping, and the classes of documents that its links make."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, distinct_by_owner, doc_key, fresh_name, hash_strings, join_hot, join_salted, mix, release, ship, shingle_hashes, slices, split_words, table

WIDTH, PERCENT = 5, 80
#: Shingles found in at least so many documents are put last in the order of shingles, by their count; the most frequent
#: ones up to FREQUENT_MOST, which bounds what is broadcast (16 bytes each). The order affects speed, never the result.
FREQUENT_LEAST, FREQUENT_MOST = 8, 500_000
#: Shingles that occur twice within so many bytes of text are counted; of the others one in SPARSE is, for SPARSE.
FREQUENT_BYTES, SPARSE = 4 << 20, 64
#: Ids broadcast at most; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Partners that one task compares with a set, about.
HUB_BLOCK = 300
#: Postings of a list that one join task compares with others, about.
LIST_BLOCK = 1000


# ---- sets -------------------------------------------------------------------------------------------------------


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, A-Z lower-cased, and where each text's begin."""
    distinct, codes, bounds = split_words(text, lower=True)
    words = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    values, owners = shingle_hashes(words, bounds, width)
    return distinct_by_owner(values, owners, len(text))


def probe_length(n, percent: int):
    """Leading shingles of a set of n of which a set with `percent` likeness must share one."""
    return n + 1 + (-percent * n) // 100


def _frequent(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many documents, ascending, and their counts.

    Counts are exact for what occurs twice or more within a slice. What occurs once in a slice, be it in every slice of the corpus,
    is sampled by a hash of shingle and slice, and counts from the second slice on in which it is drawn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=FREQUENT_BYTES):
            values, at = shingle_sets(batch.column("text"), width)
            salt = values[0] if len(values) else np.uint64(0)
            values, counts = np.unique(values, return_counts=True)
            drawn = (counts == 1) & (mix(values ^ mix(np.array([salt]) + np.uint64(len(at)))) % np.uint64(SPARSE) == 0)
            keep = (counts > 1) | drawn
            n = np.where(drawn, SPARSE, counts)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n, pa.int64()), pa.array(np.where(drawn[keep], 1, 2), pa.int64())], names=["token", "n", "seen"])

    counted = documents.select("text").mapInArrow(run, "token long, n long, seen long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    rows = counted.where((F.col("n") >= FREQUENT_LEAST) & (F.col("seen") > 1)).select("token", "n").orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("n").to_numpy()[order]


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and doc_key."""
    return documents.select("doc_id", "text", doc_key().alias("doc_key"))


def _sets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, doc_key, n, a 128-bit key of the set, and its first probe_length(n) shingles in the global order."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    often, often_n = _frequent(documents, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, at = shingle_sets(batch.column("text"), width)
            sizes = np.diff(at)
            keys = []
            for salt in (np.uint64(1), np.uint64(2)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * salt + salt), dtype=np.uint64)])
                keys.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            count = np.zeros(len(values), np.int64)
            if len(often) and len(values):
                place = np.minimum(np.searchsorted(often, values), len(often) - 1)
                count = np.where(often[place] == values, often_n[place], 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, count, owner))
            take = np.where(sizes > 0, probe_length(sizes, percent), 0)
            first = np.cumsum(take) - take
            index = np.arange(int(take.sum())) - np.repeat(first - at[:-1], take)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [take.sum()]]), pa.int32()), pa.array(values[order[index]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_key"), pa.array(sizes, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), prefix], names=["doc_id", "doc_key", "n", "k1", "k2", "prefix"])

    return _keyed(documents).mapInArrow(run, f"doc_id {kind}, doc_key binary, n long, k1 long, k2 long, prefix array<long>")


# ---- candidates and links ---------------------------------------------------------------------------------------


def _need(na: Column, nb: Column, percent: Column | int) -> Column:
    """Shingles that alike sets of these sizes share, at least."""
    return F.ceil(F.lit(percent) * (na + nb) / (F.lit(percent) + 100.0) - 1e-6)


def _shared_least(na: Column, nb: Column, percent: int, likeness: Column | int | None = None) -> Column:
    """Least number of leading shingles that sets of these sizes share if they are alike (to `likeness` percent; else to percent).

    Of the shingles that they share at most n - probe_length(n) lie behind a set's leading ones, and those before
    the end of the shorter-reaching lead are in both leads.
    """
    spare = lambda n: F.ceil(F.lit(percent) * n / F.lit(100.0) - 1e-9) - 1
    return _need(na, nb, percent if likeness is None else likeness) - F.greatest(spare(na), spare(nb))


def _sizes_agree(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _lists_of(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _compared(documents: DataFrame, repeats: bool, nodes: DataFrame, pairs: DataFrame, width: int, scratch: Scratch, label: str) -> DataFrame:
    """Of the pairs (a, b, likeness) those alike to `likeness` percent: a, b, nb (b's size), and what a lacks of b and has beside it.

    Texts, which take less room than their sets, are dealt by b in one shuffle: b's own text first, then those of its
    partners. A b of many partners is dealt to several tasks, each with a copy of its text.
    """
    pairs, (total,) = scratch.observed(pairs.select("a", "b", "likeness"), f"pairs-{label}")
    counts = scratch.save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), f"counts-{label}")
    counts = counts.withColumn("parts", F.ceil(F.col("c") / HUB_BLOCK).cast("int"))
    members = join_hot(pairs, counts, ["b"], "c", total).select(F.col("a").alias("node"), "b", "likeness", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("salt"))
    heads = counts.select(F.col("b").alias("node"), "b", F.lit(0.0).alias("likeness"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    rows = members.unionByName(heads)
    rows, (many,) = scratch.observed(rows.join(nodes.select("node", "doc_key").hint("shuffle_merge"), "node"), f"rows-{label}")
    wanted = F.broadcast(rows) if many <= BROADCAST_IDS else rows
    texts = _keyed(documents).select("doc_key", "text")
    texts = texts.dropDuplicates(["doc_key"]) if repeats else texts
    shuffled = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.join(wanted, "doc_key").select("b", "salt", (F.col("node") != F.col("b")).alias("partner"), "node", "likeness", "text")
    dealt = dealt.repartition(shuffled, "b", "salt").sortWithinPartitions("b", "salt", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in slices(batches):
            values, at = shingle_sets(batch.column("text"), width)
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, (b, node, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "node", "likeness")), strict=True)):
                own = values[at[i] : at[i + 1]]
                if node == b:
                    head = own
                    continue
                shared = np.intersect1d(head, own, assume_unique=True)
                if 100 * len(shared) >= least * (len(head) + len(own) - len(shared)) - 1e-6:
                    row = (node, b, len(head), np.setdiff1d(head, shared, assume_unique=True), np.setdiff1d(own, shared, assume_unique=True))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], *map(_lists_of, out[3:])], names=["a", "b", "nb", "gone", "more"])

    found = scratch.save(dealt.mapInArrow(run, "a long, b long, nb long, gone array<long>, more array<long>"), f"found-{label}")
    scratch.drop(f"pairs-{label}", f"counts-{label}", f"rows-{label}")
    return found


def _has_repeats(documents: DataFrame) -> bool:
    """Whether an id occurs twice: then rows may be equal altogether."""
    return not documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).isEmpty()


def components(links: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """node and component (its smallest node) of every node of links (a, b).

    Alternating large and small stars: each round is a minimum per node and a join in which hot nodes are broadcast;
    it ends when all that is left are stars around their smallest nodes, that is when no node with a smaller neighbour has a second one.
    """
    edges = scratch.save(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    for step in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        least, (ends, chained) = scratch.observed(least, f"{label}-l{step}", F.sum("c"), F.count_if((F.col("m") < F.col("u")) & (F.col("c") > 1)))
        if not chained:
            break
        total = ends // 2
        large = join_hot(both.where(F.col("v") > F.col("u")), least, ["u"], "c", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{label}-g{step}")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), f"{label}-m{step}")
        small = join_hot(large, least, ["u"], "c", total).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{step}")
        scratch.drop(*[f"{label}-{part}{step}" for part in ("l", "g", "m")])
        scratch.drop(f"{label}-{step - 1}")
    done = scratch.save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), f"{label}-done")
    scratch.drop(f"{label}-l{step}", f"{label}-{step - 1}")
    return done


def _star_pairs(lists: DataFrame, percent: int, total: int, scratch: Scratch) -> DataFrame:
    """Each posting's set with the hub of its list, the posting that comes earliest in its set's order.

    A pair that meets in fewer lists than half of what alike sets share is left to the later comparison of homes.
    """
    hubs = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "node")).alias("hub"), F.first("c").alias("c"))
    lists = join_hot(lists.drop("c"), scratch.save(hubs, "hubs"), ["token"], "c", total)
    rows = lists.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
    rows = rows.where((F.col("a") != F.col("b")) & _sizes_agree(F.col("na"), F.col("nb"), percent))
    met = rows.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))
    return met.where(2 * F.col("met") >= _shared_least(F.col("na"), F.col("nb"), percent)).select("a", "b", F.lit(float(percent)).alias("likeness"))


def _homes(star: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, home, members (the home's, itself included) and likeness of every set of the star links (a, b, nb, gone, more).

    A set goes home to the alike hub with the most links, unless a set has chosen it: then it is its own home. A set alike to a
    member has at least `likeness` percent in common with the home, by the triangle inequality of Jaccard distances.
    """
    links = star.select("a", "b", ((F.col("nb") - F.size("gone")) / (F.col("nb") + F.size("more"))).alias("j"))
    total = links.count()
    counts = links.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    best = join_hot(links, scratch.save(counts, "degrees"), ["b"], "c", total).groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"), "j")).alias("best"))
    best = scratch.save(best.select("a", (-F.col("best.b")).alias("home"), "best.j"), "best")
    chosen = best.select(F.col("home").alias("a")).distinct()
    members = scratch.save(best.join(chosen.hint("shuffle_merge"), "a", "left_anti"), "members")
    about = members.groupBy("home").agg(F.count(F.lit(1)).alias("c"), (F.lit(float(percent - 100)) + 100 * F.min("j")).alias("likeness"))
    about = scratch.save(about, "about")
    rows = join_hot(members.select(F.col("a").alias("node"), "home"), about, ["home"], "c", total)
    rows = rows.select("node", "home", "c", "likeness").unionByName(about.select(F.col("home").alias("node"), "home", "c", "likeness"))
    homes = scratch.save(rows.select("node", "home", (F.col("c") + 1).alias("members"), "likeness"), "homes")
    scratch.drop("degrees", "best", "members", "about")
    return homes


def _home_pairs(lists: DataFrame, homes: DataFrame | None, classes: DataFrame | None, percent: int, total: int, scratch: Scratch) -> DataFrame:
    """a (a set), b (another one) and likeness, where a may be alike to b or to a member of b.

    With homes, lists hold the members of homes: each home of a list meets the postings of smaller homes, once whatever its
    number of members, and a list whose postings are all of one home is skipped. With classes (node and component of sets known to
    be in one class) every set is its own home, only sets of different classes meet, and those of a list's largest class
    meet only the others. A list is cut into blocks of like sizes; a posting skips the blocks of sets of which it shares
    too little from its position on, before the join. Long lists are dealt to several tasks.
    """
    if classes is None:
        known = lists.join(homes.hint("shuffle_merge"), "node", "left")
        known = known.withColumns({"home": F.coalesce("home", "node"), "members": F.coalesce("members", F.lit(1)), "likeness": F.coalesce("likeness", F.lit(float(percent)))}).withColumn("skip", F.col("home"))
    else:
        known = lists.join(classes.hint("shuffle_merge"), "node", "left").withColumn("skip", F.coalesce("component", "node")).drop("component")
        known = known.withColumns({"home": F.col("node"), "members": F.lit(1), "likeness": F.lit(float(percent))})
    growth = 100 / percent
    known = scratch.save(known.withColumn("block", F.floor(F.log("n") / math.log(growth)).cast("int")), "known")
    each = known.groupBy("token", "skip").agg(F.count(F.lit(1)).alias("k"), F.first("c").alias("c"))
    several = each.groupBy("token").agg(F.max(F.struct("k", "skip"))["skip"].alias("major"), F.count(F.lit(1)).alias("skips"), F.first("c").alias("c")).where(F.col("skips") > 1).drop("skips")
    rows = scratch.save(join_hot(known.drop("c"), scratch.save(several, "several"), ["token"], "c", total), "mixed")
    parts = F.ceil(F.col("c") / LIST_BLOCK).cast("int")
    right = rows.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    near = F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)
    reached = F.filter(near, lambda k: F.col("n") - F.col("pos") >= F.lit(percent) * (F.col("n") + F.pow(F.lit(growth), k)) / F.lit(100.0 + percent) - 1e-3)
    left = rows if classes is None else rows.where(F.col("skip") != F.col("major"))
    left = left.withColumn("block", F.explode(reached)).groupBy("token", "block", "home", "skip").agg(
        F.first("members").alias("members"), F.first("likeness").alias("likeness"), F.first("c").alias("c"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.max(F.col("n") - F.col("pos")).alias("behind")
    )
    x, y = left.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("x"), right.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.block") == F.col("y.block"))
    if classes is None:
        once = (F.col("x.members") > F.col("y.members")) | ((F.col("x.members") == F.col("y.members")) & (F.col("x.home") > F.col("y.home")))
    else:
        once = (F.col("y.skip") == F.col("y.major")) | (F.col("x.home") > F.col("y.home"))
    sizes = (100 * F.col("y.n") >= percent * F.col("x.shortest")) & (percent * F.col("y.n") <= 100 * F.col("x.longest"))
    behind = F.least(F.col("x.behind"), F.col("y.n") - F.col("y.pos")) >= _need(F.col("x.shortest"), F.col("y.n"), percent)
    pairs = x.join(y.hint("shuffle_merge"), met & (F.col("x.skip") != F.col("y.skip")) & once & sizes & behind)
    if classes is not None:
        return pairs.select(F.least("y.node", "x.home").alias("a"), F.greatest("y.node", "x.home").alias("b"), F.col("x.likeness").alias("likeness")).distinct()
    return pairs.select(F.col("y.node").alias("a"), F.col("x.home").alias("b"), F.col("x.likeness").alias("likeness")).distinct()


def _leads_agree(pairs: DataFrame, leads: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose leading shingles have as many in common as sets so alike must have. leads: node, n, prefix."""
    pairs, (total,) = scratch.observed(pairs, "met")
    both = pairs
    for side in ("a", "b"):
        uses = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("uses"))
        right = leads.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("prefix").alias(f"p{side}")).join(uses.hint("shuffle_merge"), side)
        both = join_salted(both, right, [side], "uses", total, LIST_BLOCK).drop("uses")
    shared = F.size(F.array_intersect("pa", "pb"))
    return both.where(shared >= _shared_least(F.col("na"), F.col("nb"), percent, F.col("likeness"))).select("a", "b", "likeness")


def _answers(star: DataFrame, guests: DataFrame, homes: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all classes, and node and n_links: how many other sets each set is alike to.

    All sets near a home are told by their difference to it. Of a set that lacks d of the home's H shingles and has e beside
    them the weight is 100 d + percent * e; two sets whose differences share s shingles are alike if and only if their weights'
    sum is at most (100 - percent) H + (100 + percent) s. So the answers of a member follow from those of its home: with s = 0
    they are a rank among the weights, and only pairs beyond that whose differences meet are looked at further.
    """
    weight = 100 * F.size("gone") + percent * F.size("more")
    columns = [F.col("b").alias("home"), F.col("a").alias("node"), weight.cast("long").alias("w"), (F.col("nb") * (100 - percent)).alias("limit"), F.concat("gone", "more").alias("diff")]
    inside = star.join(homes.select(F.col("node").alias("a"), F.col("home").alias("b")).hint("shuffle_merge"), ["a", "b"])
    rows = inside.select(*columns, F.lit(True).alias("member")).unionByName(guests.select(*columns, F.lit(False).alias("member")))
    own = rows.groupBy("home").agg(F.first("limit").alias("limit")).select("home", F.col("home").alias("node"), F.lit(0).cast("long").alias("w"), "limit", F.array().cast("array<long>").alias("diff"), F.lit(True).alias("member"))
    rows = scratch.save(rows.unionByName(own), "groups")
    # pairs whose weights alone don't make them alike, but whose differences have shingles in common
    most = F.col("limit") + (100 + percent) * F.size("diff")
    shingles = rows.where(F.size("diff") > 0)
    shingles = shingles.select("home", "node", "w", "limit", "member", most.alias("most"), F.explode("diff").alias("shingle"))
    shared = shingles.groupBy("home", "shingle").agg(F.count(F.lit(1)).alias("c"), F.bool_or("member").alias("any")).where((F.col("c") > 1) & F.col("any")).drop("any")
    shared = scratch.save(shared, "shared")
    total = int(shared.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    parts = F.ceil(F.col("c") / LIST_BLOCK).cast("int")
    listed = scratch.save(join_hot(shingles, shared, ["home", "shingle"], "c", total), "listed")
    x = listed.where("member").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).alias("x")
    y = listed.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("y")
    met = (F.col("x.home") == F.col("y.home")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt"))
    sum_ = F.col("x.w") + F.col("y.w")
    open_ = (sum_ > F.col("x.limit")) & (sum_ <= F.least("x.most", "y.most")) & (~F.col("y.member") | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y.hint("shuffle_merge"), met & open_).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), sum_.alias("sum"), F.col("x.limit").alias("limit"), (F.col("y.w") > F.col("y.limit")).alias("far")).agg(F.count(F.lit(1)).alias("s"))
    pairs = scratch.save(pairs.where((100 + percent) * F.col("s") >= F.col("sum") - F.col("limit")).select("a", "b", "far"), "pairs")
    near = rows.where((F.col("w") <= F.col("limit")) & (F.col("node") != F.col("home"))).select(F.col("node").alias("a"), F.col("home").alias("b"))
    links = star.select("a", "b").unionByName(near).unionByName(pairs.where("far").select("a", "b"))
    scratch.drop("shared", "listed")
    ranks = scratch.save(rows.groupBy("home", "w", "limit").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("g"), F.count(F.lit(1)).alias("c")), "weights")
    # of each weight of a home (at most its (100 - percent) H, and those of its guests) how many members and guests it is alike to
    asked = ranks.select("home", (F.col("limit") - F.col("w")).alias("at"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("g"), F.lit(1).alias("asks"), "w")
    upto = Window.partitionBy("home").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranks.select("home", F.col("w").alias("at"), "m", "g", F.lit(0).alias("asks"), "w").unionByName(asked).withColumns({"m": F.sum("m").over(upto), "g": F.sum("g").over(upto)})
    answers = summed.where("asks = 1").select("home", "w", "m", "g").join(ranks.select("home", "w", "c"), ["home", "w"])
    own = join_hot(rows.select("home", "node", "w", "limit", "member"), scratch.save(answers, "answers"), ["home", "w"], "c", int(rows.count()))
    of = F.when(F.col("member"), F.col("m") + F.col("g") - (2 * F.col("w") <= F.col("limit")).cast("long")).otherwise(F.col("m"))
    more = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links"))
    n_links = own.select("node", of.alias("n_links")).unionByName(more).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return links, scratch.save(n_links, "n_links")


def link_classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None, count_links: bool = False, repeats: bool | None = None) -> DataFrame:
    """doc_id, doc_key, n_shingles, component_id, class_key and, with count_links, n_links of every row of documents.

    Rows link when 100 * shared >= percent * union of their sets of `width`-word shingles (A-Z lower-cased, ASCII white
    space); a text of fewer words has its whole sequence as one shingle, and a text without words, or null, links with
    nothing. component_id is the smallest doc_id of the class, null only if all its ids are; class_key tells classes apart
    even if ids repeat or are null, and is null for a text without words. n_links counts the different sets of shingles that
    a row's set is alike to; rows of equal sets are one node, so copies make no pairs. Links are exact but for equal 64-bit
    hashes of different shingles. Texts of any length are read whole, an empty table gives no rows, repeated rows each get
    theirs, and columns beside doc_id and text, whatever their names, are not read.

    Frequent shingles come last in the global order, so lists of the leading shingles are mostly short. First each posting is
    compared with the hub of its list only. With count_links, sets alike to a hub go home to it; then homes, not sets, meet in
    the lists that hold several, and the links of members are derived from their homes' by the differences (see _answers).
    Without, only classes are asked for: what is in one class already doesn't meet. repeats tells whether an id occurs twice, if the
    caller knows.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    documents = documents.select("doc_id", "text")
    repeats = _has_repeats(documents) if repeats is None else repeats
    full = scratch.save(_sets(documents, width, percent), "full")
    sets, (all_rows,) = scratch.observed(full.drop("prefix"), "sets")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key")).alias("one")
    nodes = full.where(F.col("n") > 0).groupBy("k1", "k2", "n").agg(one, F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select("k1", "k2", "n", F.col("one.doc_id").alias("first_id"), F.col("one.doc_key").alias("doc_key"), "prefix", "copies", F.monotonically_increasing_id().alias("node"))
    leads = scratch.save(nodes, "leads")
    nodes = scratch.save(leads.drop("prefix"), "nodes")
    scratch.drop("full")
    postings = leads.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens, (total,) = scratch.observed(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "tokens", F.sum("c"))
    lists = scratch.save(join_hot(postings, tokens, ["token"], "c", total), "lists")
    scratch.drop("tokens")
    release(spark)
    star = _compared(documents, repeats, nodes, _star_pairs(lists, percent, total, scratch), width, scratch, "star")
    scratch.drop("hubs")
    release(spark)
    homes = _homes(star, percent, scratch) if count_links else None
    classes = None if count_links else components(star.select("a", "b"), scratch, "stars")
    pairs = _leads_agree(_home_pairs(lists, homes, classes, percent, total, scratch), leads, percent, scratch)
    guests = _compared(documents, repeats, nodes, pairs, width, scratch, "guests")
    scratch.drop("lists", "known", "several", "mixed", "leads", "met")
    release(spark)
    if count_links:
        links, n_links = _answers(star, guests, homes, percent, scratch)
    else:
        links = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(guests.select("a", "b"))
    found = components(links, scratch, "all")
    scratch.drop("found-star", "found-guests", "groups", "pairs", "homes", "weights", "answers", "stars-done")
    release(spark)
    own = found.join(nodes.select("node", "first_id").hint("shuffle_merge"), "node")
    least = own.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    least, (linked,) = scratch.observed(least, "least", F.sum("c"))
    own = join_hot(own, least, ["component"], "c", linked).select("node", "component", "component_id")
    classed = nodes.select("k1", "k2", "n", "node", "first_id", "copies").join(own.hint("shuffle_merge"), "node", "left")
    extra = ["n_links"] * count_links
    if count_links:
        classed = classed.join(n_links.hint("shuffle_merge"), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    classed = scratch.save(classed.select("k1", "k2", "n", "copies", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "node").alias("class_key"), *extra), "classed")
    scratch.drop("least", "all-done", "nodes", "n_links")
    rows = sets.select("doc_id", "doc_key", "n", "k1", "k2")
    joined = join_hot(rows.where(F.col("n") > 0), classed, ["k1", "k2", "n"], "copies", all_rows)
    names = ["doc_id", "doc_key", F.col("n").alias("n_shingles"), "component_id", "class_key", *extra]
    alone = rows.where(F.col("n") == 0).withColumns({"component_id": F.col("doc_id"), "class_key": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
    return joined.select(names).unionByName(alone.select(names))


def drop_near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each class: that with the smallest doc_id (null last), then doc_key. All columns are kept, whatever their names.

    Rows equal in id and text count as copies, of which one stays. Rows without words, null texts among them, all stay but
    for such copies. Long texts are read whole; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    repeats = _has_repeats(documents)
    classes = scratch.save(link_classes(documents, width, percent, scratch, repeats=repeats), "classes").where(F.col("n_shingles") > 0)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key")
    best = classes.groupBy("class_key").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("c"))
    best, (total,) = scratch.observed(best.where(F.col("c") > 1), "best", F.sum("c"))
    dropped = join_hot(classes, best, ["class_key"], "c", total).where(F.col("doc_key") != F.col("best.doc_key")).select("doc_key").distinct()
    name = fresh_name(documents, "gone")
    gone, (many,) = scratch.observed(dropped.select(F.col("doc_key").alias(name)), "dropped")
    scratch.drop("classes", "best", "classed", "sets")
    release(spark)
    gone = F.broadcast(gone) if many <= BROADCAST_IDS else gone
    kept = documents.join(gone, doc_key() == F.col(name), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_classes of three-word shingles and 90 percent over all `documents`, with the number of links; its docstring gives
    the results for nulls, empty and long texts, ties, repeats and empty tables."""
    return link_classes(table(spark, sf_dir, "documents"), 3, 90, count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
z AS (SELECT r, count(*) AS n, hash(list_sort(list(g))) AS h FROM s GROUP BY r),
rep AS (SELECT h, n, min(r) AS r FROM z GROUP BY h, n),
t AS (SELECT s.g, s.r, rep.n FROM s JOIN rep USING (r)),
o AS (SELECT a.r AS x, b.r AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * c >= 90 * (nx + ny - c)),
link AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(a, b) AS (SELECT r, r FROM rep UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
low AS (SELECT rep.h, rep.n, d.doc_id AS first_id, rep.r FROM rep JOIN (SELECT h, n, min(doc_id) AS doc_id FROM z JOIN d USING (r) GROUP BY h, n) d USING (h, n)),
comp AS (SELECT a, min(first_id) AS component_id FROM reach JOIN low ON reach.b = low.r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id, coalesce(many.n_links, 0) AS n_links
FROM d LEFT JOIN z USING (r) LEFT JOIN rep ON z.h = rep.h AND z.n = rep.n LEFT JOIN comp ON comp.a = rep.r LEFT JOIN (SELECT x, count(*) AS n_links FROM link GROUP BY x) many ON many.x = rep.r
"""

