"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, forests of ranges merged at their ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import FOLDS, Scratch, join_hot, running_sums, ship, table

#: Turns of a conversation that one row holds; longer ones go on in further rows, whose tries hang below the earlier ones'.
PIECE = 256
#: Characters of a turn's digest in a row's key.
DIGEST = 32
#: Turns that a conversation may take from the first of its five, at most one less.
SHARED = 9
#: Bytes of ids that one row hands to the digest of a large group.
ENDS_BYTES = 1 << 16
_NONE = -1  # a row begins a trie of its own


def rebuilt(conversations: DataFrame, scratch: Scratch, rebuild: bool = True) -> DataFrame:
    """conv_id, depth (from 1), digest and size of each turn of the rebuilt conversations; one row of depth 0 for each of them.

    The first h turns of conversation c - c % 5 (truncated, so towards 0) and c's own turns after its first h; h = crc32(c) % 9.
    Turns are numbered over ranges of the whole table, so a conversation of any share of it is spread.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("size"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("tie")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie")]
    numbered = scratch.save(running_sums(turns, order, {"at": F.lit(1).cast("long")}, scratch, "turns").select("conv_id", "at", "digest", "size"), "numbered")
    first = numbered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    total = numbered.count()
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) if rebuild else F.lit(0).cast("long")) % SHARED
    placed = join_hot(numbered, first, ["conv_id"], "n", total).withColumn("place", F.col("at") - F.col("first"))
    base = F.col("conv_id") - F.col("conv_id") % FOLDS
    # who takes how much, and how many turns there are to take; a head is of at most SHARED turns
    taking = first.select("conv_id", base.alias("base"), shared.alias("h"))
    held = first.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taking = scratch.save(taking.join(held, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "taking")
    heads = placed.where(F.col("place") < SHARED - 1).select(F.col("conv_id").alias("base"), "place", "digest", "size")
    given = taking.join(heads, "base").where(F.col("place") < F.col("taken")).select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "size")
    sized = taking.join(first.select("conv_id", "n"), "conv_id").select("conv_id", "h", "taken", "n")
    own = join_hot(placed.drop("n", "first"), sized, ["conv_id"], "n", total).where(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "size")
    roots = taking.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("size"))
    return roots.unionByName(given).unionByName(own)


def pieces(turns: DataFrame, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """conv_id, part, above, below, seq and sizes: up to `piece` turns of a conversation as the string of their digests, with their bytes.

    above names the turns before this part: equal for conversations that agree in all of them. below is the next part's above; null if
    no part follows.
    """
    part = F.greatest(F.lit(0), F.floor((F.col("depth") - 1) / piece)).cast("long")
    rows = turns.withColumn("part", part).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "size"))).alias("t"))  # at most `piece` + 1 rows
    seq = F.array_join(F.transform("t", lambda x: x["digest"]), "")
    sizes = F.transform(F.filter("t", lambda x: x["depth"] > 0), lambda x: x["size"])
    rows = scratch.save(rows.select("conv_id", "part", seq.alias("seq"), sizes.alias("sizes")), "pieces")
    if rows.where("part > 0").isEmpty():
        return rows.select("*", F.lit("").alias("above"), F.lit(None).cast("string").alias("below"))
    # the sums of 64-bit hashes of the parts so far, over the whole table in order; what the conversation's parts before add is a difference
    hashed = lambda salt: F.xxhash64(F.lit(salt), "part", "seq").cast("decimal(20,0)")
    long_ones = rows.join(rows.where("part = 1").select("conv_id"), "conv_id", "left_semi").select("conv_id", "part", hashed(1).alias("h1"), hashed(2).alias("h2"))
    summed = scratch.save(running_sums(long_ones, [F.col("conv_id"), F.col("part")], {"s1": F.col("h1"), "s2": F.col("h2")}, scratch, "hashes"), "summed")
    starts = summed.where("part = 0").select("conv_id", (F.col("s1") - F.col("h1")).alias("b1"), (F.col("s2") - F.col("h2")).alias("b2"))
    count = summed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    named = join_hot(summed, starts.join(count, "conv_id"), ["conv_id"], "n", summed.count())
    name = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string"))
    s1, s2 = F.col("s1") - F.col("b1"), F.col("s2") - F.col("b2")
    above = F.when(F.col("part") == 0, "").otherwise(name(s1 - F.col("h1"), s2 - F.col("h2")))
    named = named.select("conv_id", "part", above.alias("above"), F.when(F.col("part") < F.col("n") - 1, name(s1, s2)).alias("below"))
    return rows.join(named, ["conv_id", "part"], "left").select("conv_id", "part", "seq", "sizes", F.coalesce("above", F.lit("")).alias("above"), "below")


def common_turns(a: str, b: str) -> int:
    """Turns in which two rows' keys agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST  # of growing prefixes the last that agrees
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle)
    return low


@dataclass
class Component:
    """Rows left..right that agree in their first `depth` turns and no more; parent: its place in the list of components."""

    left: int
    right: int
    depth: int
    parent: int = -1


def forest(agree: np.ndarray) -> list[Component]:
    """The branching nodes of sorted rows: agree[i] turns are common to rows i and i + 1, below 0 if they are of different tries.

    Edges are taken by descending depth; each joins two components under a node of that depth, or adds one to a node that has it.
    """
    n = len(agree) + 1
    up, node_of, nodes = np.arange(n), [-1] * n, []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    for i in np.argsort(-agree, kind="stable"):
        depth = int(agree[i])
        if depth < 0:
            break
        a, b = find(int(i)), find(int(i) + 1)
        x, y = node_of[a], node_of[b]
        left = nodes[x].left if x >= 0 else a
        right = nodes[y].right if y >= 0 else b
        if x >= 0 and nodes[x].depth == depth:  # edges of one depth come in order, so only the left side has such a node
            nodes[x].right, top = right, x
            if y >= 0:
                nodes[y].parent = x
        else:
            nodes.append(Component(left, right, depth))
            top = len(nodes) - 1
            for z in (x, y):
                if z >= 0:
                    nodes[z].parent = top
        up[b] = a
        node_of[a] = top
    return nodes


def owners(agree: np.ndarray, inside: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each range (depth, range) steps: the nodes of up to that depth that hold its first row begin in that range, which is another.

    agree[p]: turns common to the last row of range p and the first of p + 1; inside[p]: least number common to neighbours in p. The
    ranges are contracted to their first and last rows and the same forest is built of these.
    """
    n = len(inside)
    edges = np.zeros(2 * n - 1, np.int64)
    edges[0::2], edges[1::2] = inside, agree
    nodes = forest(edges)
    deepest = _deepest(nodes, 2 * n)
    out = []
    for p in range(n):
        steps, at = [], int(deepest[2 * p])
        while at >= 0:
            start = nodes[at].left // 2
            if start < p:
                steps.append((nodes[at].depth, start))
            at = nodes[at].parent
        out.append(steps)
    return out


def _deepest(nodes: list[Component], n: int) -> np.ndarray:
    """Of each row the deepest node that holds it; -1 for none."""
    out = np.full(n, -1)
    for at in sorted(range(len(nodes)), key=lambda j: nodes[j].depth):
        out[nodes[at].left : nodes[at].right + 1] = at
    return out


def _sorted_ranges(rows: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """Rows by key in ranges, each with its place and the turns that it and the rows before and after have in common (agree, next).

    A range's first row has no agree and its last no next; these two keep their keys (edge).
    """
    order = ["part", "above", "seq", F.col("below").isNotNull(), "conv_id"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    schema = "range int, place long, conv_id long, part long, above string, below string, n int, sizes array<long>, agree int, next int, edge string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, agree = None, 0, None  # the row before, which waits for its next

        def done(row: dict, common: int | None) -> tuple:
            edge = row["seq"] if agree is None or common is None else None
            return (row["range"], place, row["conv_id"], row["part"], row["above"], row["below"], len(row["seq"]) // DIGEST, row["sizes"], agree, common, edge)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    common = common_turns(held["seq"], row["seq"]) if (held["part"], held["above"]) == (row["part"], row["above"]) else _NONE
                    out.append(done(held, common))
                    place, agree = place + 1, common
                held = row
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([done(held, None)])

    return scratch.save(dealt.mapInArrow(run, schema), "ranges")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_turns(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _joined(ranges: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[int, int], dict[int, list[tuple[int, int]]]]:
    """Rows with agree and next over the ranges' ends too, the bytes they share with the row before and whether they end in a leaf; of each
    range what is common before it, and its owners. A few numbers of each range come to the driver."""
    spark = ranges.sparkSession
    inner = {r["range"]: r["least"] for r in ranges.groupBy("range").agg(F.min("agree").alias("least")).collect()}
    order = sorted(inner)
    ends = ranges.where("edge IS NOT NULL").select("range", "part", "above", "edge", "agree", "next")
    follow = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "range int, after int")
    left, right = ends.where("next IS NULL").alias("x").join(F.broadcast(follow), "range"), ends.where("agree IS NULL").alias("y")  # as many rows as ranges
    both = left.join(right, F.col("after") == F.col("y.range")).where((F.col("x.part") == F.col("y.part")) & (F.col("x.above") == F.col("y.above")))
    found = {r["after"]: r["common"] for r in both.select("after", F.pandas_udf(_common, "int")("x.edge", "y.edge").alias("common")).collect()}
    agree = [found.get(p, _NONE) for p in order[1:]]
    big = np.iinfo(np.int32).max
    steps = owners(np.array(agree, np.int64), np.array([big if inner[p] is None else inner[p] for p in order], np.int64))
    before, after = dict(zip(order, [_NONE, *agree], strict=True)), dict(zip(order, [*agree, _NONE], strict=True))
    joins = spark.createDataFrame([(p, before[p], after[p]) for p in order], "range int, before int, after int")
    rows = ranges.join(F.broadcast(joins), "range").withColumns({"agree": F.coalesce("agree", "before"), "next": F.coalesce("next", "after")}).drop("before", "after", "edge")
    shared = F.aggregate(F.slice("sizes", 1, F.greatest(F.col("agree"), F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumns({"saved": shared, "leaf": (F.col("below").isNull() & (F.col("next") < F.col("n"))).cast("long")})
    nothing = F.lit(0).cast("long")
    if rows.where("part > 0").isEmpty():
        return rows.withColumns({"later_saved": nothing, "later_leaves": nothing}), before, {p: [(d, order[q]) for d, q in s] for p, s in zip(order, steps, strict=True)}
    # what a conversation's later parts share, and whether they end in a leaf: sums over the table from its end, less what they were before
    some = rows.where("below IS NOT NULL OR part > 0").select("conv_id", "part", "saved", "leaf")
    summed = scratch.save(running_sums(some, [F.desc("conv_id"), F.desc("part")], {"s": F.col("saved"), "l": F.col("leaf")}, scratch, "later"), "later_sums")
    per = summed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_parts"), F.max_by(F.struct((F.col("s") - F.col("saved")).alias("s"), (F.col("l") - F.col("leaf")).alias("l")), "part").alias("start"))
    later = join_hot(summed, per, ["conv_id"], "n_parts", summed.count())
    later = later.select("conv_id", "part", (F.col("s") - F.col("saved") - F.col("start.s")).alias("later_saved"), (F.col("l") - F.col("leaf") - F.col("start.l")).alias("later_leaves"))
    rows = rows.join(later, ["conv_id", "part"], "left").na.fill(0, ["later_saved", "later_leaves"])
    return rows, before, {p: [(d, order[q]) for d, q in s] for p, s in zip(order, steps, strict=True)}


KEY = ["part", "above", "depth", "owner", "start"]
#: Nodes and, with ids, pieces of the list of ids that end in an open node. up: the owner of the parent, where that is open.
_ROWS = "part long, above string, depth int, owner int, start long, open boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved long, parent_conv_id long, up int, below string, ends string, range int, chunk int, ids string"


def _range_nodes(rows: list[dict], before: int, steps: list[tuple[int, int]], whole: bool) -> Iterator[tuple]:
    """Rows of _ROWS of one trie's rows in a range; whole: it ends there.

    A node that holds the range's last row, or goes on from the range before, is open: what it has in several ranges adds up. It is
    named by the range in which it begins and start -1, as each range has one node of a depth at its end. Counts are sums over rows:
    a row begins a child below depth d if it has more than d turns and no more than d in common with the row before.
    """
    n, agree, conv = (np.array([r[c] for r in rows], np.int64) for c in ("n", "agree", "conv_id"))
    ended = np.array([r["below"] is None for r in rows], bool)
    first = 0 if rows[0]["part"] == 0 else 1  # a later part's trie has no root of its own
    part, above, own, last = rows[0]["part"], rows[0]["above"], rows[0]["range"], len(rows) - 1
    leaves = np.concatenate([[0], np.cumsum([r["leaf"] + r["later_leaves"] for r in rows])])
    shared = np.concatenate([[0], np.cumsum([r["saved"] for r in rows])])
    later = np.concatenate([[0], np.cumsum([r["later_saved"] for r in rows])])
    least = [conv]  # minima of 1, 2, 4 ... rows from each on
    while 2 << (len(least) - 1) <= len(conv):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))

    def smallest(left: int, right: int) -> int:
        k = (right - left + 1).bit_length() - 1
        return int(min(least[k][left], least[k][right + 1 - (1 << k)]))

    def owner(left: int, depth: int) -> int:
        return next(q for d, q in reversed(steps) if d >= depth) if left == 0 and before >= depth else own

    def is_open(left: int, right: int, depth: int) -> bool:
        return (right == last and not whole) or (left == 0 and before >= depth)

    def chain(left: int, right: int, top: int, depth: int, up: Component | None) -> Iterator[tuple]:
        """Nodes of depth top to depth over the rows left..right; up holds the parent of the first."""
        low, inside = smallest(left, right), slice(left, right + 1)
        upto = np.concatenate([[0], np.cumsum(np.array(rows[left]["sizes"], np.int64))])
        for d in range(top, depth + 1):
            deep, opens, mine = d == depth, is_open(left, right, d), owner(left, d) == own
            children = int(((agree[inside] <= d) & (n[inside] > d)).sum()) if deep else int(agree[left] <= d < n[left])
            # bytes that members have in common with those before them, from this depth on; the first of all has none
            skipped = int(upto[d - 1]) if d else 0
            saved = int(shared[right + 1] - shared[left] + later[right + 1] - later[left]) - (right - left + 1) * skipped
            saved -= int(rows[left]["saved"]) - skipped if mine else 0
            ends = conv[inside][(n[inside] == d) & ended[inside]] if deep else conv[:0]
            over = None if d <= first else (left, right) if d > top else (up.left, up.right)  # the first node of a later part hangs below an earlier part
            parent_open = over is not None and is_open(*over, d - 1)
            parent = smallest(*over) if over and not parent_open else None
            key = (part, above, d, owner(left, d), -1 if opens else left)
            digest = None if opens else hashlib.sha256(",".join(map(str, ends.tolist())).encode()).hexdigest()
            yield (*key, opens, low, right - left + 1, children, int(leaves[right + 1] - leaves[left]), saved, parent, owner(over[0], d - 1) if parent_open else None, rows[right]["below"] if deep and n[right] == d else None, digest, own, None, None)
            if opens:
                for i in range(0, len(ends), ENDS_BYTES // 8):
                    yield (*key, *[None] * 10, own, i // (ENDS_BYTES // 8), ",".join(map(str, ends[i : i + ENDS_BYTES // 8].tolist())))

    nodes = forest(agree[1:])
    for node in nodes:
        up = nodes[node.parent] if node.parent >= 0 else None
        yield from chain(node.left, node.right, up.depth + 1 if up else first, node.depth, up)
    for i, at in enumerate(_deepest(nodes, len(rows)).tolist()):  # below its deepest node a row goes on alone
        up = nodes[at] if at >= 0 else None
        yield from chain(i, i, up.depth + 1 if up else first, int(n[i]), up)


def _forests(rows: DataFrame, before: dict[int, int], steps: dict[int, list[tuple[int, int]]], parts: int, scratch: Scratch) -> DataFrame:
    """_range_nodes of every range and trie in it."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in _ROWS.split(", ")]
    used = ["range", "place", "conv_id", "part", "above", "below", "n", "agree", "saved", "leaf", "later_saved", "later_leaves", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for row in _trees(held, before, steps):
                out.append(row)
                if len(out) == 8192:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["range"] != row["range"]:
                    yield from flush(held)
                    held = []
                held.append(row)
        yield from flush(held)

    return scratch.save(rows.select(*used).repartition(parts, "range").sortWithinPartitions("range", "place").mapInArrow(run, _ROWS), "nodes")


def _trees(held: list[dict], before: dict[int, int], steps: dict[int, list[tuple[int, int]]]) -> Iterator[tuple]:
    """The tries of one range's rows. Only the first can go on from the range before, only the last into the next."""
    cuts = [0, *[i for i in range(1, len(held)) if held[i]["agree"] < 0], len(held)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            whole = b < len(held)  # a trie that ends within the range is closed on its right
            for row in _range_nodes(held[a:b], before[held[0]["range"]] if a == 0 else _NONE, steps[held[0]["range"]], whole):
                yield row


def _digests(pieces_of_ids: DataFrame, parts: int) -> DataFrame:
    """KEY and ends: the digest of the ids that end in each open node, read in order, a piece at a time.

    SHA-256 reads one byte after another, so a group's pieces go through one task: few rows of ENDS_BYTES each, none of them kept.
    """
    schema = "part long, above string, depth int, owner int, start long, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "ends"])

        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[c] for c in KEY)
                if here != key:
                    if key is not None:
                        yield done()
                    key, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
        if key is not None:
            yield done()

    return pieces_of_ids.repartition(parts, *KEY).sortWithinPartitions(*KEY, "range", "chunk").select(*KEY, "ids").mapInArrow(run, schema)


def prefix_trie(conversations: DataFrame, piece: int = PIECE, rebuild: bool = True) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as the contract of the query says. rebuild: conversations take their first turns from the first of their five.

    conv_id counts as a long and c - c % 5 is truncated towards 0. A null turn comes first and turns of one number follow by role and
    the text's SHA-256; null roles and texts are empty; rows without a conv_id belong to no conversation; repeated rows are turns of their own;
    texts and conversations of any length count whole; an empty table has no node, not even a root; columns beside the four, whatever
    their names, are not read.

    Conversations are sorted by their turns' 128-bit digests. The turns that sorted neighbours have in common are edges: in each
    range union-find takes them by descending depth, and every merge makes a branching node. Ranges are then contracted to their
    first and last rows, between which the same forest says where nodes go on, and nodes that lie in several ranges are added up.
    """
    spark = conversations.sparkSession
    ship(spark)
    scratch = Scratch(spark, "trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = _sorted_ranges(pieces(rebuilt(conversations, scratch, rebuild), scratch, piece), parts, scratch)
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if ranges.isEmpty():
        return spark.createDataFrame([], out)
    rows, before, steps = _joined(ranges, scratch)
    made = _forests(rows, before, steps, parts, scratch)
    found = made.where("ids IS NULL").drop("ids", "chunk", "range")
    empty = hashlib.sha256(b"").hexdigest()
    add = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = found.where("open").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *add, F.min("up").alias("up"), F.max("below").alias("below"))
    merged = merged.join(_digests(made.where("ids IS NOT NULL"), parts), KEY, "left").withColumn("ends", F.coalesce("ends", F.lit(empty)))
    merged = scratch.save(merged.withColumn("parent_conv_id", F.lit(None).cast("long")), "merged")
    columns = ["part", "above", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "up", "below", "ends"]
    nodes = found.where("NOT open").select(*columns).unionByName(merged.select(*columns))
    # parents that are open: a parent is met by as many rows as it has children, at most
    sure, asking = nodes.where("up IS NULL"), nodes.where("up IS NOT NULL")
    parents = merged.select("part", "above", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"), F.col("conv_id").alias("of"), F.col("n_children").alias("count"))
    told = join_hot(asking, parents, ["part", "above", "depth", "up"], "count", max(1, asking.count())).withColumn("parent_conv_id", F.col("of"))
    nodes = sure.select(*columns).unionByName(told.select(*columns))
    if not rows.where("part > 0").isEmpty():
        nodes = scratch.save(nodes, "parted")
        tops = nodes.where("part > 0 AND depth = 1")
        below = nodes.where("below IS NOT NULL").select("below", (F.col("part") + 1).alias("part"), F.col("conv_id").alias("of"))
        counted = tops.groupBy("part", "above").agg(F.count(F.lit(1)).alias("more"))
        hung = join_hot(tops, below.withColumnRenamed("below", "above").join(counted, ["part", "above"]), ["part", "above"], "more", max(1, tops.count())).withColumn("parent_conv_id", F.col("of")).select(*columns)
        rest = nodes.where("NOT (part > 0 AND depth = 1)")
        ends = counted.select((F.col("part") - 1).alias("part"), F.col("above").alias("below"), "more")
        nodes = hung.unionByName(rest).join(ends.hint("shuffle_merge"), ["part", "below"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).select(*columns)
    return nodes.select(
        "conv_id", (F.col("part") * piece + F.col("depth")).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix_trie over all `conversations`; its docstring gives the results for nulls, long conversations, ties, repeats and empty tables."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY k) AS xs FROM t GROUP BY conv_id),
c AS (SELECT conv_id, xs, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, z: xor(p >> 1, 3988292384 * (p & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS h FROM o),
m AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) AS xs FROM c LEFT JOIN o b ON b.conv_id = c.base),
p AS (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS d FROM m),
n AS MATERIALIZED (SELECT d, CASE WHEN d = 0 THEN NULL ELSE xs[1:d] END AS s, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(xs) = d) AS ends FROM p GROUP BY ALL),
q AS MATERIALIZED (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(strlen(n.s[n.d].t), 0) AS bytes, row_number() OVER () AS id FROM n LEFT JOIN n u ON u.d = n.d - 1 AND (n.d = 1 OR u.s = n.s[1:n.d - 1])),
k AS (SELECT d, s, count(*) AS n_children FROM (SELECT d - 1 AS d, CASE WHEN d = 1 THEN NULL ELSE s[1:d - 1] END AS s FROM q WHERE d > 0) GROUP BY ALL),
w AS MATERIALIZED (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN k ON k.d = q.d AND k.s IS NOT DISTINCT FROM q.s),
up AS (SELECT CASE WHEN a = 0 THEN NULL ELSE s[1:a] END AS s, a AS d, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY ALL)
SELECT conv_id, CAST(w.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN up ON up.d = w.d AND up.s IS NOT DISTINCT FROM w.s
"""
