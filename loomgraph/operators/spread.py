"""Reachability of many starts at once, as bits: one row a node, however many starts reach it.

Starts are numbered and dealt to blocks of BLOCK of them; a node's row holds one bit for each start of a block, in as few 64-bit words
as the block needs. A round sends only the bits that are new at a node along its edges and adds them up by `bit_or`, so a node that
millions of edges enter is combined before it is shuffled. Counts per start are taken from patterns: nodes with equal words
are counted together and only the distinct patterns are taken apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.operators.order import positions
from loomgraph.scratch import Scratch

WORD, BLOCK = 64, 1024


@dataclass(frozen=True)
class Reached:
    """nodes: node, own0.. (bits of the starts that begin here) and got0.. (bits of other starts that come here). starts: start and bit,
    at most BLOCK of them."""

    nodes: DataFrame
    starts: DataFrame
    words: int

    def bits(self, own: bool = False) -> list[Column]:
        """The words of a node: of what comes here, with own of what begins here too."""
        return [(F.col(f"got{i}").bitwiseOR(F.col(f"own{i}")) if own else F.col(f"got{i}")).alias(f"bits{i}") for i in range(self.words)]


def bit_names(words: int) -> list[str]:
    return [f"bits{i}" for i in range(words)]


def set_bits(words: int) -> Column:
    """The numbers of the bits set in bits0.., ascending."""
    listed = ", ".join(bit_names(words))
    return F.expr(f"filter(sequence(0, {words * WORD - 1}), i -> bit_get(array({listed})[CAST(i DIV {WORD} AS INT)], CAST(i % {WORD} AS INT)) = 1)")


def how_many(words: int) -> Column:
    return sum((F.bit_count(c) for c in bit_names(words)), F.lit(0)).cast("long")


def per_start(rows: DataFrame, reached: Reached, keys: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """start, the keys and n (or the sums) over the rows (bits0.., keys) in which the start's bit is set.

    Rows are added up by pattern of words first; a pattern's starts are taken apart after that, and added up by start.
    """
    sums = sums or {"n": F.lit(1)}
    patterns = rows.groupBy(*bit_names(reached.words), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = patterns.select(F.explode(set_bits(reached.words)).alias("bit"), *keys, *sums)
    added = each.groupBy("bit", *keys).agg(*[F.sum(n).alias(n) for n in sums])
    return added.join(F.broadcast(reached.starts), "bit").select("start", *keys, *sums)


def pushed(rows: DataFrame, words: int, to: str) -> DataFrame:
    """The bits of rows (bits0..) combined at their column `to`: what starts reach each of these ends."""
    return rows.groupBy(to).agg(*[F.bit_or(c).alias(c) for c in bit_names(words)])


def _numbered(names: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """start and its number in order, and how many there are. Up to BLOCK of them are numbered in one task, more by ranges."""
    names = scratch.save(names)
    total = names.count()
    if total > BLOCK:
        return scratch.save(positions(names, [F.col("start")], "number", scratch)), total
    return names.select("start", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start")) - 1).cast("long").alias("number")), total


@dataclass(frozen=True)
class _Block:
    step: DataFrame
    seeds: DataFrame
    starts: DataFrame
    words: int
    scratch: Scratch


def _blocks(edges: DataFrame, starts: DataFrame, reverse: bool, written: bool) -> Iterator[_Block]:
    scratch = Scratch(edges.sparkSession, "spread")
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node != next")
    step = step if written else scratch.save(step)
    seeds = scratch.save(starts.select("start", "node").where("start IS NOT NULL AND node IS NOT NULL").distinct())
    numbers, total = _numbered(seeds.select("start").distinct(), scratch)
    for first in range(0, total, BLOCK):
        block = numbers.where((F.col("number") >= first) & (F.col("number") < first + BLOCK)).select("start", (F.col("number") - first).cast("int").alias("bit"))
        words = -(-min(BLOCK, total - first) // WORD)
        yield _Block(step, seeds.join(F.broadcast(block), "start"), scratch.save(block), words, scratch)


def spread(edges: DataFrame, starts: DataFrame, reverse: bool = False, known: DataFrame | None = None, most_rounds: int | None = None, written: bool = False) -> Iterator[Reached]:
    """What each start (start, node; a start may have several nodes) reaches by edges (src, dst), a block of starts at a time.

    reverse: against the edges. known: ids from which the walk goes on, beside the starts' nodes; others are reached but lead no
    further. most_rounds: edges that a walk may take. written: the edges are a table; else they are written for the rounds. Null
    starts and nodes are left out.
    """
    known = None if known is None else known.select(F.col("id").alias("node"))
    for block in _blocks(edges, starts, reverse, written):
        for state in _rounds(block, known, most_rounds):
            pass
        yield Reached(state.drop(*[f"new{i}" for i in range(block.words)]), block.starts, block.words)


def levels(edges: DataFrame, starts: DataFrame, reverse: bool = False, most_rounds: int | None = None, written: bool = False) -> Iterator[tuple[DataFrame, int, Iterator[DataFrame]]]:
    """Of each block its starts (start, bit), its number of words, and level by level, from the starts' own nodes on, node and
    bits0..: the starts that first come to a node there. A level is walked when it is asked for."""
    for block in _blocks(edges, starts, reverse, written):
        news = [F.col(f"new{i}").alias(f"bits{i}") for i in range(block.words)]
        yield block.starts, block.words, (x.where(F.exists(F.array(*news), lambda b: b != 0)).select("node", *news) for x in _rounds(block, None, most_rounds))


def has_bit(words: int, bit: str = "bit") -> Column:
    """Whether the bit of a column's number is set in bits0..."""
    return F.expr(f"bit_get(array({', '.join(bit_names(words))})[{bit} DIV {WORD}], CAST({bit} % {WORD} AS INT)) = 1")


def _rounds(block: _Block, known: DataFrame | None, most_rounds: int | None) -> Iterator[DataFrame]:
    """node, own0.., got0.. and new0.. (bits that came in the last round) at first and after each round, to the one that moves nothing."""
    step, words, scratch = block.step, block.words, block.scratch
    zero = F.lit(0).cast("long")
    mask = [F.bit_or(F.when(F.expr(f"bit DIV {WORD}") == i, F.expr(f"shiftleft(1L, bit % {WORD})")).otherwise(zero)) for i in range(words)]
    state = block.seeds.groupBy("node").agg(*[m.alias(f"own{i}") for i, m in enumerate(mask)])
    state = scratch.save(state.select("*", *[zero.alias(f"got{i}") for i in range(words)], *[F.col(f"own{i}").alias(f"new{i}") for i in range(words)]))
    yield state
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        news = [F.col(f"new{i}") for i in range(words)]
        front = state.where(F.exists(F.array(*news), lambda x: x != 0)).select("node", *news)
        if known is not None and rounds > 1:  # a start's own node leads on whether it is known or not
            front = front.join(known, "node", "left_semi")
        sent = front.join(step, "node").groupBy(F.col("next").alias("node")).agg(*[F.bit_or(f"new{i}").alias(f"sent{i}") for i in range(words)])
        both = state.join(sent, "node", "full_outer")
        value = lambda kind, i: F.coalesce(F.col(f"{kind}{i}"), zero)
        fresh = [value("sent", i).bitwiseAND(F.bitwise_not(value("own", i).bitwiseOR(value("got", i)))) for i in range(words)]
        seen = Observation()
        after = both.select("node", *[value("own", i).alias(f"own{i}") for i in range(words)], *[value("got", i).bitwiseOR(fresh[i]).alias(f"got{i}") for i in range(words)], *[fresh[i].alias(f"new{i}") for i in range(words)])
        state = scratch.save(after.observe(seen, F.count_if(F.exists(F.array(*[F.col(f"new{i}") for i in range(words)]), lambda x: x != 0)).alias("moved")))
        yield state
        if not seen.get["moved"]:
            break
