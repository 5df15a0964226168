"""Global positions in an order, by ranges: no task holds more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import Graph
from loomgraph.scratch import Scratch

#: The Unicode root collation, in which answers are listed.
COLLATION = "UNICODE"
#: Plain characters as the collation orders them, case apart: blanks, signs, digits, letters.
_PLAIN = "\t\n\v\f\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789abcdefghijklmnopqrstuvwxyz"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def positions(df: DataFrame, order: list[Column], name: str = "position", scratch: Scratch | None = None) -> DataFrame:
    """Adds the dense 0-based place of each row in the order of all rows; rows that tie in it follow in any order.

    Rows are dealt by ranges of the order and written. Each range numbers its own rows, to which the counts of the ranges before,
    as many numbers as there are ranges, are added.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "order")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts, before, total = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()), [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(offsets, "_range").select(*df.columns, (F.col("_within") + F.col("_before")).alias(name))


def collated(df: DataFrame, *columns: str) -> list[Column]:
    """What orders rows by the columns in the Unicode root collation, and what it holds equal by bytes.

    Where all values are of plain characters that is a key of bytes: each character's place in the collation, then the case of each.
    A comparison by collation takes some ten times as long as one of bytes, so it is left to tables that have other characters.
    """
    plain = [F.coalesce(F.col(c).rlike(r"^[\x09-\x0D\x20-\x7E]*$"), F.lit(True)) for c in columns]
    if not df.where(~F.forall(F.array(*plain), lambda x: x)).isEmpty():
        return [F.collate(c, COLLATION) for c in columns] + [F.col(c) for c in columns]
    places = "".join(chr(0x21 + i) for i in range(len(_PLAIN)))
    letter = lambda c: F.translate(F.col(c), _PLAIN + _UPPER, places + places[-26:])
    case = lambda c: F.translate(F.col(c), _PLAIN + _UPPER, "0" * len(_PLAIN) + "1" * 26)
    return [key for c in columns for key in (letter(c), case(c))]


def in_order(graph: Graph) -> Graph:
    """Nodes with their position by id and edges with theirs by (src, kind, dst), in the Unicode root collation. [PRV-08, SRT-01]

    Ids that the collation holds equal follow by their bytes.
    """
    return Graph(nodes_in_order(graph), edges_in_order(graph))


def nodes_in_order(graph: Graph) -> DataFrame:
    return positions(graph.nodes, collated(graph.nodes, "id"))


def edges_in_order(graph: Graph) -> DataFrame:
    return positions(graph.edges, collated(graph.edges, "src", "kind", "dst"))
