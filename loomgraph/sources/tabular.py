"""A provider that compiles relational tables into the graph.

Regions are routes, nations and customers components, parts apis, brands contexts, suppliers files; order priorities are hooks
that customers use, market segments hooks that nobody uses; states of orders and lines are channels that suppliers invoke and
nations' native sides handle. Every line of lineitem counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import Graph
from loomgraph.scratch import Scratch, partitioned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _route(column: str = "r_name"):
    return F.concat(F.lit("/"), F.replace(F.lower(column), F.lit(" "), F.lit("-")))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order's columns (`ordered`: whether it has an order) and `following`: the supplier of the order's next line, if it is
    another one of the same nation. Lines are shuffled and sorted once for both.
    """
    home = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").join(home, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    lines = lines.withColumn("at", F.when(F.col("s_suppkey").isNotNull(), F.struct("l_suppkey", "s_nationkey")))
    lines = lines.withColumn("next", F.expr("lead(at) IGNORE NULLS OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"))
    imports = (F.col("at.l_suppkey") != F.col("next.l_suppkey")) & (F.col("at.s_nationkey") == F.col("next.s_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.lit(True).alias("ordered"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("ordered", "o_custkey", "o_orderpriority", "o_orderstatus", "l_partkey", "l_suppkey", "l_shipdate", F.when(imports, F.col("next.l_suppkey")).alias("following"))


def _before(lines: DataFrame, until: str | None) -> DataFrame:
    return lines.where(F.col("l_shipdate") < F.lit(until).cast("timestamp")) if until else lines


def _place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def _handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of nations that handle the channels of their suppliers' line states."""
    flags = table(spark, sf_dir, "lineitem").select("l_suppkey", F.explode(F.array("l_linestatus", "l_returnflag")).alias("flag")).distinct()
    flags = flags.join(_place(spark, sf_dir).select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return flags.select(_id("native/", "n_name").alias("src"), _id("channel:status/", "flag").alias("dst")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def table_nodes(spark: SparkSession, sf_dir: str, until: str | None = None, called_only: bool = False) -> DataFrame:
    """The graph's nodes. No edges are made for them: which parts are called and which states are invoked follows from keys."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier, part, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders", "lineitem"))
    hooks = orders.select(F.col("o_orderpriority").alias("hook")).unionByName(customer.select(F.col("c_mktsegment").alias("hook")))
    invoked = orders.join(lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(_id("channel:status/", "o_orderstatus").alias("dst"))
    empty = {"file": "string", "loc": "int", "shape": "string", "declared": "boolean"}

    def nodes(df: DataFrame, kind: str, **columns) -> DataFrame:
        columns = {c: F.lit(None) for c in empty} | columns
        return df.select(columns.pop("id").alias("id"), F.lit(kind).alias("type"), columns.pop("name").alias("name"), *[columns[c].cast(t).alias(c) for c, t in empty.items()])

    called = part
    if called_only:
        lines = _before(lineitem, until).join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        called = part.join(lines.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    shape = F.substring(F.sha1(F.concat_ws(">", "c_mktsegment", F.col("c_nationkey").cast("string"))), 1, 12)
    return _union([
        nodes(region, "route", id=F.concat(F.lit("route:"), _route()), name=_route(), file=F.lit("region")),
        nodes(nation, "component", id=_id("nation#", "n_name"), name=F.col("n_name"), file=F.lit("nation")),
        nodes(customer, "component", id=_id("customer#", "c_custkey"), name=F.col("c_name"), file=F.lit("customer"), loc=F.greatest(F.lit(1), F.floor(F.col("c_acctbal") / 60)), shape=shape),
        nodes(called, "api", id=_id("api:GET /part/", "p_partkey"), name=_id("GET /part/", "p_partkey"), declared=F.col("p_size") > 25),
        nodes(called.select("p_brand").distinct(), "context", id=_id("brand#", "p_brand"), name=F.col("p_brand"), file=F.lit("brand")),
        nodes(supplier, "file", id=_id("supplier/", "s_suppkey"), name=F.col("s_name"), file=_id("supplier/", "s_suppkey")),
        nodes(part.where("p_size > 40"), "api", id=_id("api:POST /part/", "p_partkey"), name=_id("POST /part/", "p_partkey"), declared=F.lit(True)),
        nodes(nation, "api", id=_id("api:GET /:method/part/", "n_nationkey"), name=_id("GET /:method/part/", "n_nationkey")),
        nodes(hooks.distinct(), "hook", id=_id("hook#use", "hook"), name=_id("use", "hook"), file=F.lit("hook")),
        nodes(nation, "native", id=_id("native/", "n_name"), name=F.col("n_name"), file=_id("native/", "n_name")),
        nodes(invoked.unionByName(_handled(spark, sf_dir).select("dst")).distinct(), "channel", id=F.col("dst"), name=F.regexp_replace("dst", "^channel:", "")),
    ])


def table_edges(spark: SparkSession, sf_dir: str, lines: DataFrame, until: str | None = None) -> dict[str, list[DataFrame]]:
    """src and dst of the graph's edges by kind. lines: joined_lines. Keys are made distinct as numbers, before ids are made of them."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    place = _place(spark, sf_dir)
    calls = _before(lines.where("ordered"), until)
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    route = place.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.concat(F.lit("route:"), _route()).alias("dst"))
    # one shuffle by part gives the brands of callers and of their orders' priorities
    none = lambda c: F.lit(None).cast(calls.schema[c].dataType).alias(c)
    user = F.explode(F.array(F.struct(F.lit(True).alias("own"), "o_custkey", none("o_orderpriority")), F.struct(F.lit(False).alias("own"), none("o_custkey"), "o_orderpriority"))).alias("user")
    branded = calls.select("o_custkey", "o_orderpriority", "l_partkey").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    branded = branded.select(user, "p_brand").select("user.*", "p_brand").distinct().hint("rebalance", "o_custkey")
    return {
        "routes_to": [nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("route:"), _route()).alias("src"), _id("nation#", "n_name").alias("dst"))],
        "renders": [located.select(_id("nation#", "n_name").alias("src"), _id("customer#", "c_custkey").alias("dst"))],
        "calls": [
            calls.select("o_custkey", "l_partkey").distinct().hint("rebalance", "o_custkey").select(_id("customer#", "o_custkey").alias("src"), _id("api:GET /part/", "l_partkey").alias("dst")),
            nation.select(_id("nation#", "n_name").alias("src"), _id("api:GET /:method/part/", "n_nationkey").alias("dst")),
        ],
        "uses": [
            branded.select(F.when(F.col("own"), _id("customer#", "o_custkey")).otherwise(_id("hook#use", "o_orderpriority")).alias("src"), _id("brand#", "p_brand").alias("dst")),
            calls.select("o_custkey", "o_orderpriority").distinct().hint("rebalance", "o_custkey").select(_id("customer#", "o_custkey").alias("src"), _id("hook#use", "o_orderpriority").alias("dst")),
        ],
        "invokes": [lines.where("ordered").select("l_suppkey", "o_orderstatus").distinct().select(_id("supplier/", "l_suppkey").alias("src"), _id("channel:status/", "o_orderstatus").alias("dst"))],
        "handles": [_handled(spark, sf_dir)],
        "imports": [lines.where("following IS NOT NULL").select("l_suppkey", "following").distinct().select(_id("supplier/", "l_suppkey").alias("src"), _id("supplier/", "following").alias("dst"))],
        "defines": [place.select(_id("supplier/", "s_suppkey").alias("src"), _id("nation#", "n_name").alias("dst"))],
        "navigates_to": [calls.select("o_custkey", "l_suppkey").join(route, F.col("l_suppkey") == F.col("s_suppkey")).select("o_custkey", "dst").distinct().hint("rebalance", "o_custkey").select(_id("customer#", "o_custkey").alias("src"), "dst")],
    }


def edges_of(parts: list[DataFrame], kind: str) -> DataFrame:
    """A kind's edges. A call of a path with a wildcard is known by its shape only, hence its confidence."""
    return _union(parts).select("src", "dst", F.lit(kind).alias("kind"), F.when(F.col("dst").startswith("api:GET /:"), 0.8).alias("confidence"))


def compile_tables(spark: SparkSession, sf_dir: str, until: str | None = None, called_only: bool = False) -> Graph:
    """The graph of all lines, or of those shipped before `until`; called_only leaves out parts and brands that nobody calls."""
    edges = table_edges(spark, sf_dir, joined_lines(spark, sf_dir), until)
    return Graph(table_nodes(spark, sf_dir, until, called_only), _union([edges_of(parts, kind) for kind, parts in edges.items()]))


class TableGraph(Graph):
    """compile_tables with what is asked for as written tables: the nodes, and the edges of each kind, when they are first read.

    Edges lie by src, a hot one in several files, and sorted in each file, so a reader of few sources skips most of them. lines: gives joined_lines as a written table.
    whole: gives the folder's graph of all lines; kinds that are the same in it are read from there.
    """

    written = True
    #: Kinds of which `until` leaves edges out.
    dated: ClassVar[tuple[str, ...]] = ("calls", "uses", "navigates_to")
    ends: ClassVar[dict[str, tuple[set[str], set[str]]]] = {
        "routes_to": ({"route"}, {"component"}), "renders": ({"component"}, {"component"}), "calls": ({"component"}, {"api"}), "uses": ({"component", "hook"}, {"context", "hook"}),
        "invokes": ({"file"}, {"channel"}), "handles": ({"native"}, {"channel"}), "imports": ({"file"}, {"file"}), "defines": ({"file"}, {"component"}), "navigates_to": ({"component"}, {"route"}),
    }

    def __init__(self, spark: SparkSession, sf_dir: str, lines: Callable[[], DataFrame], until: str | None = None, called_only: bool = False, whole: Callable[[], Graph] | None = None):
        for name, value in (("_spark", spark), ("_sf", sf_dir), ("_lines", lines), ("_until", until), ("_called", called_only), ("_whole", whole), ("_kinds", {}), ("_parts", {}), ("_scratch", Scratch(spark, "graph"))):
            object.__setattr__(self, name, value)

    @cached_property
    def nodes(self) -> DataFrame:
        with partitioned(self._spark, [f"{self._sf}/lineitem.parquet"]):
            return self._scratch.save(table_nodes(self._spark, self._sf, self._until, self._called))

    @property
    def edges(self) -> DataFrame:
        return self.of_kinds(*self.ends)

    def of_kinds(self, *kinds: str) -> DataFrame:
        for kind in kinds:
            if kind not in self.ends or kind in self._kinds:
                continue
            if self._whole and not (self._until and kind in self.dated):
                self._kinds[kind] = self._whole().of_kinds(kind)
            else:
                of_lines = kind in ("calls", "uses", "invokes", "imports", "navigates_to")
                if of_lines not in self._parts:  # plans only; those of other kinds don't read lines
                    self._parts[of_lines] = table_edges(self._spark, self._sf, self._lines() if of_lines else joined_lines(self._spark, self._sf), self._until)
                with partitioned(self._spark, [f"{self._sf}/lineitem.parquet"]):
                    rows = edges_of(self._parts[of_lines][kind], kind)
                    self._kinds[kind] = self._scratch.save(rows.sortWithinPartitions("src", "dst"))
        known = [self._kinds[k] for k in kinds if k in self._kinds]
        return _union(known) if known else self._spark.createDataFrame([], "src string, dst string, kind string, confidence double")
