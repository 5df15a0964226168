"""A graph kept up to date by counts of derivations: changed files add and take away, and only what a change touches is derived anew.

Facts of files (path, fact, name, target): `node` declares a node name of type target, `route` a route target, `import` a use of the
file target, `nav` a navigation from node name to path target. Nodes and edges have as many derivations as facts give them, and
exist while they have any. Facts, nodes and edges are logs of signed counts by micro-batch: a batch appends what it changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import same_shape, segments
from loomgraph.schema import Graph
from loomgraph.sources.pages import canonical_routes

CHANGES = "seq long, path string, op string, facts array<struct<fact:string,name:string,target:string>>"
#: Batches after which a log is summed into one table.
COMPACT = 16
_KEYS = {"facts": ["path", "fact", "name", "target"], "nodes": ["id", "type"], "edges": ["src", "kind", "dst"]}
_TYPES = {"facts": "path string, fact string, name string, target string, n long", "nodes": "id string, type string, n long", "edges": "src string, kind string, dst string, n long"}


class Store:
    """The three logs under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _batches(self, table: str, what: str, before: int) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{what}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit() and int(x) < before)

    def rows(self, table: str, before: int = 1 << 60) -> DataFrame:
        """The log of all batches before one: keys with counts that sum to n."""
        full = self._batches(table, "full", before)
        paths = [f"{self.folder}/{table}/full/{x}" for x in full[-1:]] + [f"{self.folder}/{table}/delta/{x}" for x in self._batches(table, "delta", before) if not full or x > full[-1]]
        return self.spark.read.schema(_TYPES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _TYPES[table])

    def read(self, table: str, before: int = 1 << 60) -> DataFrame:
        """Keys and n, above 0, of all batches before one."""
        return self.rows(table, before).groupBy(*_KEYS[table]).agg(F.sum("n").alias("n")).where("n > 0")

    def append(self, table: str, delta: DataFrame, batch: int) -> DataFrame:
        """Writes a batch's changes; a batch that runs again replaces them. Returns them as written."""
        path = f"{self.folder}/{table}/delta/{batch}"
        delta.groupBy(*_KEYS[table]).agg(F.sum("n").alias("n")).where("n != 0").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_TYPES[table]).parquet(path)

    def keep(self, what: str, df: DataFrame) -> DataFrame:
        """Writes a table that is read while its batch runs; the next batch's takes its place."""
        path = f"{self.folder}/batch/{what}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, batch: int) -> None:
        if (batch + 1) % COMPACT == 0:
            for table in _KEYS:
                self.read(table, batch + 1).write.mode("overwrite").parquet(f"{self.folder}/{table}/full/{batch}")

    def graph(self) -> Graph:
        return Graph(self.read("nodes"), self.read("edges"))


def _nodes(facts: DataFrame) -> DataFrame:
    """Derivations of nodes by facts (with n): declared nodes, routes, and the files that have facts."""
    own = facts.where("fact = 'node'").select(F.col("name").alias("id"), F.col("target").alias("type"), "n")
    routes = facts.where("fact = 'route'").select(F.concat(F.lit("route:"), "target").alias("id"), F.lit("route").alias("type"), "n")
    files = facts.where("fact = 'file'").select(F.col("path").alias("id"), F.lit("file").alias("type"), "n")
    return own.unionByName(routes).unionByName(files)


def _of(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def _standing(before: DataFrame, new: DataFrame) -> DataFrame:
    """id, was and is: whether a node was there by the log's rows before and is with the new ones."""
    zero = F.lit(0).cast("long")
    rows = before.select("id", F.col("n").alias("old"), zero.alias("new")).unionByName(new.select("id", zero.alias("old"), F.col("n").alias("new")))
    return rows.groupBy("id").agg((F.sum("old") > 0).alias("was"), (F.sum("old") + F.sum("new") > 0).alias("is"))


def _imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of import facts whose target is among the files (target, and sign, by which n is multiplied)."""
    met = facts.where("fact = 'import'").join(files, "target")
    return met.select(F.col("path").alias("src"), F.lit("imports").alias("kind"), F.col("target").alias("dst"), (F.col("n") * F.col("sign")).alias("n"))


def _navigation(facts: DataFrame, meant: DataFrame) -> DataFrame:
    """Edges of nav facts, each to the routes that its target means (target, route and sign)."""
    met = facts.where("fact = 'nav'").join(meant, "target")
    return met.select(F.col("name").alias("src"), F.lit("navigates_to").alias("kind"), F.concat(F.lit("route:"), "route").alias("dst"), (F.col("n") * F.col("sign")).alias("n"))


def _met(targets: DataFrame, routes: DataFrame) -> DataFrame:
    """The targets that agree in shape with any of the routes."""
    shaped = routes.select("route").withColumn("b", segments(F.col("route"))).withColumn("size", F.size("b"))
    targets = targets.withColumn("a", segments(F.col("target"))).withColumn("size", F.size("a"))
    # a literal first segment meets its equals and wildcards, so the shapes need no cross join
    first = lambda s: F.when(F.get(s, F.lit(0)).startswith(":"), "*").otherwise(F.coalesce(F.get(s, F.lit(0)), F.lit("")))
    asked = targets.withColumn("k", F.explode(F.array_distinct(F.array(first(F.col("a")), F.lit("*")))))
    met = asked.join(shaped.withColumn("k", first(F.col("b"))), ["size", "k"]).where(same_shape(F.col("a"), F.col("b"))).select("target")
    open_ones = targets.where(first(F.col("a")) == "*").join(shaped, "size").where(same_shape(F.col("a"), F.col("b"))).select("target")
    return met.unionByName(open_ones).distinct()


def refresh(store: Store, changes: DataFrame, batch: int) -> None:
    """Brings the graph up to date with a batch of changes (CHANGES; op `put` or `delete`; the last of a path counts). [PRV-10..PRV-12, STM-05]

    Edges are sums over the facts' log, so a batch adds those of its own changes as the files and routes are now, and for what the log
    held before only the difference: imports whose target file came or went, and navigations whose target agrees in shape with a route
    that came or went and means another one now. No log of facts is summed for it.
    """
    last = changes.groupBy("path").agg(F.max_by(F.struct("op", "facts"), "seq").alias("c")).select("path", "c.op", "c.facts")
    taken = store.keep("taken", last)
    puts, one = taken.where("op = 'put'"), F.lit(1).cast("long")
    given = puts.select("path", F.inline("facts")).unionByName(puts.select("path", F.lit("file").alias("fact"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("target")))
    log, known = store.rows("facts", batch), store.rows("nodes", batch)
    gone = log.join(taken.select("path"), "path", "left_semi").withColumn("n", -F.col("n"))
    delta = store.append("facts", given.withColumn("n", one).unionByName(gone), batch)
    nodes = store.append("nodes", _nodes(delta), batch)

    # files that came or went, and those that the batch's imports mean
    new = _of(nodes, "file")
    moved = _standing(_of(known, "file").join(new.select("id"), "id", "left_semi"), new).where("was != is").select(F.col("id").alias("target"), F.when(F.col("is"), 1).otherwise(-1).alias("sign"))
    asked = delta.where("fact = 'import'").select(F.col("target").alias("id")).distinct()
    there = _standing(*[_of(df, "file").join(asked, "id", "left_semi") for df in (known, nodes)]).where("is").select(F.col("id").alias("target"), F.lit(1).alias("sign"))

    # what the targets of its navigations mean, and those of before that a moved route may give another meaning
    routes = store.keep("routes", _standing(_of(known, "route"), _of(nodes, "route")).select(F.regexp_replace("id", "^route:", "").alias("route"), "was", "is"))
    navs = [df.where("fact = 'nav'").select("target", F.lit(fresh).alias("fresh")) for df, fresh in ((delta, True), (log, False))]
    targets = store.keep("targets", navs[0].unionByName(navs[1]).groupBy("target").agg(F.bool_or("fresh").alias("fresh"), F.bool_or(~F.col("fresh")).alias("old")))
    shapes = store.keep("shapes", _met(targets.where("old").select("target"), routes.where("was != is")))
    meaning = lambda df, at, sign: canonical_routes(df, routes.where(at)).select("target", "route", F.lit(sign).alias("sign"))
    turned = meaning(shapes, "is", 1).unionByName(meaning(shapes, "was", -1)).groupBy("target", "route").agg(F.sum("sign").alias("sign")).where("sign != 0")

    edges = [_imports(delta, there), _imports(log, moved), _navigation(delta, meaning(targets.where("fresh"), "is", 1)), _navigation(log, turned)]
    store.append("edges", reduce(DataFrame.unionByName, edges), batch)
    store.compact(batch)


def follow(spark: SparkSession, source: str, folder: str, files_per_batch: int) -> Store:
    """Takes all change files (Parquet, CHANGES) of a folder, a few a micro-batch, and keeps the graph in `folder` up to date."""
    store = Store(spark, folder)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, number: refresh(store, rows, number)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store
