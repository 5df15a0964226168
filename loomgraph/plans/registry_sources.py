"""Registered queries of the sources that Spark reads by name, over files that are written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import ledger
from loomgraph.plans.project import files_sql, source_files
from loomgraph.plans.registry import query
from loomgraph.scratch import Scratch
from loomgraph.sources import readers
from loomgraph.sources.tabular import table

_READ = "path NOT LIKE 'node_modules/%'"


def _tree(spark: SparkSession, name: str) -> str:
    readers.register(spark)
    return Scratch(spark, name).path


def _write(files: DataFrame, root: str) -> None:
    """Files are dealt to tasks by number: Spark goes by bytes, of which small files have few, so that one task would write them all."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    files.repartition(tasks, "path").write.format("source_tree").mode("append").save(root)


@query(files_sql() + f"SELECT path, sha1(content) AS hash, CAST(len(content) AS BIGINT) AS n_chars FROM files WHERE {_READ}", prefix="")
def tree_files(spark, sf):
    """A tree written and read by the source of that name; folders that are skipped aren't entered. [API-01, SRC-01, SRC-02]"""
    root = _tree(spark, "tree")
    _write(source_files(spark, sf), root)
    return spark.read.format("source_tree").option("bytesPerTask", 1 << 20).load(root).select("path", "hash", F.length("content").cast("long").alias("n_chars"))


@query(files_sql() + "SELECT path, sha1(content) AS hash FROM files WHERE path LIKE 'lib/%' AND path LIKE '%.dart'", prefix="")
def tree_files_chosen(spark, sf):
    """Only files whose path passes the filters are opened. [API-01, SRC-05]"""
    root = _tree(spark, "tree")
    _write(source_files(spark, sf), root)
    return spark.read.format("source_tree").load(root).where(F.startswith("path", F.lit("lib/")) & F.endswith("path", F.lit(".dart"))).select("path", "hash")


@query(
    files_sql()
    + f"SELECT path, CASE WHEN path LIKE 'server/%' THEN CAST(2 AS BIGINT) ELSE 1 END AS versions, sha1(CASE WHEN path LIKE 'server/%' THEN content || '// changed' ELSE content END) AS hash FROM files WHERE {_READ}",
    prefix="",
)
def tree_files_stream(spark, sf):
    """A tree followed while it grows: page by page first, then all else, then server files again, changed. [API-01, STM-05]

    A path's last version is that of its newest batch; how many versions were seen shows that what hasn't changed isn't read again.
    """
    root = _tree(spark, "tree-stream")
    scratch = Scratch(spark, "tree-versions")
    files = Scratch(spark, "tree-files").save(source_files(spark, sf).select("path", "content"))
    app = F.startswith("path", F.lit("app/"))
    server = F.startswith("path", F.lit("server/"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("path", "hash", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{scratch.path}/versions/number={number}")

    _write(files.where(app), root)
    stream = spark.readStream.format("source_tree").option("settle", 0).load(root)
    running = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{scratch.path}/position").start()
    try:
        running.processAllAvailable()
        for later in (files.where(~app), files.where(server).withColumn("content", F.concat("content", F.lit("// changed")))):
            _write(later, root)
            running.processAllAvailable()
    finally:
        running.stop()
    versions = spark.read.schema("path string, hash string, batch int").parquet(*[f"{scratch.path}/versions"])
    return versions.groupBy("path").agg(F.countDistinct("hash").alias("versions"), F.max_by("hash", "batch").alias("hash"))


@query(
    "SELECT 'p' || p_partkey || '.png' AS path, 'image/png' AS mime, CAST(33 AS BIGINT) AS length, w AS width, h AS height, CAST(CASE WHEN w <= 384 AND h <= 384 THEN 258 ELSE ceil(w / 768.0) * ceil(h / 768.0) * 258 END AS BIGINT) AS tokens FROM (SELECT p_partkey, CAST(p_size * 60 AS INT) AS w, CAST(200 + p_partkey % 1000 AS INT) AS h FROM part)",
    prefix="",
)
def image_files(spark, sf):
    """Images read with their sizes and tokens; files of no taken kind, by name or by content, are left out. [SRC-13, AGG-22]

    They lie in folders of a thousand parts, so that no folder grows with the input: tasks that write into one wait for each other, and it is deleted as a whole.
    """
    root = _tree(spark, "images")
    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(F.col("p_size") * 60), number(200 + F.col("p_partkey") % 1000), F.unhex(F.lit("080600000000000000")))
    parts = table(spark, sf, "part")
    named = lambda end: F.concat(F.floor(F.col("p_partkey") / 1000).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(end)).alias("path")
    kinds = [parts.select(named(".png"), head.alias("content")), parts.select(named(".gif"), head.alias("content")), parts.select(named(".jpg"), F.encode("p_name", "UTF-8").alias("content"))]
    for kind in kinds:
        _write(kind, root)
    images = spark.read.format("ui_images").option("maxBytes", 1000).load(root)
    return images.select(F.substring_index("path", "/", -1).alias("path"), "mime", "length", "width", "height", ledger.image_tokens(F.col("width"), F.col("height")).alias("tokens"))


@query(
    "SELECT 's' || s_suppkey AS path, CASE WHEN s_nationkey % 3 = 0 THEN 'HEAD' WHEN s_nationkey % 3 = 1 THEN 'work/n' || s_nationkey ELSE 'main' END AS branch, CASE WHEN s_nationkey % 3 = 2 THEN sha1('m' || s_suppkey) ELSE sha1('h' || s_suppkey) END AS head, CASE WHEN s_nationkey % 2 = 0 THEN 'master' ELSE 'main' END AS main_branch, sha1('m' || s_suppkey) AS main_head FROM supplier WHERE NOT (s_nationkey % 3 = 2 AND s_nationkey % 2 = 0) UNION ALL "
    "SELECT 's' || s_suppkey, NULL, NULL, 'master', sha1('m' || s_suppkey) FROM supplier WHERE s_nationkey % 3 = 2 AND s_nationkey % 2 = 0",
    prefix="",
)
def git_positions(spark, sf):
    """A repository a supplier: detached, on a branch of its own or on main, its references loose or packed. [SRC-12]"""
    root = _tree(spark, "git")
    n, key = F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier").select(n, F.concat(F.lit("s"), key).alias("at"), F.sha1(F.concat(F.lit("h"), key)).alias("h"), F.sha1(F.concat(F.lit("m"), key)).alias("m"))
    own, main = F.concat(F.lit("refs/heads/work/n"), n.cast("string")), F.concat(F.lit("refs/heads/"), F.when(n % 2 == 0, "master").otherwise("main"))
    file = lambda name, text: F.struct(F.concat("at", F.lit("/.git/"), name).alias("path"), F.concat(text, F.lit("\n")).alias("content"))
    head = F.when(n % 3 == 0, F.col("h")).when(n % 3 == 1, F.concat(F.lit("ref: "), own)).otherwise("ref: refs/heads/main")
    loose = F.array(file(own, F.col("h")), file(main, F.col("m")))
    packed = F.array(file(F.lit("packed-refs"), F.concat(F.lit("# pack-refs with: peeled\n"), F.col("h"), F.lit(" "), own, F.lit("\n"), F.col("m"), F.lit(" "), main)))
    files = rows.select(F.explode(F.concat(F.array(file(F.lit("HEAD"), head)), F.when(F.col("m") < "8", loose).otherwise(packed))).alias("f")).select("f.*")
    _write(files, root)
    return spark.read.format("git_position").load(root)
