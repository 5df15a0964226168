"""What the operators share: scratch tables, Arrow word splitting, shingle hashes and joins with hot keys."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.scratch import delete_at_end, is_local, shared_root

#: Java and RE2 regex of a word: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of an Arrow task holds in arrays.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark sends to Python, unless the session says otherwise: Spark's own is 10,000 rows, up to 64 MB,
#: which JVM and worker each hold.
ARROW_BATCH, ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: A key is hot when it has more than total / HOT_SHARE rows: at most HOT_SHARE keys are broadcast.
HOT_SHARE = 500
HOT_LEAST = 200
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def doc_key() -> Column:
    """128 bits of id and text: equal only for repeated rows."""
    own = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(own, F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary")))


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Parquet tables of one run in the shared folder: they cut lineage and outlive lost executors. The session's end deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        delete_at_end(spark, self.path)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def observed(self, df: DataFrame, label: str, *sums: Column) -> tuple[DataFrame, list[int]]:
        """Saves df and tells the sums (0 over no rows), or how many rows it has, taken while it is written.

        A query of its own for each count would cost the driver, which keeps the plan, stages and tasks of a session's last 1,000.
        """
        seen = Observation()
        sums = sums or (F.count(F.lit(1)),)
        saved = self.save(df.observe(seen, *[c.alias(f"s{i}") for i, c in enumerate(sums)]), label)
        return saved, [int(seen.get[f"s{i}"] or 0) for i in range(len(sums))]

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Python workers started by this session can import this package: on a cluster Spark sends it to them, once a session.

    The batches sent to them are limited by bytes.
    """
    if spark.conf.get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, ARROW_BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if is_local(spark):
        env = context.environment
        if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    elif not getattr(context, "_loomgraph_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph_package.zip")  # the driver's copy; Spark serves it
        with zipfile.ZipFile(path, "w") as package:
            for folder, _, names in os.walk(os.path.join(root, "loomgraph")):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        package.write(file, os.path.relpath(file, root))
        context.addPyFile(path)
        context._loomgraph_shipped = True


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join where right has one row a key and in `count` how many left rows have it.

    Keys with more than total / HOT_SHARE rows (fewer than HOT_SHARE of them, by counting) are broadcast and
    so need no shuffle; the rest meet in a shuffled join in which no key is large.
    """
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(count) > least))
    cold = right.where(F.col(count) <= least)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold.hint("shuffle_merge"), keys))


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, block: int) -> DataFrame:
    """Inner join like join_hot for wide right rows: none is broadcast.

    A key with more than `block` left rows is dealt to several tasks: its right row goes to each, a left row to one by a hash of all
    it holds. Only keys and numbers of parts of the hot keys are broadcast.
    """
    parts = F.ceil(F.col(count) / block).cast("int")
    others = [F.col(c) for c in left.columns if c not in keys]
    dealt = join_hot(left, right.select(*keys, count, parts.alias("_parts")), keys, count, total).drop(count)
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*others) if others else F.lit(0), F.col("_parts")).cast("int")).drop("_parts")
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(spread.hint("shuffle_merge"), [*keys, "_salt"]).drop("_salt")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], parts: int, name: str) -> DataFrame:
    """Adds a 0-based rank within the keys: ordered by a hash part of the order columns, then by them.

    A key of any size is spread over `parts` windows; what the parts before hold is added by a join of counts.
    """
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    local = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    match = [local[k].eqNullSafe(before[k]) for k in [*keys, "_part"]]
    joined = local.join(before.hint("shuffle_merge"), match, "inner")
    return joined.select(*[local[c] for c in df.columns if c != "_part"], (local["_rank"] + F.coalesce(before["_before"], F.lit(0))).cast("long").alias(name))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, label: str) -> DataFrame:
    """Adds the sums of the expressions over all rows up to and including a row, in the given order without ties.

    Rows are dealt by ranges and written; each range is summed for itself and what the ranges before hold, a row a range, is added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), label)
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as ranges
    before = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = before.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    out = dealt.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(before), "_range")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


# ---- Arrow side -------------------------------------------------------------------------------------------------

#: Gives freed memory back to the system, where the C library can: numpy's arrays leave holes that a worker would keep for its life.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that each has about `most` bytes of text; one long text stays whole.

    What Arrow holds without need goes back to the system after each batch, as workers live on from task to task.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
    _trim(0)


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in text order, and where each text's words begin (one more at the end)."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        codes, owner = codes[keep], owner[keep]
    return encoded.dictionary, codes, np.searchsorted(owner, np.arange(len(text) + 1))


def hash_strings(values: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes."""
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False) if len(values) else np.zeros(0, np.uint64)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    acc = np.full(len(starts), width, np.uint64)
    for i in range(width):
        acc = acc * _MULTIPLIER + words[starts + i]
    return mix(acc)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of `width` words; a text of fewer words, if any, gives its whole sequence."""
    sizes = np.diff(bounds)
    windows = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    starts = np.arange(len(owner)) - np.repeat(first - bounds[:-1], windows)
    values, owners = [_rolled(words, starts, width)], [owner]
    for short in range(1, width):
        which = np.flatnonzero(sizes == short)
        values.append(_rolled(words, bounds[which], short))
        owners.append(which)
    return np.concatenate(values), np.concatenate(owners)


def distinct_by_owner(values: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in ascending order, and where each owner's begin (one more at the end)."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[fresh], np.searchsorted(owners[fresh], np.arange(n + 1))
