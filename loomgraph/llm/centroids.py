"""Centroid clustering: Lloyd's rounds over vectors cut into blocks of columns, in exact integers."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, release, ship, table

#: Components of a vector, columns of a block, vectors of a chunk: a task works on a block of a chunk at a time.
DIMENSIONS, BLOCK, CHUNK = 64, 16, 2048
CENTROIDS, ROUNDS, SCALE, SEED = 40, 5, 256, "2"
#: Up to this size of components float64 holds all sums of a chunk exactly; up to the next one int64 does; larger ones are Python's integers.
_EXACT_FLOAT, _EXACT_LONG = 1 << 20, 1 << 27
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Rows whose vector has exactly as many components, none null or non-finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dimensions) & finite)


def scaled(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles x, in the smallest integers that hold them; scale is a power of two, so the product is exact."""
    largest = float(np.abs(vectors).max(initial=0))
    if largest * scale < _EXACT_LONG:
        out = np.floor(vectors * scale).astype(np.int64)
        return out.astype(np.int16) if np.abs(out).max(initial=0) < 1 << 15 else out.astype(np.int32)
    exact = [[math.floor(x * scale) if abs(x) < 1e300 else math.floor(x) * scale for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object)


def _wide(values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The values in a type in which squares and sums over a chunk, with those of `more`, are exact."""
    largest = max([int(abs(v).max()) for v in (values, *more) if v.size], default=0)
    return values.astype(np.float64 if largest <= _EXACT_FLOAT else np.int64 if largest <= _EXACT_LONG else object)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest integers with room for the sum of a few of them."""
    largest = int(values.max()) if values.size else 0
    return values.astype(np.int32 if largest < 1 << 24 else np.int64 if largest < 1 << 58 else object)


def partial_distances(columns: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each vector and centroid the exact squared distance within a block of columns."""
    kind = _wide(columns[:1], columns, centroids).dtype
    x, c = columns.astype(kind), centroids.astype(kind)
    return _narrow((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :])


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != b.dtype:
        wider = object if object in (a.dtype, b.dtype) else np.int64
        a, b = a.astype(wider), b.astype(wider)
    return a + b


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid, of equally near ones the first, and its distance."""
    label = distances.argmin(1)
    return label.astype(np.int32), distances[np.arange(len(distances)), label]


def block_sums(columns: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Sums of each cluster's vectors within a block of columns, as Python's integers, and their counts in a last column."""
    out = np.zeros((k, columns.shape[1] + 1), dtype=object)
    x = _wide(columns)
    if x.dtype == object:
        np.add.at(out[:, :-1], labels, x)
    else:
        one = np.zeros((k, len(labels)), x.dtype)
        one[labels, np.arange(len(labels))] = 1
        out[:, :-1] = (one @ x).astype(np.int64).astype(object)
    out[:, -1] = np.bincount(labels, minlength=k).astype(object)
    return out


def _means(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster; an empty one stays."""
    after = before.astype(object)
    some = sums[:, -1] > 0
    after[some] = sums[some, :-1] // sums[some, -1:]
    return after


def first_centroids(vectors: DataFrame, id_column: str, column: str, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hexadecimal SHA-256 of `<seed>:<id>`, in that order; of one id's, by the vector. k rows come to the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), F.col(column).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return scaled(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)).astype(object)


def cut(vectors: DataFrame, id_column: str, column: str, dimensions: int, block: int) -> DataFrame:
    """chunk, part, data and ids: chunks of vectors by blocks of columns; part -1 has the chunk's ids and no data."""
    kind = vectors.schema[id_column].dataType
    schema = f"chunk long, part int, data binary, ids array<{kind.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                some = batch.slice(start, CHUNK)
                values = scaled(some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dimensions))
                data = [None, *[pickle.dumps(np.ascontiguousarray(values[:, i : i + block])) for i in range(0, dimensions, block)]]
                ids = some.column("id")
                n = len(data)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * (n - 1)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(range(-1, n - 1), pa.int32()), pa.array(data, pa.binary()), lists], names=["chunk", "part", "data", "ids"])
                chunk += 1

    return vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, schema)


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, block: int = BLOCK, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """Assignments (the id, cluster and distance of each usable vector) and the centroids, after `rounds` rounds and a last assignment.

    Vectors of another size, and those with a null or non-finite component, are left out; the others count as integers
    floor(256 * x). A null id is an id like others (its name is empty), repeated rows count each, equal distances go to the smaller
    number, and fewer vectors than k make as many centroids; an empty table gives no rows. Columns beside the two named, whatever
    their names, are not read. Sums are exact at any size of components; a distance beyond a long is null.

    A shard is a block of columns: its tasks compute exact partial distances to their slice of the centroids, reduceByKey adds the
    blocks of a chunk of vectors and takes the nearest, and each shard makes its slice of the new centroids. The driver holds the
    centroids alone.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "centroids")
    known = usable(vectors, column, dimensions)
    centroids = first_centroids(known, id_column, column, k, seed)
    k = len(centroids)
    kind = vectors.schema[id_column].dataType
    chunks = scratch.save(cut(known, id_column, column, dimensions, block), "blocks")
    blocks = chunks.where("part >= 0").select("chunk", "part", "data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def assign(centroids: np.ndarray, label: str) -> DataFrame:
        """chunk and data: labels and distances of its vectors."""
        slices = [centroids[:, i : i + block] for i in range(0, dimensions, block)]

        def partial(row) -> tuple[int, np.ndarray]:
            return row["chunk"], partial_distances(pickle.loads(row["data"]), slices[row["part"]])

        added = blocks.rdd.map(partial).reduceByKey(_add, parts).map(lambda x: (x[0], bytearray(pickle.dumps(_nearest(x[1])))))
        return scratch.save(spark.createDataFrame(added, "chunk long, data binary"), label)

    def update(labels: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """Each shard's slice of the new centroids, side by side."""
        slices = [centroids[:, i : i + block] for i in range(0, dimensions, block)]
        both = blocks.join(labels.select("chunk", F.col("data").alias("labels")).hint("shuffle_hash"), "chunk")

        def sums(rows) -> Iterator[tuple[int, np.ndarray]]:
            held: dict[int, np.ndarray] = {}
            for row in rows:
                one = block_sums(pickle.loads(row["data"]), pickle.loads(row["labels"])[0], k)
                held[row["part"]] = held[row["part"]] + one if row["part"] in held else one
            yield from held.items()

        fresh = dict(both.select("part", "data", "labels").rdd.mapPartitions(sums).reduceByKey(lambda a, b: a + b, len(slices)).map(lambda x: (x[0], _means(x[1], slices[x[0]]))).collect())
        return np.concatenate([fresh.get(i, s) for i, s in enumerate(slices)], axis=1)

    for i in range(rounds if k else 0):
        labels = assign(centroids, f"labels{i}")
        centroids = update(labels, centroids)
        scratch.drop(f"labels{i}")
        release(spark)
    if not k:
        return spark.createDataFrame([], f"`{id_column}` {kind.simpleString()}, cluster int, distance long"), centroids
    labels = assign(centroids, "labels")
    both = chunks.where("part = -1").select("chunk", "ids").join(labels.hint("shuffle_hash"), "chunk")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, distance = pickle.loads(batch.column("data")[i].as_py())
                whole = [int(d) if d <= _LONG else None for d in distance]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(label, pa.int32()), pa.array(whole, pa.int64())], names=["id", "cluster", "distance"])

    out = both.select("ids", "data").mapInArrow(rows, f"id {kind.simpleString()}, cluster int, distance long")
    return scratch.save(out, "assigned").withColumnRenamed("id", id_column), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, cluster_inertia, inertia and centroid_sha256: one row a cluster that has vectors; an inertia beyond a long is null."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.try_sum("distance").alias("cluster_inertia"))
    total = per.agg(F.try_sum("cluster_inertia").alias("inertia"))
    return per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").join(F.broadcast(total))  # one row


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster over all `embeddings`; its docstring gives the results for nulls, odd vectors, ties, repeats and empty tables."""
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    clusters = F.broadcast(summary(assigned, centroids).drop("n"))  # at most as many rows as centroids
    return assigned.join(clusters, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
x AS MATERIALIZED (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM kept),
c0 AS MATERIALIZED (SELECT k, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM (SELECT e, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) - 1 AS k FROM kept QUALIFY k < {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, (s, k)) AS k, min(s) AS s FROM (SELECT r, k, sum((x.v - c.v) * (x.v - c.v)) AS s FROM x JOIN c{i} c USING (d) GROUP BY r, k) GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.d, CASE WHEN n IS NULL THEN c.v ELSE CAST((t - ((t % n) + n) % n) // n AS BIGINT) END AS v FROM c{i} c LEFT JOIN (SELECT k, d, CAST(sum(v) AS BIGINT) AS t, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY k, d) USING (k, d))")
    last = ROUNDS
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.k AS INT) AS cluster, CAST(a.s AS BIGINT) AS distance, CAST(sum(a.s) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.s) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM kept JOIN a{last} a USING (r) JOIN (SELECT k, sha256(string_agg(v, ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY k) h ON h.k = a.k"""


OP12_SQL = _sql()
