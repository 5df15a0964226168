"""Document fingerprints: bottom-k sketches of shingle hashes, mergeable, for resemblance, containment and counts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SLICE_BYTES, distinct_by_owner, hash_strings, ship, shingle_hashes, split_words, table

K = 128
WIDTH = 5
#: A hash keeps its lowest 48 bits: 6 bytes in a fingerprint.
BITS = 48
_MASK = np.uint64((1 << BITS) - 1)


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending; none for a text without words."""
    distinct, codes, bounds = split_words(texts, lower=True)
    words = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    values, owners = shingle_hashes(words, bounds, width)
    values, at = distinct_by_owner(values & _MASK, owners, len(texts))
    return [values[a : min(a + k, b)] for a, b in zip(at[:-1], at[1:], strict=True)]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()).decode() if len(sketch) else ""


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : BITS // 8] = raw
    return wide.view("<u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the two parts' union."""
    return np.union1d(a, b)[:k]


def shingle_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact under k, else estimated from the k-th smallest hash."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / float(1 << BITS))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; exact if the union has at most k shingles. Two empty sketches are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(np.intersect1d(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).size / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = shingle_count(merge(a, b, k), k)
    return max(0.0, min(1.0, resemblance(a, b, k) * union / shingle_count(a, k)))


def _bucket_of(key, points: list[int], per_segment: int):
    """Bucket number, rising with the key: a binary search over at most 256 points, then equal steps between two points."""

    def search(lo: int, hi: int):
        if lo == hi:
            low = points[lo - 1] if lo else None
            high = points[lo] if lo < len(points) else None
            if low is None or high is None or high - low < per_segment:
                return F.lit(lo * per_segment)
            inner = F.floor((key.cast("double") - F.lit(float(low))) * (per_segment / (high - low))).cast("int")
            return F.lit(lo * per_segment) + F.least(F.greatest(inner, F.lit(0)), F.lit(per_segment - 1))
        middle = (lo + hi) // 2
        return F.when(key < points[middle], search(lo, middle)).otherwise(search(middle + 1, hi))

    return search(0, len(points))


def fingerprint_edits(documents: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document's fingerprint and that of its edited text, with the likeness to it and to the next document.

    The edited text replaces the last floor(n / 2) code points by the first as many of the next document by descending
    doc_id; the one with the smallest takes the largest's. Equal ids follow a hash of their text, null ids come last,
    a null text is empty and an only document is its own next. Texts of any length count whole, repeated rows follow one
    another, an empty table gives no rows, and columns beside doc_id and text, whatever their names, are not read.

    Documents meet their next one by one range shuffle of the texts; where a range ends, the first of the range
    below is copied over.
    """
    spark = documents.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    cuts = min(256, 4 * parts)
    points = rows.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("key", [i / cuts for i in range(1, cuts)], 4 * cuts)).first()[0]
    points = sorted(set(points or []))
    rows = rows.withColumn("bucket", _bucket_of(F.col("key"), points, max(1, 4 * parts // cuts)).cast("int")).withColumn("tie", F.xxhash64("text"))
    # the first row, by descending key, of each bucket: as many as there are buckets
    heads = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")).collect()
    heads = sorted(((r["bucket"], r["head"]["key"], r["head"]["tie"]) for r in heads), reverse=True)
    # each bucket gets the head of the next non-empty one below, and the last one the very first
    moves = [(heads[i][0], *heads[(i + 1) % len(heads)][1:]) for i in range(len(heads))]
    move = spark.createDataFrame(moves, "to int, key long, tie long")
    extra = rows.join(F.broadcast(move), ["key", "tie"]).select("doc_id", "text", "key", F.col("to").alias("bucket"), "tie", F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).select("doc_id", "text", "key", "bucket", "tie", "guest").unionByName(extra.dropDuplicates(["bucket"]))
    dealt = dealt.repartition(max(parts, 1), "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("tie"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[object, str]] = []  # rows of one bucket in order; the last one's next is still to come
        bucket = None

        def finish() -> pa.RecordBatch:
            """All but the last row, which stays."""
            texts = [t for _, t in waiting]
            edited = []
            for here, after in zip(texts[:-1], texts[1:], strict=True):
                half = len(here) // 2
                edited.append(here[: len(here) - half] + after[:half])
            own, other = sketches(pa.array(texts, pa.string()), k, width), sketches(pa.array(edited, pa.string()), k, width)
            out = [
                (i, len(t), hashlib.sha256(e.encode()).hexdigest(), to_text(a), to_text(b), resemblance(a, b, k), resemblance(a, c, k), shingle_count(a, k))
                for (i, t), e, a, b, c in zip(waiting[:-1], edited, own[:-1], other, own[1:], strict=True)
            ]
            del waiting[:-1]
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        held, id_type = 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, number, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest")), strict=True):
                if number != bucket:
                    waiting.clear()
                    bucket, held = number, 0
                waiting.append((doc_id, text))
                held += len(text)
                if guest or held > SLICE_BYTES:
                    if len(waiting) > 1:
                        yield finish()
                    held = len(text)

    return dealt.select("doc_id", "text", "bucket", "guest").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint_edits over all `documents`; its docstring gives the results for nulls, empty and long texts, ties, repeats and empty
    tables."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
