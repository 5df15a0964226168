"""Packing: non-negative least squares over shallow length combinations, rounded, the rest packed greedily."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, doc_key, rank_within, ship, slices, table

WINDOW = 2048
END_ID = 1
#: Piece lengths are told apart in steps of so many tokens: up to GRAIN - 1 tokens a piece stay unused.
GRAIN = 8
#: Pieces of a combination at most: texts of under a third of a window are left to the greedy rest, which fills sequences with them.
DEPTH = 3
#: A sequence of the greedy rest with more free tokens than this is cut into sequences of powers of two, which need no padding.
SLACK = 64
#: Document keys broadcast at most; beyond, the join is shuffled.
BROADCAST_KEYS = 1_000_000

# ---- token ids --------------------------------------------------------------------------------------------------

#: Two white-space characters in a row, or one at an end: there the text can't be encoded chunk by chunk.
_ODD_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}|^[\s\p{Z}\x0b\x1c-\x1f\x{85}]|[\s\p{Z}\x0b\x1c-\x1f\x{85}]$"
_SPECIAL = "<|endoftext|>"


@lru_cache(1)
def _library(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(1)
def _encoder(ranks_path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    width = np.zeros(max(ranks.values()) + 2, np.int64)
    for token, rank in ranks.items():
        width[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def encode(text: pa.Array, ranks_path: str, json_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with END_ID behind it, and where each text's begin (one more at the end).

    The byte-pair encoder splits before every single space, so equal space-separated chunks have equal ids: each
    distinct chunk of the slice is encoded once. Texts with odd white space are encoded whole, and those with a
    special token's string by the `tokenizers` library itself, whose ids the ranks reproduce.
    """
    encoding, width = _encoder(ranks_path)
    text = pc.fill_null(text, "")
    n = len(text)
    special = pc.match_substring(text, _SPECIAL).to_numpy(zero_copy_only=False)
    plain = ~special & ~pc.match_substring_regex(text, _ODD_SPACE).to_numpy(zero_copy_only=False)
    plain &= pc.binary_length(text).to_numpy(zero_copy_only=False) > 0
    whole: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(~plain):
        value = text[int(i)].as_py()
        ids = _library(json_path).encode(value, add_special_tokens=False).ids if special[i] else encoding.encode_ordinary(value)
        whole[int(i)] = np.array([*ids, END_ID], np.uint32)
    rows = np.flatnonzero(plain)
    lengths = np.zeros(n, np.int64)
    flat = np.zeros(0, np.uint32)
    if len(rows):
        lists = pc.split_pattern(text.take(pa.array(rows)), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = lists.flatten()
        heads = np.cumsum(sizes) - sizes
        encoded = chunks.dictionary_encode()
        distinct, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text's first chunk has no space before it
        first = [encoding.encode_ordinary(x) for x in chunks.take(pa.array(heads)).to_pylist()]
        joined = " " + pc.binary_join(pa.array([distinct], pa.list_(pa.string())), " ")[0].as_py()
        ids = np.array(encoding.encode_ordinary(joined), np.uint32)
        ends = np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        stop = np.searchsorted(np.cumsum(width[ids]), ends) + 1
        start = np.concatenate([[0], stop[:-1]])
        base = len(ids)
        ids = np.concatenate([ids, np.array([END_ID], np.uint32), np.array([x for f in first for x in f], np.uint32)])
        first_size = np.array([len(f) for f in first], np.int64)
        begin, count = start[codes], (stop - start)[codes]
        begin[heads], count[heads] = base + 1 + np.cumsum(first_size) - first_size, first_size
        last = np.cumsum(sizes)  # the end id goes behind each text
        begin, count = np.insert(begin, last, base), np.insert(count, last, 1)
        total = np.cumsum(count)
        flat = ids[np.arange(total[-1]) - np.repeat(total - count - begin, count)]
        row_end = total[np.cumsum(sizes + 1) - 1]
        lengths[rows] = np.diff(np.concatenate([[0], row_end]))
    if not whole:
        return flat, np.concatenate([[0], np.cumsum(lengths)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    parts = [whole[i] if i in whole else flat[at[i] : at[i + 1]] for i in range(n)]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _paths(ranks_path: str | None, json_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path or public_tokenizers.path("byte_bpe_50k.json")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


# ---- the plan: a table of at most WINDOW / GRAIN lengths ----------------------------------------------------------


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending lengths, in grains, of at most `depth` pieces that fill a window exactly."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, taken: tuple[int, ...]) -> None:
        if not rest:
            out.append(taken)
        elif len(taken) < depth:
            for x in range(min(rest, most), 0, -1):
                if x * (depth - len(taken)) < rest:
                    break
                grow(rest - x, x, (*taken, x))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin |ax - b| over x >= 0, by active sets; each round adds a column, and three a column suffice as a rule.

    Should these not (by rounding), the point reached is feasible and `plan` packs greedily what it leaves.
    """
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds or 3 * max(a.shape)):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            own = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if z.min(initial=1) > 0:
                x[:] = 0
                x[own] = z
                break
            low = z <= 0
            step = (x[own][low] / np.maximum(x[own][low] - z[low], 1e-300)).min()
            x[own] += step * (z - x[own])
            passive[own[x[own] <= 1e-12]] = False
            x[~passive] = 0
    return x


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths (in grains) and how often each is used; together they use the histogram exactly.

    Counts solved by least squares are rounded down where the histogram has no more; what remains is packed greedily,
    the longest first into the fullest sequence that has room, a whole run of equal lengths at a time.
    """
    left = {k: int(v) for k, v in histogram.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []
    usable = [c for c in combinations(units) if all(x in left for x in c)]
    if usable:
        lengths = sorted(left)
        row = {x: i for i, x in enumerate(lengths)}
        a = np.zeros((len(lengths), len(usable)))
        for j, combo in enumerate(usable):
            for x in combo:
                a[row[x], j] += 1
        # long pieces are hard to place: they weigh more
        weight = np.sqrt(np.array(lengths) / units)[:, None]
        x = nnls(a * weight, np.array([left[k] for k in lengths]) * weight[:, 0])
        for j in np.argsort(-x, kind="stable"):
            combo = usable[j]
            need = {k: combo.count(k) for k in combo}
            count = min(int(np.floor(x[j] + 0.5)), *(left[k] // v for k, v in need.items()))
            if count > 0:
                out.append((combo, count))
                for k, v in need.items():
                    left[k] -= v * count
    # greedy rest: open sequences of equal content are kept together as (free grains, content, how many)
    open_by_free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        todo = left[length]
        for free in sorted(f for f in open_by_free if f >= length):
            fits = free // length
            groups, rest = open_by_free.pop(free), []
            for content, many in groups:
                full, extra = (min(many, todo // fits), todo - min(many, todo // fits) * fits) if todo else (0, 0)
                if full:
                    open_by_free.setdefault(free - fits * length, []).append((content + (length,) * fits, full))
                    todo = extra
                    many -= full
                if many and 0 < todo < fits:
                    open_by_free.setdefault(free - todo * length, []).append((content + (length,) * todo, 1))
                    todo, many = 0, many - 1
                if many:
                    rest.append((content, many))
            if rest:
                open_by_free.setdefault(free, []).extend(rest)
            if not todo:
                break
        if todo:
            fits = units // length
            if todo // fits:
                open_by_free.setdefault(units - fits * length, []).append(((length,) * fits, todo // fits))
            if todo % fits:
                open_by_free.setdefault(units - (todo % fits) * length, []).append(((length,) * (todo % fits), 1))
    out += [group for free in sorted(open_by_free) for group in open_by_free[free]]
    return out


# ---- packing ----------------------------------------------------------------------------------------------------


def pieces(documents: DataFrame, window: int = WINDOW, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Every document's ids cut at multiples of the window: doc_key, doc_id, start, length, ids_crc32, doc_tokens.

    doc_key tells rows of equal doc_id apart: it hashes id and text.
    """
    ranks, json_file = _paths(ranks_path, json_path)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, bounds = encode(batch.column("text"), ranks, json_file)
            sizes = np.diff(bounds)
            many = -(-sizes // window)
            owner = np.repeat(np.arange(len(sizes)), many)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * window
            length = np.minimum(window, sizes[owner] - start)
            begin = bounds[:-1][owner] + start
            crc = [_crc(ids[b : b + k]) for b, k in zip(begin, length, strict=True)]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("doc_key").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(sizes[owner], pa.int64())],
                names=["doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens"],
            )

    keyed = documents.select("doc_id", "text", doc_key().alias("doc_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, doc_key binary, start long, length long, ids_crc32 long, doc_tokens long")


def pack(documents: DataFrame, window: int = WINDOW, grain: int = GRAIN, scratch: Scratch | None = None, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `window` tokens.

    Whole windows of a document are sequences of their own. Its last piece goes to a place of the plan made from the
    histogram of lengths in grains (at most window / grain rows, whatever the input): the r-th piece of a length takes
    the r-th place of that length. Greedy sequences with much room are cut into powers of two, which need no padding.
    A null or empty text has one id, the end; a text of any length is cut and packed whole; a null doc_id is passed on.
    Pieces of equal length take their places in the order of doc_key, so reruns agree. Repeated rows are packed each. An
    empty table gives no rows. Columns beside doc_id and text, whatever their names, are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    units = window // grain
    cut = scratch.save(pieces(documents, window, ranks_path, json_path), "pieces")
    cut = cut.withColumn("grains", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["grains"]: r["n"] for r in cut.where(F.col("length") < window).groupBy("grains").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = int(cut.where(F.col("length") == window).count())
    groups = plan(histogram, units)
    # places: of each length, runs of sequences that take it at one slot
    next_sequence, used, runs = 0, dict.fromkeys(histogram, 0), []
    for content, count in groups:
        loose = (units - sum(content)) * grain > SLACK
        for slot, length in enumerate(content):
            runs.append((length, used[length], used[length] + count, next_sequence, slot, loose))
            used[length] += count
        next_sequence += count
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_key"), F.col("start")]
    rest = rank_within(cut.where(F.col("length") < window), ["grains"], order, parts, "rank")
    place = spark.createDataFrame(runs, "grains int, rank_from long, rank_to long, first_sequence long, slot int, loose boolean")
    # a few hundred runs: bounded by the number of combinations used
    joined = rest.join(F.broadcast(place), (rest["grains"] == place["grains"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    placed = joined.select("doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "slot", "loose")
    placed = scratch.save(placed, "placed")
    by_slot = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(by_slot), F.lit(0)).cast("long"))
    whole = rank_within(cut.where(F.col("length") == window), ["grains"], order, parts, "rank")
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + next_sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = placed.where(~F.col("loose")).select(columns).unionByName(whole.select(columns))
    if any(r[-1] for r in runs):
        out = out.unionByName(_powers(documents, placed.where("loose"), next_sequence + full, scratch, _paths(ranks_path, json_path)).select(columns))
    return out


def _powers(documents: DataFrame, placed: DataFrame, first_id: int, scratch: Scratch, paths: tuple[str, str]) -> DataFrame:
    """The pieces of the loose sequences, cut so that each sequence is a power of two long.

    The cuts are written; the texts that they lie in, as many as the plan's greedy end leaves, are fetched by a broadcast of
    their keys where these are few and by a shuffle where not, and meet their cuts ordered by key, so that each is encoded once.
    """
    rows = placed.withColumn("total", F.sum("length").over(Window.partitionBy("sequence_id")))
    bits = F.expr("transform(filter(sequence(11, 0, -1), b -> (total & shiftleft(1L, b)) != 0), b -> shiftleft(1L, b))")
    rows = rows.withColumn("sizes", bits)
    ends = F.expr("transform(sequence(1, size(sizes)), i -> aggregate(slice(sizes, 1, i), 0L, (a, x) -> a + x))")
    rows = rows.withColumn("ends", ends).withColumn("cut", F.expr("transform(sequence(0, size(ends) - 1), i -> struct(i AS at, if(i = 0, 0L, ends[i - 1]) AS lo, ends[i] AS hi))"))
    rows = rows.select("*", F.explode("cut").alias("c")).where((F.col("c.lo") < F.col("offset") + F.col("length")) & (F.col("c.hi") > F.col("offset")))
    low, high = F.greatest("c.lo", "offset"), F.least(F.col("c.hi"), F.col("offset") + F.col("length"))
    rows = rows.select("doc_id", "doc_key", (F.col("start") + low - F.col("offset")).alias("start"), (high - low).alias("length"), "doc_tokens", (F.lit(first_id) + F.col("sequence_id") * 12 + F.col("c.at")).cast("long").alias("sequence_id"), (low - F.col("c.lo")).alias("offset"))
    rows = scratch.save(rows, "loose")
    keys = rows.select("doc_key").distinct()
    keys = F.broadcast(keys) if rows.count() <= BROADCAST_KEYS else keys
    texts = documents.select("text", doc_key().alias("doc_key")).join(keys, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    met = rows.join(texts.hint("shuffle_merge"), "doc_key").sortWithinPartitions("doc_key")
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, np.zeros(0, np.uint32)
        for batch in slices(batches):
            crc = []
            for key, text, start, length in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "text", "start", "length")), strict=True):
                if key != last:
                    last, ids = key, encode(pa.array([text], pa.string()), *paths)[0]
                crc.append(_crc(ids[start : start + length]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return met.select(*names, "doc_key", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over all `documents`; its docstring gives the results for nulls, empty and long texts, ties, repeats and empty tables."""
    return pack(table(spark, sf_dir, "documents"))

