"""Benchmark decontamination: suffix arrays of shards of the training texts, searched for every suffix of the test items."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_key, fresh_name, ship, slices, table

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of test items that one search holds: a benchmark of more is searched in as many blocks as it takes.
BLOCK_WORDS = 1 << 20
#: Bytes of training text in one suffix array; one long text makes one array.
SHARD_BYTES = 4 << 20
#: Words are runs of ASCII letters and digits, A-Z lower-cased, and of all code points from U+0080.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
for _low, _high, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61)):
    _FOLD[_low : _high + 1] = np.arange(_to, _to + _high - _low + 1)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where each text's begin (one more at the end). A null text has none."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    lo, hi = (int.from_bytes(text.buffers()[1][8 * i : 8 * i + 8].to_pybytes(), "little") for i in (text.offset, text.offset + len(text)))
    raw = np.frombuffer(text.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] - lo
    folded = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(_FOLD[raw].tobytes())])
    lists = pc.ascii_split_whitespace(folded)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    owner = owner[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.searchsorted(owner, np.arange(len(text) + 1))


@dataclass(frozen=True)
class Tests:
    """Test items by word codes from 1: `words` in order of their codes, `codes` of all items, where each item begins and its id."""

    words: pa.Array
    codes: np.ndarray
    bounds: np.ndarray
    ids: list
    window: int

    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the suffixes that hold a window, their item's number, their words and their window's words."""
        sizes = np.diff(self.bounds)
        widths = np.minimum(sizes, self.window)
        items = np.repeat(np.arange(len(sizes)), np.where(sizes > 0, sizes - widths + 1, 0))
        first = np.concatenate([np.arange(b, b + s - w + 1) for b, s, w in zip(self.bounds[:-1], sizes, widths, strict=True) if s]) if len(items) else np.zeros(0, np.int64)
        return first, items, self.bounds[items + 1] - first, widths[items]


def tests_of(texts: list, ids: list, window: int = WINDOW) -> Tests:
    flat, bounds = words_of(pa.array(texts, pa.string()))
    encoded = flat.dictionary_encode()
    return Tests(encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, bounds, list(ids), window)


def suffix_array(codes: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes (0: a run's end) in the order of the suffixes up to their run's end, compared over `depth` words at least.

    ends: of each position, that of its run's end. Ranks over 1, 2, 4 ... words are made of ranks over half as many.
    """
    rank, reach, n = codes.astype(np.int64), 1, len(codes)
    place = np.arange(n)
    base = n + int(codes.max(initial=0)) + 2
    while reach < depth and n:
        key = rank * base + np.where(place + reach < ends, rank[np.minimum(place + reach, n - 1)], 0)
        distinct, rank = np.unique(key, return_inverse=True)
        reach *= 2
        if len(distinct) == n:
            break
    return np.argsort(rank, kind="stable")


def _narrow(codes: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of the array whose suffixes share `depth` words: the part of each whose next word is the given one, by binary search."""

    def bound(after: bool) -> np.ndarray:
        low, high = lo.copy(), hi.copy()
        while len(left := np.flatnonzero(low < high)):
            middle = (low[left] + high[left]) // 2
            here = codes[array[middle] + depth]
            right = (here <= word[left]) if after else (here < word[left])
            low[left[right]] = middle[right] + 1
            high[left[~right]] = middle[~right]
        return low

    return bound(False), bound(True)


@dataclass(frozen=True)
class Found:
    """What a shard holds of the tests. Matches: of every test suffix that holds a window and occurs, item, its first word, the longest
    match's words, a text that has it and where. Windows: `spans` (text, start, words) of all occurrences and `pairs` (text, item)."""

    matches: pd.DataFrame
    spans: np.ndarray
    pairs: np.ndarray


def search(flat: pa.Array, bounds: np.ndarray, tests: Tests) -> Found:
    """Builds the shard's suffix array and searches every test suffix in it.

    A match holds test words only, so a run of training words ends at any other word and at a text's end, and runs shorter than
    the shortest window hold none: the array has the suffixes of the other runs.
    """
    first, items, remaining, widths = tests.starts()
    none = Found(pd.DataFrame({c: np.zeros(0, np.int64) for c in ("item", "item_start", "n_words", "text", "start")}), np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64))
    if not len(first) or not len(flat):
        return none
    known = pc.fill_null(pc.index_in(flat, value_set=tests.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    # runs of test words within a text, then each followed by a 0
    fresh = np.zeros(len(known) + 1, bool)
    fresh[bounds[:-1]] = True
    begins = np.flatnonzero((known > 0) & (fresh[:-1] | np.concatenate([[True], known[:-1] == 0])))
    stops = np.flatnonzero((known > 0) & (fresh[1:] | np.concatenate([known[1:] == 0, [True]]))) + 1
    long_enough = stops - begins >= widths.min()
    begins, stops = begins[long_enough], stops[long_enough]
    if not len(begins):
        return none
    sizes = stops - begins + 1
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)  # where in the shard
    is_end = at == np.repeat(stops, sizes)
    codes = np.where(is_end, 0, known[np.minimum(at, len(known) - 1)])
    ends = np.repeat(np.cumsum(sizes) - 1, sizes)
    array = suffix_array(codes, ends, int(remaining.max()))
    array = array[ends[array] - array >= widths.min()]
    lo = np.searchsorted(codes[array], np.arange(len(tests.words) + 2))
    live = np.arange(len(first))
    low, high = lo[tests.codes[first]], lo[tests.codes[first] + 1]
    depth, window_lo, window_hi = 1, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    longest, best = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    while True:
        some = low < high
        live, low, high = live[some], low[some], high[some]
        longest[live], best[live] = depth, low
        whole = widths[live] == depth
        window_lo[live[whole]], window_hi[live[whole]] = low[whole], high[whole]
        more = remaining[live] > depth
        live, low, high = live[more], low[more], high[more]
        if not len(live):
            break
        low, high = _narrow(codes, array, low, high, depth, tests.codes[first[live] + depth])
        depth += 1
    hit = np.flatnonzero(window_hi > window_lo)
    if not len(hit):
        return none
    text_at = lambda places: np.searchsorted(bounds, places, "right") - 1  # noqa: E731  texts without words end where they begin
    place = at[array[best[hit]]]
    matches = pd.DataFrame({"item": items[hit], "item_start": first[hit] - tests.bounds[items[hit]], "n_words": longest[hit], "text": text_at(place), "start": place - bounds[text_at(place)]})
    # suffixes that share a window share a range: each range is read once, and its texts meet each of its items once
    shared, which = np.unique(np.stack([window_lo[hit], window_hi[hit], widths[hit]], 1), axis=0, return_inverse=True)
    spans, pairs = [], []
    by_range = pd.Series(items[hit]).groupby(which.reshape(-1)).unique()
    for i, (a, b, width) in enumerate(shared):
        where = at[array[a:b]]
        texts = text_at(where)
        spans.append(np.stack([texts, where - bounds[texts], np.full(len(where), width)], 1))
        inside = np.unique(texts)
        pairs.append(np.stack([np.repeat(inside, len(by_range[i])), np.tile(by_range[i], len(inside))], 1))
    return Found(matches, np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0))


def covered(spans: np.ndarray, texts: int, bounds: np.ndarray) -> np.ndarray:
    """Words of each text inside any span."""
    change = np.zeros(bounds[-1] + 1, np.int64)
    start = bounds[spans[:, 0]] + spans[:, 1]
    np.add.at(change, start, 1)
    np.add.at(change, start + spans[:, 2], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Tests]:
    """The test items in blocks of about block_words words, dealt by a hash; a longer item is a block of its own kind."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    # a word has a byte and one that parts it, so bytes bound words
    total = rows.agg(F.sum((F.octet_length("text") / 2 + 1).cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    for i in range(n):
        held = rows.where(F.col("block") == i).collect()
        if held:
            yield tests_of([r["text"] for r in held], [r["item_id"] for r in held], window)


def _merged(intervals: list) -> list:
    """Disjoint [start, end) of intervals in any order."""
    out: list = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _each(documents: DataFrame, tests: Tests, make, schema: str, columns: list[str], shard_bytes: int) -> DataFrame:
    """Maps make(batch, flat words, bounds, tests) over shards of documents. The tests go to the executors as one broadcast of bounded size."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(tests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in slices(batches, most=shard_bytes):
            flat, bounds = words_of(batch.column("text"))
            yield make(batch, flat, bounds, held)

    return documents.select(*columns).mapInArrow(run, schema)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, start, item_id, item_start and n_words: the longest verbatim match of every test suffix in each shard of documents, where
    it holds a window, and a place that has it (numbers of words).

    A suffix whose longest match is that of the suffix one word before, less this word, is part of that match and isn't returned.
    """
    ship(documents.sparkSession)
    kind, item_kind = documents.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, item_id {item_kind.simpleString()}, item_start long, n_words long"

    def make(batch: pa.RecordBatch, flat: pa.Array, bounds: np.ndarray, tests: Tests) -> pa.RecordBatch:
        got = search(flat, bounds, tests).matches.sort_values(["item", "item_start"]).reset_index(drop=True)
        before = got.shift(1)
        part = (got["item"] == before["item"]) & (got["item_start"] == before["item_start"] + 1) & (got["n_words"] == before["n_words"] - 1)
        got = got[~part]
        ids = batch.column("doc_id").take(pa.array(got["text"].to_numpy(), pa.int64()))
        items = pd.Series([tests.ids[i] for i in got["item"]], dtype=object)
        return pa.RecordBatch.from_arrays([ids, pa.array(got["start"], pa.int64()), pa.array(items.tolist(), _arrow(item_kind)), pa.array(got["item_start"], pa.int64()), pa.array(got["n_words"], pa.int64())], names=["doc_id", "start", "item_id", "item_start", "n_words"])

    out = None
    for tests in _blocks(benchmark, window, block_words):
        one = _each(documents, tests, make, schema, ["doc_id", "text"], shard_bytes)
        out = one if out is None else out.unionByName(one)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window of an item), items (the ids as strings, sorted) and key of each document.

    A null or empty text has no words; texts of any length are searched whole; a null doc_id or item_id is a value like others (the
    text `null` for an item); repeated documents get a row each, repeated items count once for each id; an empty benchmark hits
    nothing and empty documents give no rows; other columns, whatever their names, are not read. Ids may be of any type.

    A benchmark of more than block_words words is searched block by block: the first pass gives all documents, later ones only
    those hit, by which the first pass's rows are completed.
    """
    spark = documents.sparkSession
    ship(spark)
    kind = documents.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, key binary, n_words long, hits array<array<int>>, items array<string>"
    rows = documents.select("doc_id", "text").withColumn("key", doc_key())

    def maker(all_rows: bool):
        def make(batch: pa.RecordBatch, flat: pa.Array, bounds: np.ndarray, tests: Tests) -> pa.RecordBatch:
            found = search(flat, bounds, tests)
            hits: list = [[] for _ in range(batch.num_rows)]
            for text, start, size in found.spans.tolist():
                hits[text].append((start, start + size))
            items: list = [[] for _ in range(batch.num_rows)]
            for text, item in found.pairs.tolist():
                items[text].append(str(tests.ids[item]) if tests.ids[item] is not None else "null")
            keep = np.arange(batch.num_rows) if all_rows else np.unique(found.pairs[:, 0])
            take = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(np.diff(bounds)[keep], pa.int64()), pa.array([_merged(hits[i]) for i in keep], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(set(items[i])) for i in keep], pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "hits", "items"],
            )

        return make

    passes = [_each(rows, tests, maker(i == 0), schema, ["doc_id", "text", "key"], shard_bytes) for i, tests in enumerate(_blocks(benchmark, window, block_words))]
    if not passes:
        passes = [_each(rows, tests_of([], [], window), maker(True), schema, ["doc_id", "text", "key"], shard_bytes)]
    out = passes[0]
    if len(passes) > 1:
        more = passes[1]
        for one in passes[2:]:
            more = more.unionByName(one)
        more = more.dropDuplicates(["key", "items", "hits"]).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))  # as many rows a key as blocks
        out = out.join(more.hint("shuffle_merge"), "key", "left")
        both = F.array_sort(F.concat("hits", F.coalesce("more_hits", F.array().cast("array<array<int>>"))))
        # intervals in order: each adds what lies behind the furthest end so far
        n = F.aggregate(both, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["end"], x[1]).alias("end"), (s["n"] + F.greatest(F.lit(0), x[1] - F.greatest(s["end"], x[0]))).cast("long").alias("n")))["n"]
        items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))))
        return out.select("doc_id", "n_words", n.alias("n_hit"), items.alias("items"), "key")
    return out.select("doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x[1] - x[0]).cast("long")).alias("n_hit"), "items", "key")


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    key = fresh_name(documents, "_key")
    bad = contamination(documents, benchmark, **options).where("n_hit > 0").select(F.col("key").alias(key)).distinct()
    return documents.withColumn(key, doc_key()).join(bad.hint("shuffle_merge"), key, "left_anti").select(*documents.columns)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination over all `documents` and `benchmark`, its docstring gives the results for nulls, empty and long texts, ties, repeats
    and empty tables."""
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    """The digest of a sorted list of ids."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dg AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k)),
f AS (SELECT DISTINCT r, i, k, item FROM dg JOIN win USING (g, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM f)) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
