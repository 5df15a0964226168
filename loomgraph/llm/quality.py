"""Quality rules: every rule is evaluated once into a bit and a measurement; policies and ablations work on the ledger."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import hash_strings, ship, slices, split_words, table

WINDOW = 8

#: Each measurement of the ledger.
MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_lines": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_distinct_words": "long", "n_stutter_words": "long", "n_letters": "long", "n_upper": "long",
}


#: Name and failure condition of each rule; its place is its bit, so new rules go to the end.
CONDITIONS = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 3 AND 2 * n_dup_lines > n_lines",
    "upper_case": "n_letters >= 20 AND 2 * n_upper > n_letters",
    "stutter": "n_words >= 20 AND 2 * n_stutter_words > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "no_words": "n_words = 0",
    "few_letters": "n_words >= 20 AND 2 * n_letters < word_chars",
}
RULES = tuple(CONDITIONS)


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: any failed rule of `rejects`, or at least `most` failed rules of `warns`."""

    version: str
    rejects: frozenset[str]
    warns: frozenset[str] = frozenset()
    most: int = 2

    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rejects)

    def kept(self, bits: Column) -> Column:
        warn = sum(1 << RULES.index(r) for r in self.warns)
        return (bits.bitwiseAND(F.lit(self.mask())) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(warn))) < self.most)


BASE = Policy("base", frozenset({"few_words", "repeated_windows"}))
STANDARD = Policy("v1", frozenset({"few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "stutter", "word_length", "no_words", "few_letters"}))
POLICIES = {p.version: p for p in (BASE, STANDARD)}


def _windows(codes: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words of each text inside a window of WINDOW words that the text holds more than once."""
    sizes = np.diff(bounds)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows - bounds[:-1], windows)
    acc = owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(WINDOW):
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + words[starts + i]
    order = np.argsort(acc, kind="stable")
    ordered = acc[order]
    same = np.zeros(len(ordered), bool)
    equal = ordered[1:] == ordered[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    cover = np.zeros(len(codes) + 1, np.int64)
    twice = starts[order[same]]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text; a null text has no words."""
    text = pc.fill_null(text, "")
    n = len(text)
    distinct, codes, bounds = split_words(text)
    words = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(bounds)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(lengths[codes])]) if len(codes) else np.zeros(1, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    pairs = np.unique(owner * (len(distinct) + 1) + codes) if len(codes) else np.zeros(0, np.int64)
    stutter = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    lines = pc.split_pattern(text, "\n")
    flat = lines.flatten()
    encoded = flat.dictionary_encode()
    has_word = pc.match_substring_regex(encoded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_owner = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    keep = has_word[line_codes] if len(line_codes) else np.zeros(0, bool)
    line_codes, line_owner = line_codes[keep], line_owner[keep]
    n_lines = np.bincount(line_owner, minlength=n)
    n_fresh = np.bincount(np.unique(line_owner * (len(encoded.dictionary) + 1) + line_codes) // (len(encoded.dictionary) + 1), minlength=n)

    def count(pattern: str) -> np.ndarray:
        """Of each distinct word, summed over the text."""
        each = pc.count_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each[codes])]) if len(codes) else np.zeros(1, np.int64)
        return total[bounds[1:]] - total[bounds[:-1]]

    return {
        "n_words": sizes,
        "word_chars": running[bounds[1:]] - running[bounds[:-1]],
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - n_fresh,
        "n_repeat_words": _windows(codes, bounds, words),
        "n_distinct_words": np.bincount(pairs // (len(distinct) + 1), minlength=n) if len(pairs) else np.zeros(n, np.int64),
        "n_stutter_words": np.bincount(owner[1:][stutter], minlength=n) if len(owner) > 1 else np.zeros(n, np.int64),
        "n_letters": count(r"\p{L}"),
        "n_upper": count(r"\p{Lu}"),
    }


def ledger(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns named by keep, text too if it is one), every measurement, and failures: bit i says that rule i fails.

    A null or empty text has no words; a text of any length is measured whole; a null doc_id is passed on. An empty table gives no
    rows; repeated rows get a row each; columns that aren't kept, whatever their names, are not read.
    """
    ship(documents.sparkSession)
    keep = keep or ["doc_id"]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    source = documents.select(*keep, *["text"] * ("text" not in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(got[m], pa.int64()) for m in MEASURES]], names=[*keep, *MEASURES])

    rows = source.mapInArrow(run, f"{schema}, " + ", ".join(f"{m} {t}" for m, t in MEASURES.items()))
    bits = F.lit(0)
    for i, fails in enumerate(CONDITIONS.values()):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return rows.withColumn("failures", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds policy (its version) and kept."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", policy.kept(F.col("failures")))


def kept_documents(documents: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows that the policy keeps, with all their columns, whatever these are called.

    Null and empty texts have too few words and go; long texts are measured whole; repeated rows share a fate; an empty table
    gives no rows.
    """
    names = documents.columns
    inner = ["text" if c == "text" else f"_kept_{i}" for i, c in enumerate(names)]
    rows = ledger(documents.toDF(*inner), inner)
    return rows.where(policy.kept(F.col("failures"))).select(*[F.col(a).alias(b) for a, b in zip(inner, names, strict=True)])


def ablations(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Of each rule: documents that fail it, those that fail no other rule of the policy (it alone rejects them), and bits seen with it.

    One aggregation of the ledger by its bit pattern, of which there are at most 2 ** rules, serves all rules.
    """
    mask = policy.mask()
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("own")) for i, r in enumerate(RULES)])
    each = patterns.select("failures", "n", F.inline(bits)).where(F.col("failures").bitwiseAND(F.col("own")) != 0)
    alone = F.when(F.col("failures").bitwiseAND(F.lit(mask)) == F.col("own"), F.col("n")).otherwise(0)
    return each.groupBy("rule").agg(F.sum("n").alias("n_fail"), F.sum(alone).alias("n_only"), F.bit_or("failures").alias("seen_with"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger and the standard policy over all `documents`; ledger's docstring gives the results for nulls, empty and long texts, repeats
    and empty tables."""
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base_failed = ~BASE.kept(F.col("failures"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT r, array_to_string(ws[i:i+7], ' ') AS g, i FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM tw) GROUP BY r),
st AS (SELECT r, count(*) FILTER (WHERE x = y) AS n, sum(length(x)) AS word_chars, count(*) AS n_words,
       sum(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))) AS n_symbols, sum(length(regexp_replace(x, '\P{L}', '', 'g'))) AS letters, sum(length(regexp_replace(x, '\P{Lu}', '', 'g'))) AS upper
       FROM (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY p) AS y FROM f) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines,
       coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS lines, coalesce(st.n, 0) AS stutter, coalesce(letters, 0) AS letters, coalesce(upper, 0) AS upper
       FROM d LEFT JOIN st USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (lines >= 3 AND 2 * n_dup_lines > lines) OR (letters >= 20 AND 2 * upper > letters)
            OR (n_words >= 20 AND 2 * stutter > n_words) OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_words >= 20 AND 2 * letters < word_chars)) AS kept
FROM m
"""
