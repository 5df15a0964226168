"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, fold_of, ship, slices, table

#: Letters of other scripts that look like a Latin letter, invisible characters (dropped).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}
#: Digits and signs written for a letter inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: A phrase of a lexicon word and its neighbour is an exception from so many harmless labelled texts on, if no toxic one has it.
SPARED_LEAST = 5

_TABLE = str.maketrans(HOMOGLYPHS)
_SIGNS = re.compile(r"(?<![^\W\d_])[01345783@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![\w@$])")
_ANY_SIGN = re.compile(r"[0-9@$]")
_LETTERS = re.compile(r"[^\W\d_]+")
_TO_LETTER = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes as plain letters, digits and signs inside words as letters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_TABLE)
    if _ANY_SIGN.search(text):
        text = _SIGNS.sub(lambda m: m[0].translate(_TO_LETTER), text)
    return text


@dataclass
class Lexicon:
    """terms: weight of a pattern; a pattern that ends with a space is a whole word, another one the start of a word.

    exceptions: phrases in which a lexicon word is meant harmlessly; a match inside one does not count.
    bias, slopes: of the logistic curve over log1p(weight found) and log1p(100 * weight found / words).
    """

    terms: dict[str, float]
    bias: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    exceptions: tuple[str, ...] = ()
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_machine"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_machine": None}

    def machine(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            patterns: dict[str, tuple[float, float, bool]] = {}
            for term, weight in self.terms.items():
                word = term.rstrip(" ")
                start, whole, _ = patterns.get(word, (0.0, 0.0, False))
                patterns[word] = (start, weight, False) if term.endswith(" ") else (weight, whole, False)
            for phrase in self.exceptions:
                start, whole, _ = patterns.get(phrase, (0.0, 0.0, False))
                patterns[phrase] = (start, whole, True)
            for word, value in patterns.items():
                machine.add_word(word, (len(word), *value))
            if patterns:
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def found(self, folded: str) -> tuple[int, float]:
        """Words matched outside exception phrases, and their weight: the largest pattern counts for each word."""
        machine = self.machine()
        if not len(machine):
            return 0, 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        last = len(folded) - 1
        for end, (size, start_weight, whole_weight, exception) in machine.iter(folded):
            begin = end - size + 1
            if begin and folded[begin - 1].isalpha():
                continue
            ends = end == last or not folded[end + 1].isalpha()
            if exception and ends:
                spared.append((begin, end))
            weight = max(start_weight, whole_weight) if ends else start_weight
            if weight > hits.get(begin, 0.0):
                hits[begin] = weight
        if spared:
            starts, reach = [], []
            for x, y in sorted(spared):
                starts.append(x)
                reach.append(max(y, reach[-1] if reach else y))
            hits = {b: w for b, w in hits.items() if not (i := bisect_right(starts, b)) or reach[i - 1] < b}
        return len(hits), sum(hits.values())

    def score(self, weight: float, words: int) -> float:
        z = self.bias + self.slopes[0] * math.log1p(weight) + self.slopes[1] * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


PREFIXES = range(4, 11)


def _terms(text: str) -> set[str]:
    out = set()
    for word in set(_LETTERS.findall(fold(text))):
        if len(word) >= 3:
            out.add(word + " ")
            out.update(word[:n] for n in PREFIXES if n <= len(word))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_terms(text or ""))
        terms = list(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([counts[1][t] for t in terms], pa.int64()), "good": pa.array([counts[0][t] for t in terms], pa.int64())})


def _phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Each word of the lexicon with the word before or behind it, one space between."""
    out: set[str] = set()
    folded = fold(text)
    words = [(m.start(), m.end(), m[0]) for m in _LETTERS.finditer(folded)]
    known = {w: lexicon.found(w)[0] > 0 for w in {w for *_, w in words}}
    for (_, end, a), (start, _, b) in zip(words, words[1:], strict=False):
        if (known[a] or known[b]) and folded[end:start] == " ":
            out.add(f"{a} {b}")
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = 8000, scratch: Scratch | None = None) -> Lexicon:
    """A lexicon from labelled rows outside fold 0.

    At most max_labelled rows are used, half of them of each label, in the order of a hash of the id; a document
    labelled twice counts as toxic if any label says so. Weights are log odds of the share of toxic and other
    documents that hold a word or the start of a word. Phrases with a lexicon word that SPARED_LEAST harmless texts and no toxic
    one hold are exceptions. A quarter of the rows fits the curve and not the weights. Without labels the lexicon is empty.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "toxicity")
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    half = max_labelled // 2
    chosen = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("fits_curve"))
    rows = scratch.save(rows.repartition(max(8, spark.sparkContext.defaultParallelism)), "labelled")
    size = {r["toxic"]: r["n"] for r in rows.where(~F.col("fits_curve")).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = size.get(1, 0), size.get(0, 0)
    least = 2 if n_bad < 200 else 4 if n_bad < 1500 else 6
    counts = rows.where(~F.col("fits_curve")).select("text", "toxic").mapInArrow(_count_terms, "term string, bad long, good long")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    best = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least).withColumn("odds", odds)
    best = best.where(F.col("odds") >= 2.2)
    terms: dict[str, float] = {}
    for row in sorted(best.collect(), key=lambda r: (len(r["term"]), r["term"])):
        word = row["term"].rstrip(" ")
        shorter = max((terms.get(word[:n], 0.0) for n in PREFIXES if n <= len(word)), default=0.0)
        if row["odds"] > shorter + 0.25:  # else the shorter pattern says as much
            terms[row["term"]] = float(row["odds"])
    lexicon = Lexicon(terms)

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(_phrases(text or "", lexicon))
            phrases = list(counts[0])
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrases, pa.string()), "good": pa.array([counts[0][p] for p in phrases], pa.int64()), "bad": pa.array([counts[1][p] for p in phrases], pa.int64())})
            rest = [p for p in counts[1] if p not in counts[0]]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(rest, pa.string()), "good": pa.array([0] * len(rest), pa.int64()), "bad": pa.array([1] * len(rest), pa.int64())})

    if terms:
        spared = rows.where(~F.col("fits_curve")).select("text", "toxic").mapInArrow(count_phrases, "phrase string, good long, bad long").groupBy("phrase").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        lexicon.exceptions = tuple(sorted(r["phrase"] for r in spared.where((F.col("good") >= SPARED_LEAST) & (F.col("bad") == 0)).collect()))
        lexicon = Lexicon(terms, exceptions=lexicon.exceptions)
    seen = _measure(rows.where("fits_curve").select("text", "toxic"), lexicon, "toxic int", ["toxic"]).select("toxic", "weight", "n_words").collect()
    y = np.array([r["toxic"] for r in seen], float)
    if len(set(y)) == 2:
        weight, words = np.array([r["weight"] for r in seen]), np.array([max(r["n_words"], 1) for r in seen])
        x = np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(100 * weight / words)], axis=1)
        w = _logistic(x, y)
        lexicon.bias, lexicon.slopes = float(w[0]), (float(w[1]), float(w[2]))
    scratch.drop("labelled")
    return lexicon


def _measure(df: DataFrame, lexicon: Lexicon, schema: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits, weights, words, scores = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n = len(text.split())
                k, weight = lexicon.found(fold(text))
                hits.append(k)
                weights.append(weight)
                words.append(n)
                scores.append(lexicon.score(weight, n))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(hits, pa.int64()), pa.array(weights, pa.float64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())], names=[*keep, "n_hits", "weight", "n_words", "score"])

    return df.mapInArrow(run, f"{schema}, n_hits long, weight double, n_words long, score double")


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_hits, weight, n_words, score and predicted of each row.

    A null or empty text has no words and no matches and gets the curve's lowest score; a text of any length is scored whole, in
    time proportional to its length. Of patterns that begin at one place the heaviest counts. Repeated rows are scored
    each; an empty table gives no rows; other columns, whatever their names, are not read. No labels at all: an empty
    lexicon, scores under 0.5.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _measure(documents.select("doc_id", "text"), lexicon, f"doc_id {kind}", ["doc_id"]).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score over all `documents`; its docstring gives the results for nulls, empty and long texts, ties, repeats and empty tables."""
    documents = table(spark, sf_dir, "documents")
    lexicon = learn(documents, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return score(documents, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits", "n_words")

