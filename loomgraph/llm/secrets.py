"""Secret scans: known key forms, and values in a credential's place whose guessing would be costly."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ship, slices, split_words, table

#: The base forms, in the order in which kinds are listed. A match counts only from its least length on.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

_NAMES = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:access|auth|bearer|refresh|session|id)?[_-]?token|(?:api|access|private|encryption|signing|license|account)[_-]?key"
    r"|credentials?|auth(?:orization)?|pin(?:code)?|client[_-]secret)[\"']?\x20*(?::=|=>|[:=]|\x20is\x20)"
)
#: Names that make what follows a credential; the guess cost decides whether it is one. A value reaches to its delimiter.
CONTEXT = re.compile(
    r"(?<![A-Za-z])" + _NAMES + r"\x20*(?:Bearer\x20+|Basic\x20+)?(?:\"([^\"\s]{4,})\"|'([^'\s]{4,})'|([^\s\"'<>]{4,}))"
    r"|(?<![A-Za-z])Bearer\x20+([A-Za-z0-9+/_.=~-]{4,})|(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/@]{4,})@", re.I | re.A)  # fmt: skip
#: RE2: a text without this has neither a base form nor a credential's place.
_MAY_HOLD = "(?i:" + _NAMES + r"|bearer\x20|://[^\s/:@]+:)|AKIA|[0-9a-f]{24}"

#: log10 of the guesses from which a value in a credential's place is reported.
LEAST_COST = 8.0

#: Passwords and words that are tried first, in the order of their rank. Words of the corpus follow, by frequency.
WORDS = (
    "password 123456 admin letmein welcome qwerty monkey dragon master login abc123 iloveyou sunshine princess football secret summer winter spring autumn "
    "test guest root user default changeme example sample dummy placeholder none null true false string value token key apikey access your my the name word "
    "hello world love baby angel shadow super star magic freedom whatever trustno1 hunter killer soccer hockey batman superman pokemon michael jordan charlie "
    "required optional enabled disabled redacted hidden removed unknown expired invalid missing reset change enter type here new old private public"
).split()


class Ranks(dict):
    """Guesses of a word: its place in a list that begins with WORDS."""

    def __init__(self, words: Iterable[str] = ()):
        super().__init__((w, i) for i, w in enumerate(dict.fromkeys([*WORDS, *words]), 1))
        self.longest = max(map(len, self))


RANK = Ranks()
#: Words of the corpus in the ranked list, and how often each has to occur. A word beyond costs what its other segments cost.
MOST_WORDS, LEAST_COUNT = 100_000, 3
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("01345780@$!", "oieastbo" + "asi")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
#: A value that only names where the credential is kept.
_REFERENCE = re.compile(r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|<[^<>]*>|%\w+%|\$[A-Za-z_]\w*")


@lru_cache(1)
def _neighbours() -> dict[str, set[str]]:
    at = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {a: {b for b, (s, y) in at.items() if b != a and abs(r - s) <= 1 and abs(x - y) <= 1} for a, (r, x) in at.items()}


def _class_size(text: str) -> int:
    size = 26 * bool(re.search("[a-z]", text)) + 26 * bool(re.search("[A-Z]", text)) + 10 * bool(re.search(r"\d", text)) + 33 * bool(re.search(r"[^A-Za-z0-9]", text))
    return 16 if re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", text) else max(size, 10)


def segments_from(value: str, ranks: Ranks = RANK) -> Callable[[int], list[tuple[int, float]]]:
    """A function from a start to (end, log10 of the guesses) of every word, date, repeat, keyboard walk and sequence there."""
    n = len(value)
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = lower.translate(_LEET)
    near = _neighbours()
    brute = math.log10(_class_size(value))
    dates = {m.start(): m.end() for m in _DATE.finditer(value)}
    longest = ranks.longest

    @lru_cache(None)
    def at(i: int) -> list[tuple[int, float]]:
        out = []
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(lower[i:j]) or ranks.get(plain[i:j])
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                changed = sum(a != b for a, b in zip(lower[i:j], plain[i:j], strict=True)) if lower[i:j] not in ranks else 0
                out.append((j, math.log10(rank + 1) + (math.log10(2) if upper in (1, j - i) else 0.3 * upper) + 0.5 * changed))
        if i in dates:
            out.append((dates[i], math.log10(365 * 120) if dates[i] - i > 4 else math.log10(120)))
        for unit in range(1, 9):  # repeats of one to eight code points
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            k = (j - i) // unit
            if k >= (3 if unit == 1 else 2):
                out.append((i + k * unit, unit * brute + math.log10(k)))
        j = i + 1  # keyboard walks and runs of consecutive code points
        while j < n and lower[j] in near.get(lower[j - 1], ()):
            j += 1
        if j - i >= 3:
            out.append((j, math.log10(47) + (j - i - 1) * math.log10(2.5)))
        step = ord(value[i + 1]) - ord(value[i]) if i + 1 < n else 0
        j = i + 1
        while j < n and step in (1, -1) and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if j - i >= 3:
            out.append((j, math.log10(40) + math.log10(j - i)))
        return out

    return at


def guess_cost(value: str, limit: float = math.inf, ranks: Ranks = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation into words, dates, repeats, keyboard walks, sequences and brute-force spans.

    A k-segment cover costs the product of its segments' guesses times k!: an attacker doesn't know their order. Covers
    are searched cheapest first, each position's segments being found when it is reached; a cost of `limit` or more is a
    lower bound, as the search ends when no cheaper cover is left. The whole value counts, whatever its length.
    """
    n = len(value)
    if not n:
        return 0.0
    brute = math.log10(_class_size(value))
    segments = segments_from(value, ranks)
    # states: cost, end, number of segments, whether the last one is brute force; a run of brute force is one segment
    heap, done = [(0.0, 0, 0, False)], set()
    while True:
        cost, i, k, run = heapq.heappop(heap)
        if i == n or cost >= limit:
            return cost
        if (i, k, run) in done:
            continue
        done.add((i, k, run))
        more = math.log10(k + 1)
        heapq.heappush(heap, (cost + brute + (0.0 if run else more), i + 1, k + (not run), True))
        for j, price in segments(i):
            heapq.heappush(heap, (cost + more + price, j, k + 1, False))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, held) of every value in a credential's place, those of base assignments included; held: a base span holds it."""
    values = {m.span(2) for start, kind, _ in base if not kind and (m := ASSIGN.match(text, start))}
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        if group:
            start, value = m.start(group), m[group] if group in (1, 2, 5) else m[group].rstrip(".,;)]}!?")
            if value and not _REFERENCE.fullmatch(value):
                values.add((start, start + len(value)))
    out, reach, at = [], 0, 0
    for start, end in sorted(values):
        while at < len(base) and base[at][0] <= start:
            reach, at = max(reach, base[at][2]), at + 1
        out.append((start, end, end <= reach))
    return out


def judged_values(text: str, base: list[tuple[int, int, int]], least_cost: float = LEAST_COST, ranks: Ranks = RANK) -> list[tuple[int, int, bool, bool]]:
    """Of each credential value start, end, whether a base span holds it, and whether it would take at least 10 ** least_cost guesses."""
    return [(a, b, held, guess_cost(text[a:b], least_cost, ranks) >= least_cost) for a, b, held in credential_values(text, base)]


def guessed_spans(text: str, base: list[tuple[int, int, int]], least_cost: float = LEAST_COST, ranks: Ranks = RANK) -> list[tuple[int, int, int]]:
    """Spans of credential values that base spans don't hold and that would take at least 10 ** least_cost guesses."""
    return [(a, 3, b) for a, b, held, hard in judged_values(text, base, least_cost, ranks) if hard and not held]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _suspects(text: pa.Array) -> Iterator[tuple[int, str]]:
    """Row and text of those that may hold a secret; RE2 leaves out the others."""
    rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, _MAY_HOLD), False).to_numpy(zero_copy_only=False))
    return zip(rows.tolist(), text.take(pa.array(rows, pa.int64())).to_pylist(), strict=True)


def learn_words(documents: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> Ranks:
    """The ranked word list: WORDS, then the words of three letters and more that occur most often in all texts.

    What stands in a credential's place doesn't count, so that a password in many copies of a text stays no word. Words are
    counted a slice at a time, then summed; at most `most` of them, those with `least` occurrences, reach the driver.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            changed, rows = [], []
            for i, value in _suspects(text):
                base = base_spans(value)
                spans = [*base, *[(a, 3, b) for a, b, _ in credential_values(value, base)]]
                if spans:
                    rows.append(i)
                    changed.append(redacted(value, spans, " "))
            keep = np.ones(len(text), bool)
            keep[rows] = False
            distinct, codes, _ = split_words(pa.concat_arrays([text.filter(pa.array(keep)), pa.array(changed, text.type)]))
            words = pc.utf8_lower(pc.replace_substring_regex(distinct, r"^[^\p{L}]+|[^\p{L}]+$", ""))
            good = pc.match_substring_regex(words, r"^\p{L}{3,40}$")
            counted = pa.table({"word": words, "n": np.bincount(codes, minlength=len(distinct))}).filter(good).group_by("word").aggregate([("n", "sum")])
            yield pa.RecordBatch.from_arrays([counted["word"].combine_chunks(), counted["n_sum"].combine_chunks().cast(pa.int64())], names=["word", "n"])

    counts = documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Ranks(r["word"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect())


def scan(documents: DataFrame, least_cost: float = LEAST_COST, ranks: Ranks | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, all spans as text, and what the guess cost was asked for.

    n_values counts the values in a credential's place, in base spans or not: the cost of each is asked for; n_weak of them
    take fewer than 10 ** least_cost guesses; n_guess others, which no base span holds, are added as spans of kind guess.
    ranks: the word list, learned from the documents if none is given.

    Offsets are code points, ends exclusive. A null or empty text has no spans; texts and values of any length are read
    whole; overlapping spans of different kinds are all given, by start and then kind. Repeated rows are scanned each, an
    empty table gives no rows, and other columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    words = spark.sparkContext.broadcast(ranks or learn_words(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_values", "n_weak"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = np.zeros((6, batch.num_rows), np.int64)
            digests, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            for i, text in _suspects(batch.column("text")):
                base = base_spans(text)
                values = judged_values(text, base, least_cost, words.value)
                guessed = [(a, 3, b) for a, b, held, hard in values if hard and not held]
                kinds = [k for _, k, _ in base]
                counts[:, i] = kinds.count(0), kinds.count(1), kinds.count(2), len(guessed), len(values), sum(not hard for *_, hard in values)
                digests[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + guessed)
            columns = [batch.column("doc_id"), *map(pa.array, counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), *map(pa.array, counts[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_values long, n_weak long"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_column(documents: DataFrame, least_cost: float = LEAST_COST, ranks: Ranks | None = None) -> DataFrame:
    """The same rows and columns with secrets in `text` replaced, and n_chars, where there is one, counted anew.

    Null and empty texts stay as they are, long ones are read whole; repeated rows, nulls elsewhere and columns of any
    name are passed on; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    words = spark.sparkContext.broadcast(ranks or learn_words(documents))
    names = documents.columns
    counted = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, texts = [], []
            for i, text in _suspects(batch.column("text")):
                base = base_spans(text)
                new = redacted(text, base + guessed_spans(text, base, least_cost, words.value))
                if new != text:
                    rows.append(i)
                    texts.append(new)
            fresh = {}
            if rows:
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                fresh["text"] = pc.replace_with_mask(batch.column("text"), pa.array(mask), pa.array(texts, batch.schema.field("text").type))
                if counted:
                    fresh["n_chars"] = pc.replace_with_mask(batch.column("n_chars"), pa.array(mask), pa.array([len(t) for t in texts], batch.schema.field("n_chars").type))
            yield pa.RecordBatch.from_arrays([fresh.get(c, batch.column(c)) for c in names], names=names)

    return documents.mapInArrow(run, documents.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan over all `documents`; its docstring gives the results for nulls, empty and long texts, repeats and empty tables."""
    return scan(table(spark, sf_dir, "documents"))
