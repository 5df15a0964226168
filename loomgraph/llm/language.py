"""Language ID: a linear-chain conditional random field labels the words of code-switched text by forward-backward."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fold_of, mix, ship, slices, split_words, table

BUCKETS = 1 << 15
#: Words of a block. A text is one chain, computed in blocks between which the messages are passed on.
CHAIN = 32
#: Code points of a label's unit: a longer run without white space, as scripts without it have, is labelled piece by piece.
PIECE = 24
UNKNOWN = "und"
#: A lexicon word occurs so often in the sample, and so often in one language.
LEXICON_LEAST, LEXICON_SHARE = 3, 0.8
#: Blocks that one step holds in arrays.
BLOCKS = 20_000


@dataclass
class Crf:
    labels: list[str]
    emission: np.ndarray  # (BUCKETS + labels, labels): hashed affixes and n-grams, then lexicon membership
    transition: np.ndarray  # from, to
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # (words, labels) of 0 and 1


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words, PIECE), 0 behind the end, and lengths."""
    codes = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)
    return codes, np.array([len(w) for w in words])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's features (-1: none) and the word's own hash: prefixes and suffixes of 1 to 4 code points,
    2- and 3-grams over the word with a mark at either end, and the whole word."""
    codes, size = _matrix(words)
    n, width = codes.shape
    rows = np.arange(n)
    wide = np.zeros((n, width + 2), np.uint64)
    wide[:, 0] = 2
    wide[:, 1:-1] = codes
    wide[rows, size + 1] = 3
    columns = []

    def add(value: np.ndarray, kind: int, ok: np.ndarray) -> None:
        columns.append(np.where(ok, (mix(value * np.uint64(31) + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int32), -1))

    prefix = np.zeros(n, np.uint64)
    for i in range(4):
        prefix = prefix * np.uint64(1000003) + wide[:, i + 1]
        add(prefix, 11 + i, size > i)
    suffix = np.zeros(n, np.uint64)
    for i in range(4):
        suffix = suffix * np.uint64(1000003) + wide[rows, np.maximum(size - i, 0)]
        add(suffix, 21 + i, size > i)
    for i in range(width + 1):
        if not (live := size >= i).any():
            break
        two = wide[:, i] * np.uint64(1000003) + wide[:, i + 1]
        add(two, 31, live)
        if i < width:
            add(two * np.uint64(1000003) + wide[:, i + 2], 32, size > i)
    whole = size.astype(np.uint64)
    for i in range(width):
        whole = whole * np.uint64(1000003) + codes[:, i]
    whole = mix(whole)
    add(whole, 41, size > 0)
    return np.stack(columns, axis=1), whole


#: Log weights this far below a word's best count as this far.
_FLOOR = -60.0


def _emit(model: Crf, words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros((0, len(model.labels)), np.float32)
    out = []
    for i in range(0, len(words), 50_000):
        buckets, own = features(words[i : i + 50_000])
        scores = np.zeros((len(own), len(model.labels)), np.float32)
        for j in range(buckets.shape[1]):
            live = buckets[:, j] >= 0
            scores[live] += model.emission[buckets[live, j]]
        if len(model.lexicon):
            at = np.minimum(np.searchsorted(model.lexicon, own), len(model.lexicon) - 1)
            known = model.lexicon[at] == own
            scores[known] += model.member[at[known]] @ model.emission[BUCKETS:]
        out.append(scores)
    return np.concatenate(out)


def forward_backward(emission: np.ndarray, live: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, CHAIN, labels) and transition expectations (labels, labels) of chains that are live from the left."""
    chains, width, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a, t = np.empty_like(e), np.exp(transition).astype(e.dtype)
    a[:, 0] = e[:, 0] * np.exp(start - start.max()).astype(e.dtype)
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, width):
        a[:, i] = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
    b = np.ones((chains, labels), e.dtype)
    marginal, pairs = np.empty_like(e), np.zeros((labels, labels))
    for i in range(width - 1, -1, -1):
        m = a[:, i] * b
        marginal[:, i] = m / m.sum(axis=1, keepdims=True)
        if i:
            inner = np.where(live[:, i, None], e[:, i] * b, 0)
            left = a[:, i - 1]
            mass = np.einsum("ci,ij,cj->c", left, t, inner)
            scale = np.where(live[:, i], 1 / np.maximum(mass, 1e-30), 0)
            pairs += t * ((left * scale[:, None]).T @ inner)
            back = (e[:, i] * b) @ t.T
            b = np.where(live[:, i, None], back / back.sum(axis=1, keepdims=True), 1)
    return marginal, pairs


def marginals(emission: np.ndarray, live: np.ndarray, transition: np.ndarray, prior: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Marginals (blocks, CHAIN, labels), given what comes before each block's first word (prior) and behind its last (after)."""
    e = np.exp(np.maximum(emission - emission.max(axis=2, keepdims=True), _FLOOR))
    a, t = np.empty_like(e), np.exp(transition).astype(e.dtype)
    a[:, 0] = e[:, 0] * prior
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, e.shape[1]):
        a[:, i] = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
    b = after
    for i in range(e.shape[1] - 1, -1, -1):
        back = ((e[:, i] * b) @ t.T) if i else None
        a[:, i] *= b
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
        if i:
            b = np.where(live[:, i, None], back / back.sum(axis=1, keepdims=True), b)
    return a


def _products(emission: np.ndarray, live: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Of each block the matrix that takes the message into its first word to that at its last, up to a factor."""
    e = np.exp(np.maximum(emission - emission.max(axis=2, keepdims=True), _FLOOR))
    t = np.exp(transition).astype(e.dtype)
    k = e.shape[2]
    out = np.eye(k, dtype=e.dtype)[None] * e[:, 0, None, :]
    for i in range(1, e.shape[1]):
        following = (out @ t) * e[:, i, None, :]
        following /= following.max(axis=(1, 2), keepdims=True)
        out = np.where(live[:, i, None, None], following, out)
    return out


def messages(products: np.ndarray, first: np.ndarray, many: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes before and behind each block: blocks first[t] to first[t] + many[t] - 1 are text t's, and all texts advance together."""
    t, k = np.exp(transition).astype(products.dtype), len(start)
    prior, after = np.ones((len(products), k), products.dtype), np.ones((len(products), k), products.dtype)
    order = np.argsort(-many, kind="stable")
    first, many = first[order], many[order]
    head = np.exp(start - start.max()).astype(products.dtype)
    ahead, back = np.tile(head, (len(many), 1)), np.ones((len(many), k), products.dtype)
    for j in range(int(many.max(initial=0))):
        n = int(np.searchsorted(-many, -j, "left"))  # texts with more than j blocks
        rows = first[:n] + j
        prior[rows] = ahead[:n]
        ahead = np.einsum("nk,nkl->nl", ahead[:n], products[rows]) @ t
        ahead /= ahead.sum(axis=1, keepdims=True)
        rows = first[:n] + many[:n] - 1 - j
        after[rows] = back[:n]
        back = np.einsum("nkl,nl->nk", products[rows], back[:n]) @ t.T
        back /= back.sum(axis=1, keepdims=True)
    return prior, after


def _words(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words with a letter (of a run of over PIECE code points its pieces), the code of each in text order,
    where each text's begin."""
    distinct, codes, bounds = split_words(text)
    lowered = pc.utf8_lower(distinct)
    lowered = pc.replace_substring_regex(lowered, r"^[^\p{L}]+|[^\p{L}]+$", "")
    encoded = lowered.dictionary_encode()
    values = encoded.dictionary.to_pylist()
    codes = encoded.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
    keep = np.array([bool(v) for v in values], bool)[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    codes, bounds = codes[keep], before[bounds]
    long = [i for i, v in enumerate(values) if len(v) > PIECE]
    if long:
        n = len(values)
        parts = [[values[i][j : j + PIECE] for j in range(0, len(values[i]), PIECE)] for i in long]
        values = [v[:PIECE] for v in values] + [p for ps in parts for p in ps]
        at, size = np.arange(n), np.ones(n, np.int64)
        size[long] = [len(ps) for ps in parts]
        at[long] = n + np.cumsum(size[long]) - size[long]
        each = size[codes]
        done = np.concatenate([[0], np.cumsum(each)])
        codes, bounds = np.repeat(at[codes] - done[:-1], each) + np.arange(done[-1]), done[bounds]
    return values, codes, bounds


def _blocks(bounds: np.ndarray, lo: int, hi: int, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (blocks, CHAIN) of blocks lo to hi - 1, and which of them are words."""
    text = owner[lo:hi]
    start = bounds[:-1][text] + (np.arange(lo, hi) - first[text]) * CHAIN
    at = start[:, None] + np.arange(CHAIN)
    live = at < bounds[1:][text][:, None]
    return np.where(live, at, 0), live


def labelled(model: Crf, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the sums of its words' marginals (texts, labels), its words, and words whose likeliest language isn't that of the word before."""
    values, codes, bounds = _words(text)
    n, k = len(text), len(model.labels)
    emission = _emit(model, values)
    many = -(-np.diff(bounds) // CHAIN)
    first, owner = np.cumsum(many) - many, np.repeat(np.arange(n), many)
    products = [np.zeros((0, k, k), np.float32)]
    for lo in range(0, len(owner), BLOCKS):
        at, live = _blocks(bounds, lo, min(lo + BLOCKS, len(owner)), first, owner)
        products.append(_products(emission[codes[at]], live, model.transition))
    prior, after = messages(np.concatenate(products), first, many, model.transition, model.start)
    total, switches, last = np.zeros((n, k)), np.zeros(n, np.int64), (-1, -1)
    for lo in range(0, len(owner), BLOCKS):
        hi = min(lo + BLOCKS, len(owner))
        at, live = _blocks(bounds, lo, hi, first, owner)
        marginal = marginals(emission[codes[at]], live, model.transition, prior[lo:hi], after[lo:hi]) * live[:, :, None]
        each = marginal.sum(axis=1)
        for j in range(k):
            total[:, j] += np.bincount(owner[lo:hi], each[:, j], minlength=n)
        best, whose = marginal.argmax(axis=2)[live], np.repeat(owner[lo:hi], live.sum(axis=1))
        changed = (np.diff(best, prepend=last[1]) != 0) & (np.diff(whose, prepend=last[0]) == 0)
        switches += np.bincount(whose[changed], minlength=n)
        last = (whose[-1], best[-1])
    return total, np.diff(bounds), switches


def fit(texts: list[str], langs: list[str], epochs: int = 3, rate: float = 0.15, seed: int = 7) -> Crf:
    """Stochastic gradient on chains spliced from spans of texts of several languages, so that transitions are learned too.

    No text or a single language: a model that names that language, or `und`.
    """
    labels = sorted(set(langs)) or [UNKNOWN]
    number = {x: i for i, x in enumerate(labels)}
    values, codes, bounds = _words(pa.array(texts, pa.string()))
    sizes = np.diff(bounds)
    gold = np.repeat(np.array([number[x] for x in langs], np.int64), sizes) if len(texts) else np.zeros(0, np.int64)
    k = len(labels)
    buckets, own = features(values) if values else (np.zeros((0, 1), np.int32), np.zeros(0, np.uint64))
    counts = np.zeros((len(values), k))
    np.add.at(counts, (codes, gold), 1)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    chosen: list[int] = []
    for j in range(k):
        chosen += list(np.flatnonzero((counts[:, j] >= LEXICON_LEAST) & (share[:, j] >= LEXICON_SHARE)))
    chosen_array = np.array(sorted(set(chosen), key=lambda i: own[i]), np.int64)
    lexicon = own[chosen_array] if len(chosen) else np.zeros(0, np.uint64)
    member = (share[chosen_array] >= LEXICON_SHARE).astype(np.float32) if len(chosen) else np.zeros((0, k), np.float32)
    model = Crf(labels, np.zeros((BUCKETS + k, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32), lexicon, member)
    if k == 1 or not len(codes):
        return model
    in_lexicon = np.full((len(values), k), 0, np.float32)
    if len(chosen):
        in_lexicon[chosen_array] = member
    extra = np.where(in_lexicon > 0, BUCKETS + np.arange(k), -1).astype(np.int32)
    wide = np.concatenate([buckets, extra], axis=1)
    rng = np.random.default_rng(seed)
    # spans of 4 to 16 words, in random order: neighbours are of other texts and often of another language
    cuts, at = [], 0
    for size in sizes:
        stop = at + size
        while at < stop:
            step = int(rng.integers(4, 17))
            cuts.append((at, min(at + step, stop)))
            at = min(at + step, stop)
    batch = 64 * CHAIN
    square = np.full(model.emission.shape, 1e-2, np.float32)
    square_t, square_s = np.full((k, k), 1e-2), np.full(k, 1e-2)
    for _ in range(epochs):
        order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))])
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            chains = -(-len(at) // CHAIN)
            pad = chains * CHAIN - len(at)
            live = (np.arange(chains * CHAIN) < len(at)).reshape(chains, CHAIN)
            at = np.concatenate([at, np.repeat(at[:1], pad)])
            feats = wide[codes[at]]
            weights = np.where(feats[:, :, None] >= 0, model.emission[feats], 0)
            emission = weights.sum(axis=1).reshape(chains, CHAIN, k)
            marginal, pairs = forward_backward(emission, live, model.transition, model.start)
            truth = np.zeros((len(at), k), np.float32)
            truth[np.arange(len(at)), gold[at]] = 1
            error = ((marginal.reshape(-1, k) - truth) * live.reshape(-1, 1)) / len(at)
            grad = np.zeros_like(model.emission)
            index = feats.ravel()
            on = index >= 0
            spread = np.repeat(error, feats.shape[1], axis=0)[on]
            for j in range(k):
                grad[:, j] = np.bincount(index[on], spread[:, j], minlength=len(grad))
            square += grad**2
            model.emission -= rate * grad / np.sqrt(square + 1e-8)
            y = gold[at].reshape(chains, CHAIN)
            observed = np.zeros((k, k))
            both = live[:, 1:]
            np.add.at(observed, (y[:, :-1][both], y[:, 1:][both]), 1)
            grad_t = (pairs - observed) / len(at) + 1e-4 * model.transition
            square_t += grad_t**2
            model.transition -= (rate * grad_t / np.sqrt(square_t)).astype(np.float32)
            grad_s = (marginal[:, 0] - truth.reshape(chains, CHAIN, k)[:, 0]).mean(axis=0)
            square_s += grad_s**2
            model.start -= (rate * grad_s / np.sqrt(square_s)).astype(np.float32)
    return model


def learn(documents: DataFrame, per_language: int = 150, most_bytes: int = 200_000) -> Crf:
    """Fits on at most per_language whole texts of at most most_bytes of each lang value outside fold 0, those with the smallest id hashes.

    A first pass counts such texts of each lang value (the model's labels, so they are few), so that the second fetches about
    that many of each and no more than twice: at most 2 * per_language * most_bytes a language.
    """
    usable = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.octet_length("text") <= most_bytes) & (fold_of(F.col("doc_id")) != 0))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    key = F.xxhash64(F.col("doc_id"), F.lit(11))
    if counts:
        share = F.lit(0.0)
        for lang, n in counts.items():
            share = F.when(F.col("lang") == lang, min(1.0, (1.5 * per_language + 20) / n)).otherwise(share)
        near = usable.where((F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)) < share)
        by: dict[str, list] = {}
        for r in sorted(near.select("lang", key.alias("key"), "doc_id", "text").collect(), key=lambda r: (r["lang"], r["key"], r["doc_id"], r["text"])):
            by.setdefault(r["lang"], []).append(r)
        rows = [r for lang in sorted(by) for r in by[lang][:per_language]]
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(documents: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score and switches of every row.

    score is the mean over all words of the predicted language's marginal; switches counts words whose likeliest
    language differs from that of the word before. A null or empty text, or one without a letter, is `und` with score 0.
    A text of any length is one chain; of languages with equal sums the first by name wins. Repeated rows are predicted
    each; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    labels = np.array([*model.labels, UNKNOWN], object)
    k = len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, words, switches = labelled(model, batch.column("text"))
            best = np.where(words > 0, total.argmax(axis=1), k)
            score = np.where(words > 0, total.max(axis=1) / np.maximum(words, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(switches)], names=["doc_id", "lang_pred", "score", "switches"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, switches long")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict over all `documents`; its docstring gives the results for nulls, empty and long texts, ties, repeats and empty tables."""
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return predict(documents, learn(documents)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "switches")
