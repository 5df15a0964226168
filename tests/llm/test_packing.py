import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm.packing import _paths, combinations, encode, nnls, pack, plan

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check_ids(texts):
    ids, at = encode(pa.array(texts, pa.string()), *_paths(None, None))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(text), repr(text)


def test_ids_are_the_librarys():
    check_ids([None, "", " ", "a", " a", "a ", "a  b", "a\nb c", "a \n b", "x y z", "  y", "don't we'll", "é è ß", "日本 語", "1234 abc12", "<|endoftext|> a <|endoftext|>", "a　 b", "tab\t tab", "é x", "🙂 🙂 a", "a\x1c b\x85 c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'.é1日 \r", max_size=25), min_size=1, max_size=4))
def test_ids_of_odd_texts(texts):
    check_ids(texts)


def test_nnls_finds_exact_counts():
    a = np.array([[2.0, 1, 0], [0, 1, 1], [0, 0, 2]])
    want = np.array([3.0, 2, 4])
    assert np.allclose(nnls(a, a @ want), want)
    assert nnls(a, np.array([-1.0, -1, -1])).max() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    units = 16
    histogram = {int(k): int(rng.integers(0, 40)) for k in range(1, units + 1)}
    got = dict.fromkeys(histogram, 0)
    for content, count in plan(histogram, units):
        assert sum(content) <= units and count > 0
        for x in content:
            got[x] += count
    assert got == histogram
    assert all(sum(c) == units and len(c) <= 3 for c in combinations(units))


def check_packed(rows, texts, window):
    """texts: of each doc_id, one for each row of it."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    total = 0
    for doc, copies in texts.items():
        ids = ids_of(copies[0])
        total += len(ids) * len(copies)
        pieces = by_doc.pop(doc)
        covered = np.zeros(len(ids), int)
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids) and r["length"] > 0
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == len(copies)).all()
    assert not by_doc
    return padding / max(total, 1)


def test_pack_places_each_id_once(spark, documents):
    rng = np.random.default_rng(3)
    texts = {i: [" ".join(rng.choice(["alpha", "beta", "gamma,", "x1"], int(n)))] for i, n in enumerate(rng.integers(1, 400, 60))}
    texts |= {100: [None], 101: [""], 102: ["word " * 9000 + "end"], 103: ["same text"] * 3, None: ["no id"]}
    df = documents([(i, t) for i, ts in texts.items() for t in ts])
    extra = df.selectExpr("*", "1 AS length", "'x' AS start", "2 AS grains")
    rows = pack(extra).collect()
    assert check_packed(rows, texts, 2048) < 0.02
    assert pack(df.limit(0)).collect() == []


def test_pack_in_small_windows(spark, documents):
    texts = {i: ["a b c d e f g h i j"[: 2 * i + 1]] for i in range(9)}
    rows = pack(documents([(i, t[0]) for i, t in texts.items()]), window=16, grain=1).collect()
    check_packed(rows, texts, 16)
