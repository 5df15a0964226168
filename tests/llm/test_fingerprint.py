import hashlib

import numpy as np
import pyarrow as pa

from loomgraph.llm import fingerprint as fp


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(documents):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 60))))) for i in rng.permutation(120)]
    rows += [(500, None), (501, ""), (502, "ä ö ü"), (502, "ä ö ü"), (None, "last one of all"), (-5, "negative id")]
    got = fp.fingerprint_edits(documents(rows).selectExpr("*", "1 AS key", "2 AS bucket")).collect()
    order = sorted(((r["doc_id"], r["n_chars"]) for r in got), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(rows)
    texts = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [(i, t or "") for i, t in texts]
    assert [x[0] for x in order] == [x[0] for x in texts]
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digests = [r["edited_sha256"] for r in by_id[i]]
        assert hashlib.sha256(edited.encode()).hexdigest() in digests
        r = by_id[i][digests.index(hashlib.sha256(edited.encode()).hexdigest())]
        assert r["n_chars"] == len(text)
        # fewer than K shingles: exact
        assert abs(r["near_edited"] - likeness(shingles(text), shingles(edited))) < 1e-9
        assert abs(r["near_next"] - likeness(shingles(text), shingles(after))) < 1e-9


def test_one_document_and_none(documents):
    row = fp.fingerprint_edits(documents([(1, "abcdef")])).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0
    assert fp.fingerprint_edits(documents([(1, "a")]).limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    one, two, both = fp.sketches(pa.array([a, b, " ".join(words)]))
    assert np.array_equal(fp.merge(one, two), both) or len(np.intersect1d(fp.merge(one, two), both)) >= fp.K - 4
    assert abs(fp.resemblance(one, two) - 0.5) < 0.15 and abs(fp.containment(one, two) - 2 / 3) < 0.2
    assert abs(fp.shingle_count(one) / 2996 - 1) < 0.3
    assert np.array_equal(fp.from_text(fp.to_text(one)), one) and fp.to_text(fp.sketches(pa.array([""]))[0]) == ""
    assert fp.to_text(one) == fp.to_text(fp.sketches(pa.array([a.upper()]))[0])
