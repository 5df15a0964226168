from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.quality import BASE, RULES, STANDARD, ablations, apply_policy, kept_documents, ledger, measure


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_distinct_words": len(set(words)), "n_stutter_words": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab# \n\t é|", max_size=80), st.lists(st.sampled_from(["a", "b", "\n"]), max_size=60).map(" ".join)), min_size=1, max_size=5))
def test_measurements(texts):
    got = measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: int(got[k][i]) for k in want} == want


GOOD = "\n".join(f"sentence {i} holds plain words that differ from line {i * 7} in many ways" for i in range(6))


def test_policies_and_ablations(documents):
    rows = [(1, GOOD), (2, "few words"), (3, None), (4, ""), (5, " ".join(f"w{i}$$$" for i in range(60))), (6, ("a b c d e f g h i j " * 9)), (7, " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)))]
    got = {r["doc_id"]: r for r in apply_policy(ledger(documents(rows)), STANDARD).collect()}
    assert [i for i in got if got[i]["kept"]] == [1]
    failed = lambda i: {r for b, r in enumerate(RULES) if got[i]["failures"] >> b & 1}
    assert "few_words" in failed(2) and {"few_words", "no_words"} <= failed(3) and failed(3) == failed(4)
    assert "symbols" in failed(5) and "repeated_windows" in failed(6) and failed(7) == {"upper_case"}
    table = {r["rule"]: r for r in ablations(ledger(documents(rows))).collect()}
    assert table["upper_case"]["n_fail"] == 1 and table["upper_case"]["n_only"] == 1 and table["few_words"]["n_fail"] == 3
    assert table["no_words"]["n_only"] == 0
    assert ledger(documents(rows).limit(0)).count() == 0
    base = {r["doc_id"] for r in apply_policy(ledger(documents(rows)), BASE).where("kept").collect()}
    assert base == {1, 5, 7}


def test_filter_keeps_columns(documents):
    df = documents([(1, GOOD), (2, "x"), (3, None), (1, GOOD)]).selectExpr("*", "7 AS n_words", "'q' AS failures")
    out = kept_documents(df)
    assert out.columns == df.columns and [r["n_words"] for r in out.collect()] == [7, 7]
