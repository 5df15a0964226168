import pytest

from loomgraph.llm.mixing import MOST, mix_documents, resampled


def goals(sizes):
    """Water filling by repetition."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > MOST * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: MOST * sizes[s] for s in over}


def corpus():
    rows = []
    for i in range(600):
        source = ["a", "b", "c", "d", None][min(i % 11, 4)]
        rows.append((i, "w " * (1 + (i * 37) % 90), "en", source))
    rows += [(1000 + i, "x y z", "en", "tiny") for i in range(3)]
    return rows + [(2000, None, "en", "a"), (2001, "", "en", "b"), (2002, " \n", "en", "empty"), (5, "w w w w", "en", "c"), (5, "w w w w", "en", "c"), (None, "no id here", "en", "d")]


def test_targets_and_copies(documents):
    rows = corpus()
    got = mix_documents(documents(rows).selectExpr("*", "1 AS size", "2 AS n", "3 AS rank")).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r["copies"] <= MOST and (r["size"] or not r["copies"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = goals(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= max(5, 0.02 * target[s]), s
    assert {(r["doc_id"], bytes(r["doc_key"]), r["copies"]) for r in got} == {(r["doc_id"], bytes(r["doc_key"]), r["copies"]) for r in mix_documents(documents(rows[::-1])).collect()}


def test_the_mix_repeats_rows(documents):
    rows = corpus()
    df = documents(rows).selectExpr("*", "1 AS _rows")
    out = resampled(df)
    assert out.columns == df.columns
    copies = {}
    for r in mix_documents(df).collect():
        copies[bytes(r["doc_key"])] = copies.get(bytes(r["doc_key"]), 0) + r["copies"]
    assert out.count() == sum(copies.values())


def test_one_source_and_none(documents):
    got = mix_documents(documents([(1, "a b c"), (2, "d e")])).collect()
    assert all(r["copies"] == 1 and r["target"] == 5 for r in got)
    assert mix_documents(documents([(1, "a")]).limit(0)).collect() == []
    assert [r["copies"] for r in mix_documents(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_rates_are_those_of_another_solver(spark, documents):
    """Rates that minimise sum(rate * (log rate - 1)) under a source's target, by bisection of the dual in plain Python."""
    import math

    from loomgraph.llm.common import Scratch
    from loomgraph.llm.mixing import balance, sized, targets

    rows = [(i, "w " * (1 + (i * 37) % 90), "en", "abc"[i % 3] if i % 4 else "d") for i in range(500)]
    scratch = Scratch(spark, "test")
    sizes = sized(documents(rows))
    got = balance(sizes, targets(sizes, scratch), scratch).collect()
    for source in "abcd":
        own = [r for r in got if r["source"] == source]
        target, mean = own[0]["target"], sum(r["n"] * r["size"] for r in own) / sum(r["n"] for r in own)
        low, high = -50.0, 200.0
        for _ in range(200):
            dual = (low + high) / 2
            words = sum(r["n"] * r["size"] * min(MOST, math.exp(min(50, dual * r["size"] / mean))) for r in own)
            low, high = (dual, high) if words < target else (low, dual)
        assert all(r["rate"] == pytest.approx(min(MOST, math.exp(min(50, low * r["size"] / mean))), rel=1e-4) for r in own), source


def test_steps_ask_nothing_of_their_own(documents, monkeypatch):
    """Whether a step was the last is told while its duals are written, without a query that the driver would keep."""
    from pyspark.sql import DataFrame

    from loomgraph.llm.mixing import resampled

    rows = [(i, "w " * (1 + (i * 37) % 90), "en", "abc"[i % 3] if i % 4 else None) for i in range(200)]
    rows += rows[:3]
    expected = {r["doc_id"]: r["n"] for r in mix_documents(documents(rows)).groupBy("doc_id").agg({"copies": "sum"}).toDF("doc_id", "n").collect()}

    def refused(self):
        raise AssertionError("a query for an answer that was known")

    monkeypatch.setattr(DataFrame, "isEmpty", refused)
    got = resampled(documents(rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {k: n for k, n in expected.items() if n}
