import random

import pytest

from loomgraph.llm.jaccard import drop_near_duplicates, link_classes, probe_length


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        alike = {frozenset(s) for s in sets if s and s != sets[i] and 100 * len(sets[i] & s) >= percent * len(sets[i] | s)}
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc, len(alike)))
    return sorted(out, key=str)


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(30)]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[: rng.randint(1, len(words))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(2, 90))]
            bases.append(words)
        if rng.random() < 0.4:
            words = words + passage
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_classes_are_those_of_all_pairs(documents, seed, width, percent):
    rows = corpus(seed)
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one two"), (9, "other text of a repeated id"), (9, "other text of a repeated id"), (None, rows[0][1]), (None, "lonely row without an id here"), (506, "Été É"), (507, "été é")]
    df = documents(rows).selectExpr("*", "1 AS n", "2 AS node", "3 AS token")
    want = brute(rows, width, percent)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in link_classes(df, width, percent, count_links=True).collect()), key=str)
    assert got == want
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_classes(df, width, percent).collect()), key=str)
    assert got == [w[:3] for w in want]


def test_links_of_members_are_derived_from_their_home(documents):
    """Many edits of one text, alike to it and mostly not to one another; edits of edits; a text at the edge of the class."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for place in rng.sample(range(0, 200, 10), rng.randint(1, 2)):
            words[place] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((100 + i, " ".join([*words, *(f"tail{j}" for j in range(rng.randint(1, 30)))])))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in link_classes(documents(rows), 3, 94, count_links=True).collect()), key=str)
    assert got == brute(rows, 3, 94) and max(g[3] for g in got) > 20


def test_long_texts_and_columns_of_any_name(documents):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 100_000), (4, "x" * 100_000 + " y")]
    df = documents(rows).selectExpr("*", "1 AS gone", "2 AS _gone", "3 AS class_key", "4 AS doc_key", "5 AS `a.b`")
    got = drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4] and got.columns == df.columns
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_empty_table(documents):
    assert link_classes(documents([(1, "a")]).limit(0)).collect() == []


def test_probe_length():
    for percent in (60, 80, 90):
        for n in range(1, 300):
            assert probe_length(n, percent) == n - -(-percent * n // 100) + 1


def test_one_of_each_class_stays(documents):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base + " more"), (8, "quite another text with some words"), (8, "quite another text with some words"), (9, None), (10, "")]
    got = sorted((r["doc_id"], r["text"]) for r in drop_near_duplicates(documents(rows)).collect() if r["text"])
    assert got == [(3, base + " more"), (8, "quite another text with some words")]
    assert {r["doc_id"] for r in drop_near_duplicates(documents(rows)).collect()} == {3, 8, 9, 10}


def test_repeated_and_missing_ids_neither_merge_nor_hide_classes(documents):
    base, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, base), (1, other), (4, other + " more"), (None, "a " + " ".join(f"x{i}" for i in range(60))), (None, "b " + " ".join(f"x{i}" for i in range(60))), (None, "quite another text with some words")]
    got = [(r["doc_id"], r["text"]) for r in drop_near_duplicates(documents(rows)).collect()]
    assert sorted(t for i, t in got if i is not None) == [other, base]
    assert len([t for i, t in got if i is None and "x1 x2" in t]) == 1 and len(got) == 4
    assert {r["class_key"] is None for r in link_classes(documents([(1, None), (2, "")])).collect()} == {True}


def test_classes_take_few_queries(spark, documents, monkeypatch):
    """The driver keeps something of each query: counts are taken while tables are written, and classes of stars need no round."""
    from pyspark.sql import DataFrame

    from loomgraph.llm.common import Scratch
    from loomgraph.llm.jaccard import components

    def refused(self):
        raise AssertionError("a query for a count alone")

    monkeypatch.setattr(DataFrame, "count", refused)
    rows = corpus(4)
    got = link_classes(documents(rows), 5, 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted((r[:3] for r in brute(rows, 5, 80)), key=str)
    saved = []
    keep = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label: saved.append(label) or keep(self, df, label))
    stars = spark.createDataFrame([(9, 1), (2, 1), (1, 5), (4, 3), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components(stars, Scratch(spark, "test"), "s").collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (9, 1)]
    assert saved == ["s-0", "s-l1", "s-done"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    assert sorted(map(tuple, components(chain, Scratch(spark, "test"), "c").collect())) == [(i, 1) for i in range(1, 41)]
    assert components(stars.limit(0), Scratch(spark, "test"), "n").collect() == []
