import hashlib
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(text, items):
    """n_words, n_hit and ids, every window against every place."""
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        t = words(item)
        k = min(10, len(t))
        for i in range(len(t) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == t[i : i + k]:
                    hit.update(range(j, j + k))
                    ids.add("null" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(ids)


def made(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "naïve", "X9"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(8, 40)))) for i in range(12)] + [(20, "one two three"), (21, ""), (22, None), (None, say(15)), (23, "!!! ..."), (24, say(11))]
    items.append((25, items[0][1]))  # two ids of one text
    texts = [say(int(rng.integers(0, 60))) for _ in range(40)]
    for i in range(25):
        item = items[int(rng.integers(0, 12))][1].split()
        a = int(rng.integers(0, max(1, len(item) - 12)))
        texts.append(say(5) + " " + ", ".join(item[a : a + 12]).upper() + "... " + say(5))
    texts += ["one, TWO-three four", "one two", "", None, "...", "é" * 50, " ".join(items[0][1].split()) * 1]
    return list(enumerate(texts)), items


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_every_window_at_every_place(spark, documents):
    rows, items = made()
    docs = documents([*rows, (3, rows[3][1]), (None, rows[50][1])]).selectExpr("*", "1 AS key", "2 AS items", "3 AS hits")
    for options in ({}, {"block_words": 60}, {"shard_bytes": 100}):
        got = dc.contamination(docs, benchmark(spark, items), **options).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            want = by_hand(rows[50][1] if r["doc_id"] is None else rows[r["doc_id"]][1], items)
            assert (r["n_words"], r["n_hit"], r["items"]) == want, (r, want, options)
    assert any(r["n_hit"] > 12 for r in got) and any(r["items"] == ["20"] for r in got)


def test_longest_matches_and_places(spark, documents):
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(30)]
    texts = [(1, " ".join([*[f"x{i}" for i in range(7)], *passage[3:25], "y"])), (2, " ".join(passage[:11])), (3, " ".join(rng.permutation(passage)))]
    got = {(r["doc_id"], r["start"], r["item_start"], r["n_words"]) for r in dc.matches(documents(texts).coalesce(1), benchmark(spark, [(7, " ".join(passage))])).collect()}
    assert got == {(2, 0, 0, 11), (1, 7, 3, 22)}


def test_affected_documents_go_with_their_columns_kept(spark, documents):
    rows, items = made(2)
    docs = documents(rows).selectExpr("*", "lang AS _key", "text AS item_id")
    left = dc.decontaminated(docs, benchmark(spark, items))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, t in rows if not by_hand(t, items)[1]}


def test_empty_tables_and_string_ids(spark, documents):
    rows, items = made(3)
    assert dc.contamination(documents(rows).limit(0), benchmark(spark, items)).collect() == []
    none = dc.contamination(documents(rows), benchmark(spark, []))
    assert none.where("n_hit > 0 OR size(items) > 0").count() == 0 and none.count() == len(rows)
    named = dc.contamination(documents(rows).selectExpr("concat('d', doc_id) AS doc_id", "text"), benchmark(spark, items).selectExpr("concat('i', item_id) AS item_id", "text"))
    assert {r["doc_id"] for r in named.where("n_hit > 0").collect()} == {f"d{i}" for i, t in rows if by_hand(t, items)[1]}


def test_suffixes_are_in_order():
    rng = np.random.default_rng(4)
    runs = [list(rng.integers(1, 3, int(rng.integers(1, 40)))) for _ in range(30)]
    codes = np.array([x for run in runs for x in [*run, 0]])
    ends = np.repeat(np.cumsum([len(r) + 1 for r in runs]) - 1, [len(r) + 1 for r in runs])
    order = dc.suffix_array(codes, ends, 64)
    listed = [codes[i : ends[i]].tolist() for i in order]
    assert listed == sorted(listed)


def test_one_very_long_text_and_a_passage_in_many(spark, documents):
    passage = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"f{i % 997}" for i in range(200_000))
    rows = [(0, filler + " " + passage + " " + filler)] + [(i, f"a{i} {passage} b{i}") for i in range(1, 400)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in dc.contamination(documents(rows), benchmark(spark, [(1, passage)])).collect()}
    assert got[0] == (400_020, 20, ["1"]) and all(got[i] == (22, 20, ["1"]) for i in range(1, 400))


def test_words_of_odd_bytes():
    texts = ["A\x7fb\u0080c", "ÀB{c}", None, " ", "９９ 1_2", "a　b"]
    flat, bounds = dc.words_of(pa.array(["skip", *texts]).slice(1))
    got = flat.to_pylist()
    assert [got[bounds[i] : bounds[i + 1]] for i in range(len(texts))] == [words(t) for t in texts]
    assert dc.digest([]) == hashlib.sha256(b"").hexdigest()
