import hashlib
import zlib

import numpy as np
import pytest

from loomgraph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows, rebuild=True):
    """Every prefix of every rebuilt conversation in a dict."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(np.fmod(c, 5))
        whole[c] = turns.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children, out = {}, []
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    saved, leaves = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0
        saved[s] = own_saved + sum(saved[x] for x in children.get(s, []))
        leaves[s] = sum(leaves[x] for x in children.get(s, [])) or 1
    for s, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(s))))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS depth", "3 AS n")
    got = sorted((tuple(r) for r in trie.prefix_trie(df, **options).collect()), key=str)
    want = by_hand(rows, options.get("rebuild", True))
    assert got == want, (set(want) - set(got), set(got) - set(want))


def made(seed, n, longest, words=3):
    rng = np.random.default_rng(seed)
    return [(int(c), t, ["user", "assistant"][t % 2], f"é{rng.integers(words)}" * int(rng.integers(1, 3))) for c in range(n) for t in range(int(rng.integers(1, longest)))]


@pytest.mark.parametrize("options", [{}, {"piece": 3}, {"piece": 1}])
def test_equals_a_dict_of_prefixes(spark, options):
    same(spark, made(0, 120, 14), **options)


def test_not_rebuilt_copies_in_many_ranges(spark):
    copies = [(c, t, "user", f"same {t}") for c in range(200) for t in range(4 if c % 3 else 9)]
    same(spark, copies, rebuild=False)
    same(spark, copies, rebuild=False, piece=4)
    same(spark, copies)


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "a"), (None, 0, "user", "lost"), (-3, 0, "user", "a"), (-5, 1, "", ""), (7, 1, "a", ":b"), (8, 1, "a:", "b"), (0, 0, "user", "a")]
    rows += [(c, 0, "user", "") for c in range(20, 40)]
    same(spark, rows)
    same(spark, rows, rebuild=False, piece=2)


def test_turnless_conversations_end_at_the_root(spark):
    # a conversation's own first turns go, and there is no first of its five
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 5]
    same(spark, rows)
    assert any(len(x) for x in by_hand(rows))


def test_one_conversation_of_most_rows(spark):
    rows = [(3, t, "user", f"{t % 7}") for t in range(2000)] + [(4, t, "user", f"{t % 7}") for t in range(1500)] + made(1, 30, 6)[:60]
    rows = [(c + 10 * (c > 4), t, r, x) for c, t, r, x in rows]
    same(spark, rows, rebuild=False, piece=64)
    same(spark, rows)


def test_empty_and_one(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    same(spark, [(5, 0, "user", "x")])


def test_forest_makes_a_node_for_each_run_of_common_turns():
    nodes = trie.forest(np.array([2, 2, 0, 3, 1, -1, 4]))
    assert sorted((x.left, x.right, x.depth) for x in nodes) == [(0, 2, 2), (0, 5, 0), (3, 4, 3), (3, 5, 1), (6, 7, 4)]
    parents = {(x.left, x.depth): (nodes[x.parent].left, nodes[x.parent].depth) if x.parent >= 0 else None for x in nodes}
    assert parents == {(0, 2): (0, 0), (3, 3): (3, 1), (3, 1): (0, 0), (0, 0): None, (6, 4): None}
