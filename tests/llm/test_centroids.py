import hashlib
import math

import numpy as np

from loomgraph.llm import centroids as lloyd

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, k, rounds, dimensions):
    """ids, clusters and distances by plain loops over Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        near = [min((distance(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if i < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
                if own:
                    centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((i is not None, i or 0, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), centres


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assigned, centres = lloyd.cluster(df.selectExpr("*", "1 AS chunk", "2 AS part"), **options)
    return sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in assigned.collect()), centres.tolist(), assigned


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 4)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (5, rows[5][1]), (None, [0.0] * 6), (302, None), (303, []), (304, [1.0] * 7), (305, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (306, [math.nan] * 6), (307, [math.inf] + [0.0] * 5)]
    for options in ({"block": 2}, {"block": 4}, {"block": 6, "k": 1000}):
        asked = {"k": 7, "rounds": 5, "dimensions": 6} | options
        got, centres, assigned = run(spark, rows, **asked)
        want, expected = by_hand(rows, asked["k"], 5, 6)
        assert got == want and centres == expected
    facts = lloyd.summary(assigned, np.array(centres, dtype=object)).collect()
    assert sum(r["n"] for r in facts) == len(got) and {r["inertia"] for r in facts} == {sum(x[3] for x in got)}
    assert {r["centroid_sha256"] for r in facts} <= {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in expected}


def test_huge_components_are_exact(spark):
    rows = [(i, [float(2 ** (20 + i % 45)), -float(3 ** (i % 37)), 0.5 * i, 1e-9]) for i in range(40)] + [(100 + i, [float(i), 1.0, 2.0, 0.5]) for i in range(40)]
    got, centres, _ = run(spark, rows, k=12, rounds=2, dimensions=4, block=3)
    want, expected = by_hand(rows, 12, 2, 4)
    assert centres == expected and got == [(a, b, c, d if d < 1 << 63 else None) for a, b, c, d in want]
    assert any(d is None for *_, d in got) and any(d for *_, d in got)


def test_ties_copies_and_empty_clusters(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + [(1000 + i, [float(i % 2), 0.0]) for i in range(20)]
    got, centres, _ = run(spark, rows, k=8, rounds=4, dimensions=2, block=1)
    want, expected = by_hand(rows, 8, 4, 2)
    assert got == want and centres == expected and len({c for _, _, c, _ in got}) < 8


def test_no_vectors(spark):
    assert run(spark, [], dimensions=2)[0] == [] and run(spark, [(1, [math.nan, 0.0])], dimensions=2)[0] == []
