"""Hard negatives against all scores computed in full."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleflow.llm import negatives

SCHEMA = "vec_id long, label int, v array<long>, rank int, score string"


def brute(rows, anchors, k=5, n=10, low=30, high=90):
    """All (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), sorted."""
    full = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))  # noqa: E731  shorter ones end in zeros
    usable = [r for r in rows if None not in r[:3]]
    own = {}
    for i, label, v in (r[:3] for r in anchors if None not in r[:3]):
        own[i] = min(own.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in own.items():
        scored = sorted((-full(v, x), i, other == label) for i, other, x in (r[:3] for r in usable) if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            inside = [(-t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(inside[:n], 1)]
    return sorted(out)


def clustered(n, seed, dims=6, spread=4):
    rng = random.Random(seed)
    centres = [[rng.randint(-60, 60) for _ in range(dims)] for _ in range(8)]
    return [(i, rng.choice([0, 0, 1, 2, 3]), [x + rng.randint(-spread, spread) for x in rng.choice(centres)], 1, "x") for i in range(n)]


def test_tree_bounds_skip_but_lose_nothing():
    rng = np.random.default_rng(1)
    centre = rng.integers(-80, 80, (6, 16))
    anchors = centre[rng.integers(0, 6, 40)] + rng.integers(-2, 3, (40, 16))
    block = centre[rng.integers(0, 6, 800)] + rng.integers(-6, 7, (800, 16))
    scores = anchors @ block.T
    windows = [(int(np.quantile(s, 0.3)), int(np.quantile(s, 0.6))) for s in scores]
    tree = negatives.Tree(np.arange(40) + 10_000, anchors, [negatives.Found([w, (w[0], w[1] - 50)], 10) for w in windows])
    for at in range(0, 800, 100):
        tree.scan(np.arange(at, at + 100), block[at : at + 100])
    for a, (low, high) in enumerate(windows):
        for (ids, found), top in zip(tree.found[a].best, (high, high - 50), strict=True):
            want = sorted((-s, i) for i, s in enumerate(scores[a].tolist()) if low <= s <= top)[:10]
            assert list(zip((-found).tolist(), ids.tolist(), strict=True)) == want
    assert tree.scored < 0.6 * scores.size


def test_spanning_tree_is_minimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    m = rng.integers(-9, 9, (9, 3))
    edges = negatives.spanning_tree(m)
    assert sorted(e[0] for e in edges) == list(range(9)) and [e[1] for e in edges].count(-1) == 1
    seen = set()
    for at, parent, _ in edges:
        assert parent in seen or parent == -1
        seen.add(at)
    group = list(range(9))
    total = 0.0
    for d, a, b in sorted((float(np.sqrt(((m[a] - m[b]) ** 2).sum())), a, b) for a, b in combinations(range(9), 2)):
        if group[a] != group[b]:
            total += d
            group = [group[a] if g == group[b] else g for g in group]
    assert sum(e[2] for e in edges) == pytest.approx(total)


@pytest.mark.parametrize("spread", [2, 40])
def test_negatives_against_brute_force(spark, spread):
    rows = clustered(700, spread, spread=spread)
    rows += [(7, 1, [9, 9], 1, "x"), (7, 1, [9, 9], 1, "x"), (800, 2, [0] * 6, 1, "x"), (801, 2, [], 1, "x"), (900, None, [1, 2], 1, "x"), (901, 1, None, 1, "x"), (None, 1, [5, 5], 1, "x"), (1000, 3, [5] * 6, 1, "x"), (1000, 2, [5] * 6, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, df.where("vec_id % 20 = 0")).collect())
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0])
    assert got


def test_ties_and_a_hot_label(spark):
    rows = [(i, int(i % 10 == 3), [3, 4], 1, "x") for i in range(3000)] + [(i, 2, [2, 2], 1, "x") for i in range(3000, 3300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, df.where("vec_id % 1000 = 0")).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 1000 == 0])


def test_large_components_and_empty(spark):
    big = 2**40
    rows = [(0, 1, [big, 3], 1, "x"), (1, 1, [big, 1], 1, "x"), (2, 0, [big // 2, 7], 1, "x"), (3, 0, [5, 5], 1, "x"), (4, 0, [-big, 0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    top = 2**63 - 1
    got = [tuple(r) for r in negatives.hard_negatives(df, df.where("vec_id = 0")).collect()]
    assert all(r[4] == top for r in got)  # clipped
    empty = df.where("false")
    assert negatives.hard_negatives(empty, empty).count() == 0
    assert negatives.hard_negatives(df, empty).count() == 0


def test_registered_query(spark):
    from aisleflow.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    rows = []
    for i, e, label in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(e)).astype(int).tolist()))
    got = QUERIES["op13_hard_negatives"](spark, path)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [r for r in rows if r[0] % 100 == 0])


def test_rows_that_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, None], 1), (2, [float("nan")], 1), (3, [float("inf")], 1), (4, None, 1), (5, [0.5], None), (6, [0.5, -0.25], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in negatives.vectors(df, F.col("label")).collect()] == [(6, 1, [128, -64])]
