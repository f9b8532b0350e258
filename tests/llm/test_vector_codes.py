"""op11: dual-tree Lloyd against plain comparison of all with all."""

import math

import numpy as np
import pytest
from tidewater.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(x, book):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)), e) for e, c in enumerate(book)) for r in x]


@pytest.mark.parametrize("seed", range(40))
def test_assign_equals_brute_force(seed):
    """Ties, repeated entries, clusters, and numbers beyond 64 bits."""
    rng = np.random.default_rng(seed)
    n, m, d, s = rng.integers(1, 300), rng.integers(1, 257), rng.integers(1, 9), rng.choice([2, 5, 600])
    x, book = rng.integers(-s, s + 1, (n, d)), rng.integers(-s, s + 1, (m, d))
    if seed % 3 == 0:
        middle = rng.integers(-20_000, 20_000, (8, d))
        x, book = x + middle[rng.integers(0, 8, n)], book + middle[rng.integers(0, 8, m)]
    if seed % 10 == 9:
        x, book = x.astype(object) * 10 ** 25, book.astype(object) * 10 ** 25
    near, count, total = V.assign(x, book)
    want = [e for _, e in brute_nearest(x, book)]
    assert near.tolist() == want and count.tolist() == [want.count(e) for e in range(m)]
    for e in set(want):
        assert [int(v) for v in total[e]] == [sum(int(x[i][k]) for i in range(n) if want[i] == e) for k in range(d)]


def test_clusters_are_assigned_whole():
    """Cached sums: of far clusters, only rows in leaves that hold two clusters are compared one by one."""
    rng = np.random.default_rng(1)
    middle = np.array([[100_000 * i, -70_000 * i] for i in range(20)])
    x = middle[np.repeat(np.arange(20), 200)] + rng.integers(-50, 50, (4000, 2))
    parts = V.Tree(x, V.LEAF)
    found, whole = V.walk(parts, V.Tree(middle, V.ENTRY_LEAF))
    assert sum(parts.count[n] for n, _ in whole) > 3500 and max(parts.count[n] for n, _ in whole) > 64
    assert (found == np.repeat(np.arange(20), 200)[parts.order]).all()


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    w = width // parts
    vec = [[math.floor(float(np.float32(v)) * 1024) for v in r[1]] + [0] * (width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[vec[i][p * w:(p + 1) * w] for i in first] for p in range(parts)]
    cut = [[v[p * w:(p + 1) * w] for v in vec] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            near = [e for _, e in brute_nearest(cut[p], books[p])]
            for e in set(near):
                held = [x for x, k in zip(cut[p], near) if k == e]
                books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    near = [brute_nearest(cut[p], books[p]) for p in range(parts)]
    errors = [sum(near[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = V.codebooks_digest(books)
    return [(r[0], "".join(f"{near[p][i][1]:02x}" for p in range(parts)), min(errors[i], V.LONG), min(by_label[r[2]], V.LONG), digest)
            for i, r in enumerate(kept)]


def rows(seed=3, n=400, d=8):
    rng = np.random.default_rng(seed)
    out = [(int(i), [float(v) for v in rng.normal(size=d).astype(np.float32)], int(i % 3) if i % 5 else None) for i in range(n)]
    bad = [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [math.nan] * d, 1), (1003, [math.inf] * d, 1), (1004, [-math.inf] + [0.0] * 7, None)]
    return out + bad + [out[0], out[7], (3, [0.5] * d, 2), (None, [0.25] * d, None), (2000, [0.125, -0.5, 1.0], 2), (2001, [], 2)]


def test_equals_brute_force(spark):
    data = rows()
    vectors = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS id", "'a' AS v", "2 AS code", "3 AS salt", "4 AS part")
    assert sorted(map(str, map(tuple, V.compress(vectors.repartition(3)).collect()))) == sorted(map(str, brute(data)))


def test_huge_components(spark):
    """Beyond 64 bits all is exact, errors stop at the largest long."""
    data = [(i, [float(np.float32(1e30 * (i % 5))), float(i), -1e12 * i, 0.0], 1) for i in range(40)]
    got = V.compress(spark.createDataFrame(data, SCHEMA), entries=6).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute([(a, [float(np.float32(x)) for x in b], c) for a, b, c in data], entries=6)))


def test_limbs_add_up():
    for values in ([0, 1, -1], [2 ** 48, -2 ** 48, 5], [-(10 ** 40), 10 ** 40 + 3, -7]):
        limbs = list(V._limbs(np.array(values, dtype=object)))
        assert [sum(limb[k] << (V.LIMB * i) for i, limb in enumerate(limbs)) for k in range(3)] == values


def test_empty_tables(spark):
    vectors = spark.createDataFrame(rows(), SCHEMA)
    assert V.compress(vectors.where("false")).collect() == [] and V.compress(vectors.where("vec_id between 1000 and 1004")).collect() == []
    assert [tuple(r)[:4] for r in V.compress(vectors.where("vec_id = 2001")).collect()] == [(2001, "00000000", 0, 0)]
