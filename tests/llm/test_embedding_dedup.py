import math

import numpy as np

from glossweave.llm._shared import Scratch
from glossweave.llm.embedding_dedup import links, near_duplicates


def brute(rows, cosine=0.98):
    good = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if v and label is not None and vec_id is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            good[i] = u / np.linalg.norm(u)
    near = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine] for i in good}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in near.get(queue.pop(), []):
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        low = min((rows[j][0] for j in seen), default=None) if vec_id is not None else None
        out.append((vec_id, len(near.get(i, [])), low, None if vec_id is None else vec_id == low))
    return sorted(out, key=str)


def sample(n=700, dim=12, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        base = rng.normal(size=dim) if k % 3 or not rows else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0.0, 0.03, 0.12])
        rows.append((1000 - k, [float(x) for x in base], int(rng.integers(3)) if k % 50 else None))
    hot = rng.normal(size=dim)
    rows += [(2000 + k, [float(x) for x in (hot + (0 if k % 2 else rng.normal(size=dim) * 0.02))], 1) for k in range(400)]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    rows += [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [float("nan")] + [1.0] * 11, 1), (5003, [None] + [1.0] * 11, 1), (5004, [float("inf")] + [1.0] * 11, 1), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [2.0, 4.0], 1), (None, [1.0] * 12, 1), (5008, [3.0] * 12, 2), (5008, [3.0] * 12, 2), (5009, [-0.0, 2.0], 2), (5010, [0.0, 2.0], 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_small_blocks_and_many_intervals(spark):
    rows = sample(400, 5, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes, counts, edges = links(df, Scratch(spark, "t"), axes_kept=3, block_rows=16)
    copies = {r.low: r.copies for r in classes.collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    n = {r.low: r.n for r in counts.collect()}
    assert all(want[low] == n.get(low, 0) + c - 1 for low, c in copies.items())
    assert edges.count() < 4 * len(rows)


def test_one_id_for_two_vectors(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.001], 1), (9, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]
    df = spark.createDataFrame([*rows[:3], (5, [-1.0, 0.0], 1)], df.schema)
    assert sorted(r.n_links for r in near_duplicates(df).collect() if r.vec_id == 7) == [0, 1]
