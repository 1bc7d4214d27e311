import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm.ann import fit, nearest


def brute(rows, asked, k=10):
    good = {i: np.array(v, float) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for q in asked:
        if q in good:
            d = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[: n // 5] = x[0] + rng.normal(size=(n // 5, 16)) * 0.01  # a third of a list and more
    x[n // 5 : n // 4] = x[n // 5]  # copies
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


@pytest.mark.parametrize(("n", "parts"), [(2500, (4096, 512)), (1500, (64, 8))])
def test_recall_and_scores(spark, n, parts):
    rows = sample(n)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    got = nearest(df, df.where("vec_id % 50 = 0"), part_rows=parts[0], part_queries=parts[1]).collect()
    want = brute(rows, range(0, n, 50))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = {i: np.array(v) for i, v in rows}
    for q, near in found.items():
        assert len(near) == 10 and [s for _, s in near] == sorted(s for _, s in near)
        assert all(abs(s - np.linalg.norm(x[q] - x[i])) < 1e-9 and i != q for i, s in near)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found.get(q, [])}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0] * 16), (1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, [None] * 16), (5, [1.0] * 3), (None, [1.0] * 16), (7, [2.0] * 16), (6, [2.0] * 16), (6, [2.0] * 16), (8, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, df.where("vec_id in (0, 1, 2, 3)")).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 4.0), (0, 2, 7, 4.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    assert nearest(df, df.where(F.lit(False))).count() == 0


def test_a_group_of_near_copies_and_a_second_dimension(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16))
    x[:1500] = x[0] + rng.normal(size=(1500, 16)) * 0.002  # many more than the shortlist, in few codes
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(10_000 + k, [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(40, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    near, low, hits, rest = {i: np.array(v) for i, v in rows}, [], 0, 0
    for q in [i for i, _ in rows if i % 100 == 0]:
        d = sorted((np.linalg.norm(near[q] - v), i) for i, v in near.items() if i != q and len(v) == len(near[q]))
        want = {i for _, i in d[:10]}
        assert len(got[q]) == 10
        if q < 1500:
            low.append(len(want & got[q]))
        hits, rest = hits + len(want & got[q]), rest + 10
        assert q < 10_000 or want == got[q]
    assert np.mean(low) > 9.5 and hits / rest >= 0.9


def test_lists_with_few_rows_are_not_the_end(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) * np.repeat([1, 1000], 200)[:, None]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    index = fit(x, 400)
    index.probes = 1
    counts = nearest(df, df, k=50, index=index).groupBy("query_id").count().collect()
    assert len(counts) == 400 and {r["count"] for r in counts} == {50}
