import random

import pytest

from glossweave.llm._shared import Scratch
from glossweave.llm.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("one_task", [1 << 20, -1])
def test_chains_hubs_and_random_edges(spark, one_task):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(-5, 1000 + k) for k in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(220)]
    edges += [(7, 7), (None, 3), (4, None), (1001, 1000), (-(1 << 62), 1 << 62)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(df, Scratch(spark, "t"), one_task=one_task)
    assert sorted(map(tuple, got.collect())) == brute(edges)
    assert connected_components(df.limit(0), Scratch(spark, "t"), one_task=one_task).count() == 0
