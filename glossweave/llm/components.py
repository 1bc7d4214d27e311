"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each round is two groupings and two joins on the node; edges never reach the
driver. A node's neighbours are never held together: groupings only take a minimum,
summed up before the shuffle, and joins are between two plain exchanges of tables
at rest, so that the rows of a hub, which land in one partition, are split at run
time (adaptive skew join) once they exceed its threshold. Up to ``ONE_TASK`` edges,
16 MB, are joined in one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


#: Edges up to which one task finds the components.
ONE_TASK = 1 << 20


class Forest:
    """Union-find over the edges one task sees; tells which of them join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of all the edges of one task: labels fall to the smallest neighbour's and then to their own label's."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    n = sum(len(u) for u, _ in ends)
    nodes, at = np.unique(np.concatenate([*[u for u, _ in ends], *[v for _, v in ends]]), return_inverse=True)
    u, v, label = at[:n], at[n:], np.arange(len(nodes))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        for x in (u, v, a, b):
            np.minimum.at(label, x, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[label], pa.int64())})


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (BIGINT); root is the smallest node reachable.

    Edges with a null end and loops are ignored; an empty input gives no rows.
    Nodes without edges are the caller's (their own root).
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(e, "edges")
    sign = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = e.agg(*sign).first()
    if before[0] <= one_task:
        return e.repartition(1).mapInArrow(_labels, "node long, root long")
    for _ in range(max_rounds):
        # large star: a node's larger neighbours go to its smallest one, or to itself
        low = scratch.table(e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "low")
        large = scratch.table(e.join(low.hint("merge"), e.v == low.x, "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = scratch.table(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), large.u == least.x).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        new = scratch.table(small.where("u <> v").distinct(), "edges")
        for old in (e, low, large, least):
            scratch.drop(old)
        e, now = new, new.agg(*sign).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
