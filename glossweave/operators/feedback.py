"""Feedback vertex sets (seeds): components are independent, so each is one grouped task."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.operators import digraph, numbered
from glossweave.operators.build import induced
from glossweave.operators.loops import cut
from glossweave.operators.structure import BROADCAST_NODES, ONE_TASK_EDGES, all_nodes, by_number, degrees, gathered, in_one_task, number, scc, scc_edges


def choose(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``scc, node``: of each component the node with the largest (degree, out, in, name) over its inner edges, loops aside."""
    inner = cut(scc_edges(edges, labels).where("s = d and src <> dst").select("src", "dst"))
    d = labels.join(degrees(inner), "node", "left").fillna(0)
    return d.groupBy("scc").agg(F.max_by("node", F.struct("degree", "outdeg", "indeg", "node")).alias("node"))


def solve(edges: DataFrame, labels: DataFrame, method: str = "bounded-scc", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``seed(node)`` and ``per_scc(scc, size, seeds, method, exact, lower_bound, residual)`` over the cyclic components."""
    if method not in numbered.METHODS:
        raise ValueError(f"unknown method {method!r}")
    solver, bound, most = numbered.METHODS[method]
    args = {} if limit is None else {bound: limit}
    most = most and (limit or most)
    ids, n = number(labels)
    own = labels.join(ids, "node").select("id", "scc")
    part = cut(own.withColumn("part", F.min("id").over(W.partitionBy("scc"))))
    inner = by_number(edges.select("src", "dst").distinct(), ids)
    to = part.select("id", "part")
    to = F.broadcast(to) if n <= BROADCAST_NODES else to
    inner = inner.join(to.select(F.col("id").alias("src"), "part"), "src").join(to.select(F.col("id").alias("dst"), F.col("part").alias("p")), "dst").where("part = p").select("src", "dst", "part")

    def run(batches):
        import pyarrow as pa

        own = np.full(n, -1, np.int32)

        def seen(t) -> None:
            for k in (0, 1):
                own[t.column(k).to_numpy()] = t.column(2).to_numpy()

        src, dst = gathered(batches, seen)
        if not len(src):
            return
        nodes = np.flatnonzero(own >= 0)
        small = np.zeros(n, np.int32)
        small[nodes] = np.arange(len(nodes))
        np.take(small, src, out=src)
        np.take(small, dst, out=dst)
        g, own = numbered.Graph(len(nodes), src, dst), own[nodes]
        del src, dst, small
        parts = g.cyclic(np.arange(g.n))
        large = {int(own[p[0]]) for p in parts if most is None or len(p) > most}
        seed, left = solver(g, parts, **args)
        names, at, size = np.unique(own, return_inverse=True, return_counts=True)
        residual = np.bincount([at[p[0]] for p in left], minlength=len(names))
        chosen: list[list[int]] = [[] for _ in names]
        for v in sorted(seed):
            chosen[at[v]].append(int(nodes[v]))
        exact = [most is not None and int(k) not in large for k in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(size, pa.int64()), pa.array(chosen, pa.list_(pa.int32())), pa.array(exact, pa.bool_()), pa.array(residual, pa.int64())], names=["part", "size", "nodes", "exact", "residual"])

    found = cut(inner.repartition("part").select("src", "dst", "part").mapInArrow(run, "part int, size long, nodes array<int>, exact boolean, residual long"))
    names = part.where("id = part").select("part", "scc")
    per = found.join(names, "part").select("scc", "size", F.size("nodes").cast("long").alias("seeds"), F.lit(method).alias("method"), "exact", F.when(F.col("exact"), F.size("nodes").cast("long")).alias("lower_bound"), "residual")
    return found.select(F.explode("nodes").alias("id")).join(ids, "id").select("node"), per


def staged(edges: DataFrame, hubs: int = 5, passes: int = 3, small: int = 12, max_stages: int | None = None, one_task_edges: int = ONE_TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Hubs of the whole, then of the largest component, bounded passes, exact small residuals, and hubs of what is left until nothing is.

    Returns ``seed(node, stage)`` and ``metrics(stage, name, removed, edges_left)``. Up to
    ``one_task_edges`` edges the stages are those of one task.
    """
    spark = edges.sparkSession
    left = cut(edges.select("src", "dst").distinct())
    if 0 < left.count() <= one_task_edges:
        ids, n = number(all_nodes(left))

        def run(src: np.ndarray, dst: np.ndarray) -> list[list]:
            seed, metrics = numbered.staged(numbered.Graph(n, src, dst), hubs, passes, small, max_stages)
            rows = [(v, k, None, None, None) for v, k in seed] + [(None, *m) for m in metrics]
            kinds = (np.int32, np.int32, object, np.int64, np.int64)
            return [pd.array([r[i] for r in rows], dtype=("string" if k is object else pd.Series([], dtype=k).dtype.name.capitalize())) for i, k in enumerate(kinds)]

        found = cut(in_one_task(by_number(left, ids), run, "id int, stage int, name string, removed long, edges_left long"))
        return found.where("id is not null").join(ids, "id").select("node", "stage"), found.where("id is null").select("stage", "name", "removed", "edges_left")
    seeds, metrics = None, []

    def take(gone: DataFrame, name: str) -> int:
        nonlocal left, seeds
        gone = cut(gone.select("node").distinct())
        n = gone.count()
        if n:
            left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
            mine = gone.withColumn("stage", F.lit(len(metrics)))
            seeds = mine if seeds is None else seeds.union(mine)
        metrics.append((len(metrics), name, n, left.count()))
        return n

    def largest() -> DataFrame:
        labels = cut(scc(left))
        top = labels.groupBy("scc").count().orderBy(F.desc("count"), "scc").limit(1).select("scc")
        return induced(left, labels.join(top, "scc", "left_semi"))

    def hubs_of(e: DataFrame, k: int) -> DataFrame:
        return degrees(e.where("src <> dst")).orderBy(F.desc("degree"), "node").limit(k)

    take(hubs_of(left, hubs), "global hubs")
    take(hubs_of(largest(), hubs), "hubs of the largest component")
    take(solve(left, cut(scc(left)), "bounded-scc", passes)[0], "bounded passes")
    for _ in itertools.count() if max_stages is None else range(max_stages):
        labels = cut(scc(left))
        sizes = labels.groupBy("scc").count()
        few = labels.join(sizes.where(F.col("count") <= small), "scc", "left_semi").select("node", "scc")
        if take(solve(induced(left, few), few, "exact-small-greedy", small)[0], "exact small residuals") == 0 and not sizes.where(F.col("count") > small).head(1):
            break
        if sizes.where(F.col("count") > small).head(1):
            take(hubs_of(largest(), hubs), "hubs of the largest residual")
    return seeds if seeds is not None else spark.createDataFrame([], "node string, stage int"), spark.createDataFrame(metrics, "stage int, name string, removed long, edges_left long")


def representatives(seed: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``ic, node, members``: of each class the seed with the largest (in-degree, name), and all of its seeds."""
    d = seed.join(classes, "node").join(degrees(edges).select("node", "indeg"), "node", "left").fillna(0, ["indeg"])
    return d.groupBy("ic").agg(F.max_by("node", F.struct("indeg", "node")).alias("node"), F.array_sort(F.collect_set("node")).alias("members"))


def loop_impact(edges: DataFrame, methods: tuple[str, ...] = ("bounded-scc", "exact-small-greedy", "exact-cutting")) -> DataFrame:
    """Seed sizes and residuals by method, with loops and without."""
    out = None
    for name, e in (("with", edges), ("without", edges.where("src <> dst"))):
        e = cut(e)
        labels = cut(scc(e))
        for m in methods:
            row = solve(e, labels, m)[1].agg(F.lit(name).alias("loops"), F.lit(m).alias("method"), F.coalesce(F.sum("seeds"), F.lit(0)).alias("seeds"), F.coalesce(F.sum("residual"), F.lit(0)).alias("residual"))
            out = row if out is None else out.union(row)
    return out


def weak_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, part``: connected components of the undirected graph, named after their smallest node."""
    e = edges.select("src", "dst")
    both = cut(e.union(e.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("part")).select("node", F.least("node", "part").alias("part")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("part").alias("p"))
        step = labels.join(near, "node", "left").select("node", F.least("part", "p").alias("part"))
        step = cut(step)
        jump = cut(step.join(step.select(F.col("node").alias("part"), F.col("part").alias("up")), "part", "left").select("node", F.least("part", F.coalesce("up", "part")).alias("part")))
        if not jump.join(labels, ["node", "part"], "left_anti").head(1):
            return jump
        labels = jump
    raise RuntimeError("components did not settle")


def max_matching(edges: DataFrame) -> DataFrame:
    """``part, tail, head``: a maximum matching of edges where a node is used once as tail and once as head. Its size is unique, its choice not."""
    e = edges.select("src", "dst").distinct()
    two = e.select(F.concat(F.lit("t:"), "src").alias("src"), F.concat(F.lit("h:"), "dst").alias("dst"))
    parts = weak_components(two)
    dealt = two.join(parts.withColumnRenamed("node", "src"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict[str, set[str]] = {}
        for a, b in zip(pdf.src, pdf.dst):
            left.setdefault(a, set()).add(b)
        to = digraph.matching_size(left)
        return pd.DataFrame([(pdf.part.iloc[0], a[2:], b[2:]) for b, a in to.items()], columns=["part", "tail", "head"])

    return dealt.groupBy("part").applyInPandas(run, "part string, tail string, head string")


def drivers(edges: DataFrame, matching: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no matched edge enters; every node without an edge in is one."""
    return nodes.select("node").distinct().join(matching.select(F.col("head").alias("node")), "node", "left_anti")
