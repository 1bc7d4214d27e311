"""Scores over a graph, rankings and their comparison."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.operators.build import induced, transpose
from glossweave.operators.loops import cut
from glossweave.operators.structure import all_nodes, by_number, degrees, in_one_task, number, scc


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tol: float = 1e-10, reverse: bool = False, every: int = 5) -> tuple[DataFrame, dict]:
    """``node, score``, and how it went. Mass of nodes without an edge out is spread over all. ``tol`` is on the sum of changes, looked at every few rounds."""
    e = (transpose(edges) if reverse else edges).select("src", "dst").distinct()
    n = cut(nodes.select("node").distinct() if nodes is not None else all_nodes(e))
    e = cut(induced(e, n))
    count = n.count()
    if not count:
        return n.withColumn("score", F.lit(0.0)), {"converged": True, "iterations": 0}
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    base = cut(n.join(out, "node", "left"))
    links = cut(e.join(out.withColumnRenamed("node", "src"), "src").select("src", "dst", "k"))
    score = base.select("node", F.lit(1.0 / count).alias("score"))
    old, done = score, 0
    for done in range(1, rounds + 1):
        loose = base.where("k is null").select("node").join(score, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        given = links.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("k")).alias("g"))
        score = base.select("node").join(given, "node", "left").crossJoin(F.broadcast(loose)).select("node", (F.lit((1 - damping) / count) + damping * (F.coalesce("g", F.lit(0.0)) + F.col("loose") / count)).alias("score"))
        if done % every == 0 or done == rounds:
            score = cut(score)
            change = score.join(old.withColumnRenamed("score", "o"), "node").agg(F.sum(F.abs(F.col("score") - F.col("o"))).alias("c")).first()["c"]
            if tol and change < tol * every:
                return score, {"converged": True, "iterations": done}
            old = score
    return score, {"converged": False, "iterations": done}


def power_iteration(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 200, tol: float = 1e-9, reverse: bool = False) -> tuple[DataFrame, dict]:
    """The dominant eigenvector, normalised every round, summing to 1 in the end, and its eigenvalue. Periodic graphs do not settle: ``converged`` says so."""
    e = (transpose(edges) if reverse else edges).select("src", "dst").distinct()
    n = cut(nodes.select("node").distinct() if nodes is not None else all_nodes(e))
    e = cut(induced(e, n))
    count = n.count()
    score = n.withColumn("score", F.lit(1.0 / math.sqrt(max(count, 1))))
    lam, done, settled = 0.0, 0, False
    for done in range(1, rounds + 1):
        got = e.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("score").alias("s"))
        raw = cut(n.join(got, "node", "left").join(score, "node").select("node", F.coalesce("s", F.lit(0.0)).alias("s"), "score"))
        lam = math.sqrt(raw.agg(F.sum(F.col("s") * F.col("s")).alias("q")).first()["q"] or 0.0)
        if lam == 0:
            return n.withColumn("score", F.lit(0.0)), {"converged": True, "iterations": done, "eigenvalue": 0.0}
        change = raw.agg(F.sum(F.abs(F.col("s") / lam - F.col("score"))).alias("c")).first()["c"]
        score = raw.select("node", (F.col("s") / lam).alias("score"))
        if change < tol:
            settled = True
            break
    total = score.agg(F.sum("score").alias("t")).first()["t"] or 1.0
    return score.select("node", (F.col("score") / total).alias("score")), {"converged": settled, "iterations": done, "eigenvalue": lam}


def by_policy(edges: DataFrame, policy: str = "damped-full", **kw) -> tuple[DataFrame, dict]:
    """``damped-full`` (PageRank), ``raw`` (power iteration over all), ``largest-scc`` (over the largest component)."""
    if policy == "damped-full":
        return pagerank(edges, **kw)
    if policy == "raw":
        return power_iteration(edges, **kw)
    if policy == "largest-scc":
        labels = cut(scc(edges))
        top = labels.groupBy("scc").count().orderBy(F.desc("count"), "scc").limit(1)
        return power_iteration(edges, labels.join(top, "scc", "left_semi").select("node"), **kw)
    raise ValueError(f"unknown policy {policy!r}")


def per_scc(edges: DataFrame, labels: DataFrame, rounds: int = 500, tol: float = 1e-12) -> DataFrame:
    """``scc, node, score, eigenvalue, converged`` for every component with a cycle, each in one task."""
    import numpy as np

    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("s")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    inner = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("s = d")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.src, *pdf.dst})
        at = {v: i for i, v in enumerate(names)}
        x, y = pdf.src.map(at).to_numpy(), pdf.dst.map(at).to_numpy()
        v, lam, settled = np.full(len(names), 1 / math.sqrt(len(names))), 0.0, False
        for _ in range(rounds):
            w = np.bincount(y, v[x], len(names))
            lam = float(np.linalg.norm(w))
            if not lam:
                break
            w /= lam
            settled = bool(np.abs(w - v).sum() < tol)
            v = w
            if settled:
                break
        return pd.DataFrame({"scc": pdf.s.iloc[0], "node": names, "score": v / (v.sum() or 1.0), "eigenvalue": lam, "converged": settled})

    return inner.groupBy("s").applyInPandas(run, "scc string, node string, score double, eigenvalue double, converged boolean")


def degree_scores(edges: DataFrame, mode: str = "total") -> DataFrame:
    column = {"in": "indeg", "out": "outdeg", "total": "degree"}[mode]
    return degrees(edges).select("node", F.col(column).cast("double").alias("score"))


def edge_swaps(edges: DataFrame, swaps: int, seed: int = 0) -> DataFrame:
    """``src, dst`` after seeded double swaps that keep every in- and out-degree; loops are left out. A chain is sequential: one task."""

    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    ids, n = number(all_nodes(e))

    def solve(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        rng, key = random.Random(seed), src.astype(np.int64) * n + dst
        del src, dst
        key.sort()
        changed: dict[int, int] = {}  # places whose edge is another one now
        gone, new = set(), set()
        edge = lambda i: divmod(changed.get(i, int(key[i])), n)

        def have(x: int) -> bool:
            at = int(np.searchsorted(key, x))
            return x in new or (x not in gone and at < len(key) and int(key[at]) == x)

        def drop(x: int) -> None:
            new.discard(x) if x in new else gone.add(x)

        for _ in range(swaps if len(key) > 1 else 0):
            i, j = rng.randrange(len(key)), rng.randrange(len(key))
            (a, b), (c, d) = edge(i), edge(j)
            if len({a, b, c, d}) == 4 and not have(a * n + d) and not have(c * n + b):
                drop(a * n + b)
                drop(c * n + d)
                changed[i], changed[j] = a * n + d, c * n + b
                new |= {a * n + d, c * n + b}
        for i, x in changed.items():
            key[i] = x
        return [(key // n).astype(np.int32), (key % n).astype(np.int32)]

    swapped = in_one_task(by_number(e, ids), solve, "a int, b int")
    names = lambda k, c: ids.select(F.col("id").alias(k), F.col("node").alias(c))
    return swapped.join(names("a", "src"), "a").join(names("b", "dst"), "b").select("src", "dst")


def label_shuffle(labels: DataFrame, value: str = "layer", seed: int = 0) -> DataFrame:
    """``node`` with the same values dealt anew by a seeded hash."""
    a = labels.select("node", F.row_number().over(W.orderBy("node")).alias("r"))
    b = labels.select(value, F.row_number().over(W.orderBy(F.xxhash64("node", F.lit(seed)), "node")).alias("r"))
    return a.join(b, "r").select("node", value)


def positions(scores: DataFrame, descending: bool = True) -> DataFrame:
    """``node, score, position`` from 0; ties by name."""
    order = F.desc("score") if descending else F.asc("score")
    return scores.select("node", "score", (F.row_number().over(W.orderBy(order, "node")) - 1).alias("position"))


def top(scores: DataFrame, k: int, descending: bool = True) -> DataFrame:
    return scores.orderBy(F.desc("score") if descending else F.asc("score"), "node").limit(k).select("node")


def overlap_at(a: DataFrame, b: DataFrame, k: int, a_descending: bool = True, b_descending: bool = True) -> DataFrame:
    """One row: Jaccard of the first k of either, over the nodes that both score."""
    x, y = a.join(b.select("node"), "node", "left_semi"), b.join(a.select("node"), "node", "left_semi")
    x, y = top(x, k, a_descending).withColumn("x", F.lit(1)), top(y, k, b_descending).withColumn("y", F.lit(1))
    both = x.join(y, "node", "full").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("common"), F.count("*").alias("all"))
    return both.select("common", F.when(F.col("all") > 0, F.col("common") / F.col("all")).otherwise(0.0).alias("jaccard"))


def recall_precision_at(scores: DataFrame, seed: DataFrame, k: int) -> DataFrame:
    hit = top(scores, k).join(seed.select("node").distinct(), "node", "left_semi").agg(F.count("*").alias("hits"))
    size = seed.select("node").distinct().agg(F.count("*").alias("seeds"))
    return hit.crossJoin(size).select("hits", F.when(F.col("seeds") > 0, F.col("hits") / F.col("seeds")).alias("recall"), (F.col("hits") / k).alias("precision"))


def _average_rank(column: str):
    return F.rank().over(W.orderBy(column)) + (F.count("*").over(W.partitionBy(column)) - 1) / 2.0


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, rho``: Pearson of average ranks; null below three pairs or without variance."""
    p = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    r = p.select(_average_rank("x").alias("rx"), _average_rank("y").alias("ry"))
    return _correlation(r, "rx", "ry", 3).withColumnRenamed("r", "rho")


def _correlation(df: DataFrame, x: str, y: str, least: int) -> DataFrame:
    a = df.agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return a.select("n", F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))


def spearman_d2(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) over positions; ties by the rank given, not averaged. Squares outgrow 32 bits at 46,341 rows, their sum 64 bits at some 3 million."""
    r = pairs.select((F.row_number().over(W.orderBy(F.desc(x), "node"))).cast("long").alias("a"), (F.row_number().over(W.orderBy(F.desc(y), "node"))).cast("long").alias("b"))
    s = r.agg(F.count("*").alias("n"), F.sum(((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).cast("decimal(20,0)")).alias("d2"))
    n = F.col("n").cast("decimal(18,0)")
    return s.select("n", F.when(F.col("n") > 1, 1 - (6 * F.col("d2")).cast("double") / (n * (n * n - 1).cast("decimal(20,0)")).cast("double")).alias("rho"))


def pearson(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return _correlation(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, 2)
