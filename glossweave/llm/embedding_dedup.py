"""Embedding near-dedup by an epsilon grid order join.

Boehm, Braunmueller, Krebs and Kriegel, "Epsilon Grid Order" (SIGMOD 2001). Unit
vectors at cosine c or more lie within eps = sqrt(2 - 2c). Vectors are sorted by
label and by the eps-cells of their leading principal coordinates, cut into
sequence intervals with bounding boxes, and intervals are joined recursively:
a pair whose boxes lie farther apart than eps is skipped, and so are all pairs
within it. What is left is compared in double precision.

Exact copies are one vector with a multiplicity. A task emits, per vector, how
many it links with, and a spanning forest of the links; never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch
from .components import Forest, connected_components

BLOCK_SCHEMA = "block long, label string, dim int, n int, cells array<int>, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"


def usable(embedding: str = "embedding") -> F.Column:
    """Not null, not zero, all components known and finite."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def plain(embedding: str = "embedding") -> F.Column:
    """As doubles, with one zero."""
    return F.transform(F.col(embedding).cast("array<double>"), lambda x: x + 0.0)


def _class(label: str, v: str) -> list[F.Column]:
    """128 bits that name a label and vector."""
    return [F.xxhash64(label, v).alias("h1"), F.xxhash64(v, F.lit(7), label).alias("h2")]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, k: int) -> np.ndarray:
    """The k leading axes of the unit vectors of the most common dimension, from sums over all of them."""
    top = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return np.zeros((0, 0))
    dim = int(top["dim"])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _unit(np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, dim)) if batch.num_rows else np.zeros((0, dim))
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim * dim), pa.int32()), "s": pa.array(total.ravel())})

    rows = vectors.where(F.col("dim") == dim).select("v").mapInArrow(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # dim * dim rows
    moments = np.zeros(dim * dim)
    for r in rows:
        moments[r["at"]] = r["s"]
    _, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1][:, : min(k, dim)])


def _project(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes. Cutting off or filling up with zeros never lengthens a distance, nor does projecting."""
    dim, need = unit.shape[1], axes.shape[0]
    if dim < need:
        unit = np.pad(unit, ((0, 0), (0, need - dim)))
    return unit[:, :need] @ axes


def _far(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(lo2 - hi, lo - hi2))
    return float(gap @ gap) > eps * eps


class _Join:
    """Joins two sequence intervals recursively; counts links and keeps a spanning forest."""

    def __init__(self, cosine: float, eps: float, axes: np.ndarray, leaf: int = 256):
        self.cosine, self.eps, self.axes, self.leaf = cosine, eps, axes, leaf

    def run(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, list]:
        self.u, self.v = _unit(a), _unit(b)
        self.p, self.q = _project(self.u, self.axes), _project(self.v, self.axes)
        self.na, self.nb = na, nb
        self.count_a, self.count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.pairs: list[tuple[int, int]] = []
        self.same = same
        self._pair(0, len(a), 0, len(b))
        return self.count_a, self.count_b, self.pairs

    def _pair(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0 + 1:  # below the diagonal: met from the other side
            return
        p, q = self.p[a0:a1], self.q[b0:b1]
        if _far(p.min(0), p.max(0), q.min(0), q.max(0), self.eps):
            return
        if max(a1 - a0, b1 - b0) <= self.leaf:
            self._leaf(a0, a1, b0, b1)
            return
        ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
        for x0, x1 in [(a0, ma), (ma, a1)] if a1 - a0 > self.leaf else [(a0, a1)]:
            for y0, y1 in [(b0, mb), (mb, b1)] if b1 - b0 > self.leaf else [(b0, b1)]:
                self._pair(x0, x1, y0, y1)

    def _leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        near = self.u[a0:a1] @ self.v[b0:b1].T >= self.cosine
        if self.same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not near.any():
            return
        self.count_a[a0:a1] += near @ self.nb[b0:b1]
        self.count_b[b0:b1] += near.T @ self.na[a0:a1]
        self.pairs += [(x + a0, y + b0) for x, y in _trees(near)]


def _trees(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning trees of the bipartite graph of rows and columns, breadth first."""
    rows, columns, out = near.any(1), near.any(0), []
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        rows[start], queue = False, [start]
        while queue:
            r = queue.pop()
            new = np.flatnonzero(near[r] & columns)
            columns[new] = False
            for c in new.tolist():
                out.append((r, c))
                more = np.flatnonzero(near[:, c] & rows)
                rows[more] = False
                out += [(x, c) for x in more.tolist()]
                queue += more.tolist()
    return out


def links(embeddings: DataFrame, scratch: Scratch, cosine: float = 0.98, axes_kept: int = 8, block_rows: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``classes(label, v, dim, low, copies, node)``, ``counts(node, low, n)`` and forest edges ``(a, b)`` over the classes' nodes.

    A class is a label and a vector; ``node`` numbers it (so rows that share a
    vec_id but not a vector are apart), ``low`` is its smallest vec_id.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) * (1 + 1e-9) + 1e-7
    rows = embeddings.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("label").cast("string").alias("label"), plain().alias("v"), F.col("vec_id").cast("long").alias("vec_id"))
    classes = scratch.table(rows.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered at rest
    axes = principal_axes(classes, axes_kept)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the eps-cells of the leading axes."""
        for batch in batches:
            n, vectors = batch.num_rows, batch.column(1)
            dims = np.asarray(batch.column(4))
            cells = np.zeros((n, axes.shape[1]), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(-1, d)
                cells[at] = np.floor(_project(_unit(m), axes) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    placed = classes.select("label", "v", "node", "copies", "dim").mapInArrow(place, "label string, v array<double>, node long, copies long, dim int, cells array<int>")
    order = ["label", "dim", "cells", "node"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequence intervals of at most block_rows vectors of one label, with their boxes."""
        part, seq, held, key = TaskContext.get().partitionId() << 32, 0, [], None

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            m = np.array([r["v"] for r in held], np.float64)
            p = _project(_unit(m), axes)
            first = [r["cells"][0] for r in held]
            out = {
                "block": [part | seq], "label": [key[0]], "dim": [key[1]], "n": [len(held)], "cells": [[min(first), max(first)]], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()],
                "ids": [np.array([r["node"] for r in held], np.int64).tobytes()], "copies": [np.array([r["copies"] for r in held], np.int64).tobytes()], "vectors": [m.tobytes()],
            }
            seq, held = seq + 1, []
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_pydict(out, pa.schema(list(zip(out, kinds))))

        for batch in batches:
            for r in batch.to_pylist():
                if held and ((r["label"], r["dim"]) != key or len(held) >= block_rows):
                    yield close()
                key = (r["label"], r["dim"])
                held.append(r)
        if held:
            yield close()

    blocks = scratch.table(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCK_SCHEMA), "blocks")
    boxes = blocks.select("block", "label", "dim", "lo", "hi", F.col("cells")[0].alias("c0"), F.col("cells")[1].alias("c1"))
    a = boxes.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in ("block", "lo", "hi", "c0", "c1")], F.explode(F.sequence("c0", "c1")).alias("cell"))
    b = boxes.select("label", "dim", *[F.col(c).alias(f"b_{c}") for c in ("block", "lo", "hi", "c0", "c1")], F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    # intervals whose first cells are at most one apart share a cell once b's are widened; the pair counts at the first such cell
    pairs = a.join(b, ["label", "dim", "cell"]).where((F.col("a_block") <= F.col("b_block")) & (F.col("cell") == F.greatest("a_c0", F.col("b_c0") - 1)) & near)
    pairs = scratch.table(pairs.select("a_block", "b_block"), "pairs")
    side = lambda s: blocks.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("dim", "ids", "copies", "vectors")])
    loaded = pairs.join(side("a"), "a_block").join(side("b"), "b_block")
    loaded = loaded.select("a_block", "b_block", "a_dim", "a_ids", "a_copies", "a_vectors", "b_ids", "b_copies", "b_vectors")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, forest = _Join(cosine, eps, axes), Forest()
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids_a, ids_b = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["b_ids"], np.int64)
                va, vb = (np.frombuffer(r[f"{s}_vectors"], np.float64).reshape(-1, r["a_dim"]) for s in "ab")
                ca, cb, found = join.run(va, vb, np.frombuffer(r["a_copies"], np.int64), np.frombuffer(r["b_copies"], np.int64), r["a_block"] == r["b_block"])
                kept = [(p, q) for x, y in found if forest.join(p := int(ids_a[x]), q := int(ids_b[y]))]
                some_a, some_b = np.flatnonzero(ca), np.flatnonzero(cb)
                ids = np.concatenate([ids_a[some_a], ids_b[some_b]])
                n, m = len(ids), len(kept)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.concatenate([ids, np.array([p for p, _ in kept], np.int64)]), pa.int64()),
                    "n": pa.array([*np.concatenate([ca[some_a], cb[some_b]]).tolist(), *[None] * m], pa.int64()),
                    "other": pa.array([*[None] * n, *[q for _, q in kept]], pa.int64()),
                })

    found = scratch.table(loaded.mapInArrow(joined, "id long, n long, other long"), "found")
    counts = found.where("n is not null").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")).join(classes.select("node", "low"), "node")
    return classes, counts, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row a row of ``embeddings(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Only vectors of equal, known label and equal dimension are compared. Null,
    zero or non-finite vectors and those without a label link with nothing and are
    their own component. Rows with a null vec_id get zero links and a null
    component. Repeated rows link with each other like any two vectors, and so do
    different vectors under one vec_id, each by itself. Other columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    classes, counts, edges = links(embeddings, scratch, cosine)
    roots = scratch.table(connected_components(edges, scratch), "roots")
    per = classes.join(counts.drop("low"), "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = per.groupBy("root").agg(F.min("low").alias("component"))
    per = per.join(lows, "root").select(*_class("label", "v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    good = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), good.alias("good"), F.col("label").cast("string").alias("label"), F.when(good, plain()).alias("v"))
    rows = rows.select("vec_id", *[F.when(F.col("good"), h).alias(f"h{k}") for k, h in enumerate(_class("label", "v"), 1)])
    out = rows.join(per, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of embeddings at cosine 0.98, by ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, then what links reach.
OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
q AS (SELECT x, y FROM p UNION SELECT q.x, p.y FROM q JOIN p ON p.x = q.y)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY x) USING (vec_id) LEFT JOIN (SELECT x AS vec_id, min(y) AS low FROM q GROUP BY x) USING (vec_id)
"""
