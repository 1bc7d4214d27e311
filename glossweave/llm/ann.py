"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Jegou, Douze and Schmid, "Product Quantization for Nearest Neighbor Search"
(PAMI 2011): coarse centroids split the vectors into lists; a vector's residual
to its centroid is quantised part by part; a query's distances to a list's codes
come from asymmetric tables (query exact, vector quantised); the shortlist is
reranked by exact distances on the original vectors. What the shortlist leaves out
is reranked too where the tables cannot rule it out: a vector is at least as far as
its table distance less its own quantisation error, so that within a probed list
the nearest are exact, in groups of any number of near copies too.

Centroids and codebooks are fitted to a bounded sample, those vectors with the
smallest hash of their id (32 a list, between ``SAMPLE_ROWS`` and ``MOST_ROWS``);
every row is indexed. The number of lists grows with the root of the rows up to
2,048, that of ``MOST_ROWS``. How many lists a query probes is set on the sample, as
the least that finds ``aim`` of its exact neighbours; a query that meets fewer than
k candidates goes on to all lists. A list is dealt to tasks in parts of about
``part_rows`` vectors, and its queries in parts of about ``part_queries``, so a list
of any size is spread. Vectors of each dimension are indexed and searched by
themselves, since there is no distance between two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, smallest
from .embedding_dedup import plain, usable

#: Vectors that the index is fitted to: at least (if there are as many) and at most.
SAMPLE_ROWS, MOST_ROWS = 8_192, 65_536


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _squared(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty cell restarts at a random vector
            c[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return c


@dataclass
class Index:
    coarse: np.ndarray  # lists x dim
    books: list[np.ndarray]  # for each part of the residual: codewords x width
    cuts: list[int]
    probes: int

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _squared(x, self.coarse).argmin(1)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(_squared(q, self.coarse), axis=1, kind="stable")[:, :probes]

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes, and how far each vector is from what its code stands for."""
        codes = [_squared(residuals[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        off = sum(((residuals[:, a:b] - book[c]) ** 2).sum(1) for a, b, book, c in zip(self.cuts, self.cuts[1:], self.books, codes))
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(off)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of one query's residual to every codeword: parts x codewords (short books are filled up)."""
        out = np.full((len(self.books), 256), np.inf)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[m, : len(book)] = ((book - residual[a:b]) ** 2).sum(1)
        return out

    def search(self, queries: np.ndarray, own: list, which: int, ids: np.ndarray, codes: np.ndarray, off: np.ndarray, vectors: np.ndarray, k: int, shortlist: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its nearest of one list's part, by the tables and then exactly."""
        parts = np.arange(codes.shape[1])[None, :]
        for at, (q, me) in enumerate(zip(queries, own)):
            rough = self.tables(q - self.coarse[which])[parts, codes].sum(1)
            open_ = ids != me
            some = np.flatnonzero(open_)
            if len(some) > shortlist:
                some = some[np.argpartition(rough[some], shortlist - 1)[:shortlist]]
            exact = np.sqrt(((vectors[some] - q) ** 2).sum(1))
            if len(some) >= k and len(some) < open_.sum():
                worst = np.partition(exact, k - 1)[k - 1]
                open_[some] = False
                more = np.flatnonzero(open_ & (np.sqrt(rough) - off <= worst * (1 + 1e-9) + 1e-9))
                some, exact = np.concatenate([some, more]), np.concatenate([exact, np.sqrt(((vectors[more] - q) ** 2).sum(1))])
            best = np.lexsort((ids[some], exact))[:k]
            yield at, ids[some][best], exact[best]


def n_lists(n_rows: int) -> int:
    return int(max(1, min(MOST_ROWS // 32, 2 ** round(np.log2(max(1.0, np.sqrt(n_rows) / 2))))))


def fit(x: np.ndarray, n_rows: int, parts: int = 16, k: int = 10, aim: float = 0.97, seed: int = 42) -> Index:
    """Centroids, codebooks and the number of lists to probe, from a bounded sample ``x`` of ``n_rows`` vectors."""
    coarse = kmeans(x, max(1, min(n_lists(n_rows), len(x) // 16)), seed=seed)
    own = _squared(x, coarse).argmin(1)
    residuals = x - coarse[own]
    cuts = [round(x.shape[1] * m / parts) for m in range(parts + 1)] if x.shape[1] >= parts else list(range(x.shape[1] + 1))
    books = [kmeans(residuals[:, a:b], 256, seed=seed + a) for a, b in zip(cuts, cuts[1:])]
    asked = x[:: max(1, len(x) // 256)]
    d = _squared(asked, x)
    d[d <= 1e-12] = np.inf  # the query itself and its copies
    nearest = own[np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]] if len(x) > 1 else np.zeros((len(asked), 1), int)
    rank = np.argsort(np.argsort(_squared(asked, coarse), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, nearest, axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1
    return Index(coarse, books, cuts, min(len(coarse), probes))


def train(vectors: DataFrame, dim: int, rows: int) -> Index:
    """From ``vectors(vec_id, v)``: a bounded sample of the ``rows`` that have ``dim`` components."""
    size = max(SAMPLE_ROWS, min(MOST_ROWS, 32 * n_lists(rows)))
    sample = smallest(vectors.where(F.size("v") == dim), F.xxhash64("vec_id"), ["vec_id"], size, rows)
    return fit(np.asarray(sample["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim), rows)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, shortlist: int = 400, part_rows: int = 4096, part_queries: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each of ``queries(vec_id, embedding)``.

    Candidates are all rows of ``vectors(vec_id, embedding)`` of the query's
    dimension but the query's own id; ``score`` is the Euclidean distance of the
    original vectors in double precision, ties go to the smaller vec_id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part,
    nor do rows with a null vec_id. Repeated rows are one candidate. Fewer than k
    candidates: all of them. Other columns are ignored; empty tables give no rows. A
    given ``index`` stands for its dimension. There is one search a dimension.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    good = usable() & F.col("vec_id").isNotNull()
    base = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), plain().alias("v"))
    asked = queries.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), plain().alias("v"))
    dims = {r["dim"]: r["n"] for r in base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a dimension
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim, n in sorted(dims.items()):
        own = index if index is not None and index.dim == dim else train(base, dim, n)
        of_dim = [df.where(F.size("v") == dim) for df in (base, asked)]
        near = scratch.table(_search(*of_dim, own, own.probes, k, shortlist, part_rows, part_queries), "near")
        if own.probes < len(own.coarse):
            met = near.groupBy("query_id").agg(F.countDistinct("vec_id").alias("met")).where(F.col("met") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
            short = scratch.table(of_dim[1].join(met, "vec_id", "left_anti"), "short")
            if short.head(1):
                near = near.union(_search(of_dim[0], short, own, len(own.coarse), k, shortlist, part_rows, part_queries))
        found = found.union(near)
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, asked: DataFrame, index: Index, probes: int, k: int, shortlist: int, part_rows: int, part_queries: int) -> DataFrame:
    """``query_id, vec_id, score``: the k nearest of each list's part that a query probes."""
    dim = index.dim

    def to_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            own = index.lists(x)
            codes, off = index.codes(x - index.coarse[own])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off, pa.float64()), b.column(1)], ["list", "vec_id", "code", "off", "v"])

    def to_probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = index.probed(_matrix(b.column(1), dim), probes)
            n, p = lists.shape
            rows = pa.array(np.repeat(np.arange(n), p))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), b.column(0).take(rows), b.column(1).take(rows)], ["list", "query_id", "q"])

    listed = base.mapInArrow(to_lists, "list int, vec_id long, code binary, off double, v array<double>")
    asks = asked.mapInArrow(to_probes, "list int, query_id long, q array<double>")
    # one row a list, and there are at most 2,048 lists
    n = listed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("row_parts"))
    n = F.broadcast(n.join(asks.groupBy("list").agg(F.ceil(F.count("*") / part_queries).cast("int").alias("query_parts")), "list"))
    rows = listed.join(n, "list").withColumn("rp", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    asks = asks.join(n, "list").withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int")).withColumn("rp", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids = left["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            own = right["query_id"].to_pylist()
            for at, found, score in index.search(_matrix(right["q"], dim), own, left["list"][0].as_py(), ids, codes, left["off"].to_numpy(), _matrix(left["v"], dim), k, shortlist):
                out += zip([own[at]] * len(found), found.tolist(), score.tolist())
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    by = ["list", "rp", "qp"]
    return rows.groupBy(*by).cogroup(asks.select(*[F.col(c).alias(f"q_{c}") for c in by], "query_id", "q").groupBy(*[f"q_{c}" for c in by])).applyInArrow(search, "query_id long, vec_id long, score double")


def op4_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all of embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
