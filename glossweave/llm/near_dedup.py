"""Near-duplicates by the Jaccard similarity of five-word shingles, 0.8 and more.

First SimHash with pigeonring filtering, as in ``simhash``, over the distinct
five-word shingles: classes whose 64-bit fingerprints differ in at most ``TAU`` bits,
directly or by way of others, make a group, and the whole shingle sets decide
within it. At 0.8 fingerprints differ in some 10 bits, where keys on so few bits
hardly select; so fingerprints find most of the close copies and few pairs near 0.8.
For what lies beyond their radius, and for groups too large for one task, MinHash
bands follow (Broder 1997): 40 bands of 5 minima, which a pair at 0.8 misses
altogether with probability (1 - 0.8^5)^40, about 1e-7. What the fingerprints have
joined already is not searched again. Each link of either step is confirmed on the
whole shingle sets, so nothing below 0.8 is linked.

Work is on classes of equal shingle sets, so groups of copies count once, and on
ids and hashes; texts are read again only to confirm candidates and to return what
stays. Classes not yet joined that share a band make a candidate component. One of at most
``tile`` classes and ``most`` shingles is searched in one task, each of its sets
sent once; a larger one is searched band by band, and a large band by pairs of
tiles. A search goes breadth first over an index of set prefixes (two sets at 0.8
share one of the smallest fifth of their hashes), which gives a spanning tree of
what is similar, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from ._shared import Scratch, doc_key, slices
from .components import Forest, connected_components

WIDTH = 5
#: Bits in which the fingerprints of a group's neighbours differ at most; index keys are 16 bits then.
TAU = 6
BANDS, ROWS = 40, 5
_RNG = np.random.default_rng(42)
_A, _B, _C = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(3))
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(data: bytes | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The distinct word shingles of a UTF-8 text as sorted 64-bit hashes; a shorter text is one shingle, a null, empty or blank one has none."""
    words = (data or b"").lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.unique(np.fromiter((digest(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)))


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if it is set in over half of its hashes."""
    return simhash.majority(s.astype(">u8").view(np.uint8))


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set; none for the empty one."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(s), 256):
        np.minimum(low, (s[k : k + 256, None] * _A + _B).min(0), out=low)
    return ((low * _C).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) ^ _BAND).astype(np.int64)


def similar(a: int, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Jaccard 0.8 and more, from the sets' sizes and what they share."""
    return 9 * common >= 4 * (a + b)


def _marked(keyed: DataFrame) -> DataFrame:
    """``k1, k2, k3, doc_id, head, s1, s2, n, fp, bands`` of ``keyed(k1, k2, k3, doc_id, head, text)``: s1 and s2 name the shingle set (0 for the empty one), n is its size, fp its fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(5).cast(pa.binary()).to_pylist()]
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 1 << 63 for s in sets]
            keys = [bands(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            more = [[(x >> 64) - (1 << 63) if x >> 64 else 0 for x in names], [(x & ((1 << 64) - 1)) - (1 << 63) for x in names], [len(s) for s in sets], [fingerprint(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(x, pa.int64()) for x in more], lists], ["k1", "k2", "k3", "doc_id", "head", "s1", "s2", "n", "fp", "bands"])

    return keyed.select("k1", "k2", "k3", "doc_id", "head", "text").mapInArrow(run, "k1 long, k2 long, k3 long, doc_id long, head string, s1 long, s2 long, n long, fp long, bands array<long>")


def _sets(chosen: DataFrame) -> DataFrame:
    """``node, shingles`` of ``chosen(node, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return chosen.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _group(nodes: np.ndarray, sets: list[np.ndarray], forest: Forest, out: list) -> None:
    """Breadth first over one group's members: a spanning tree of what is similar."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = sizes - (4 * sizes + 4) // 5 + 1  # sets at 0.8 share an element among so many smallest
    element, owner = np.concatenate([s[:k] for s, k in zip(sets, first)]), np.repeat(np.arange(len(sets)), first)
    order = np.argsort(element, kind="stable")
    element, holder = element[order], owner[order]
    edges = np.flatnonzero(np.r_[True, element[1:] != element[:-1], True])
    run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    runs_of: list[list[int]] = [[] for _ in sets]
    for m, r in zip(holder.tolist(), run.tolist()):
        if edges[r + 1] - edges[r] > 1:
            runs_of[m].append(r)
    alive = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start], queue = False, [start]
        while queue:
            x = queue.pop()
            if not runs_of[x]:
                continue
            near = np.unique(np.concatenate([holder[edges[r] : edges[r + 1]] for r in runs_of[x]]))
            near = near[alive[near]]
            near = near[(5 * sizes[near] >= 4 * sizes[x]) & (5 * sizes[x] >= 4 * sizes[near])]
            for k in range(0, len(near), 256):
                some = near[k : k + 256]
                own, others = sets[x], sizes[some]
                flat = np.concatenate([sets[i] for i in some])
                shared = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                hit = some[similar(sizes[x], others, np.add.reduceat(shared, np.r_[0, np.cumsum(others)[:-1]], dtype=np.int64))]
                alive[hit] = False
                for y in hit.tolist():
                    queue.append(y)
                    a, b = int(nodes[x]), int(nodes[y])
                    if forest.join(a, b):
                        out.append((a, b))


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of ``part, node, shingles``, sorted by part; a part's rows may go over several batches."""
    forest, part, held = Forest(), None, {}

    def flush() -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        _group(np.array(list(held), np.int64), [np.frombuffer(x, np.uint64) for x in held.values()], forest, out)
        return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    for batch in slices(batches):
        for k, node, data in zip(*[batch.column(j).to_pylist() for j in range(3)]):
            if k != part:
                if len(held) > 1:
                    yield flush()
                part, held = k, {}
            held[node] = data
    if len(held) > 1:
        yield flush()


def _confirmed(dealt: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """A spanning forest ``(a, b)`` of what is similar among the nodes of each part of ``dealt(part, node)``, on whole sets."""
    chosen = classes.join(dealt.select("node").distinct().hint("merge"), "node", "left_semi").select("k1", "k2", "node")
    sets = scratch.table(_sets(texts.join(chosen.hint("merge"), ["k1", "k2"]).dropDuplicates(["node"])), "sets")
    return dealt.join(sets.hint("merge"), "node").select("part", "node", "shingles").repartition("part").sortWithinPartitions("part").mapInArrow(_search, "a long, b long")


def close(classes: DataFrame, texts: DataFrame, scratch: Scratch, tile: int = 2_000, most: int = 1 << 20, tau: int = TAU) -> DataFrame:
    """A spanning forest ``(a, b)`` of the similar nodes of ``classes(node, k1, k2, n, fp)`` within each group of fingerprints linked at ``tau`` bits.

    Groups of over ``tile`` classes or ``most`` shingles are left to ``links``.
    """
    filled = classes.where("n > 0").select("fp", "node", "n")
    near = simhash.links(filled.select("fp").distinct(), scratch, tau, small=512)
    roots = scratch.table(connected_components(scratch.table(near, "bits"), scratch).withColumnRenamed("node", "fp"), "fps")
    grouped = filled.join(roots.hint("merge"), "fp", "left").select(F.coalesce("root", "fp").alias("part"), "node", "n")
    some = grouped.groupBy("part").agg(F.count("*").alias("all"), F.sum("n").alias("all_shingles")).where((F.col("all") > 1) & (F.col("all") <= tile) & (F.col("all_shingles") <= most))
    dealt = scratch.table(grouped.join(some.select("part").hint("merge"), "part").select("part", "node"), "groups")
    return _confirmed(dealt, classes, texts, scratch)


def links(classes: DataFrame, texts: DataFrame, scratch: Scratch, known: DataFrame, tile: int = 2_000, most: int = 1 << 20) -> DataFrame:
    """What joins the similar nodes of ``classes(node, k1, k2, n, bands)`` beside ``known(node, root)``, as links ``(a, b)``; their texts are in ``texts(k1, k2, text)``."""
    keys = scratch.table(classes.select(F.explode("bands").alias("key"), "node", "n"), "keys")
    alike = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("node").alias("low")).where("members > 1")
    met = scratch.table(keys.join(alike.hint("merge"), "key"), "met")
    scratch.drop(keys)
    del keys, alike
    scratch.sweep()
    near = scratch.table(connected_components(met.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch), "near")
    met = met.join(near.hint("merge"), "node")
    own = near.join(known.withColumnRenamed("root", "own").hint("merge"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    sizes = own.join(classes.select("node", "n").hint("merge"), "node").groupBy("root").agg(F.count("*").alias("all"), F.sum("n").alias("all_shingles"), (F.min("own") < F.max("own")).alias("open"))
    small = (F.col("all") <= tile) & (F.col("all_shingles") <= most)
    sizes = scratch.table(sizes.where("open").select("root", small.alias("small")), "sizes")
    together = near.join(sizes.where("small").hint("merge"), "root").select(F.xxhash64("root").alias("part"), "node")
    apart = met.join(sizes.where("not small").hint("merge"), "root")
    apart = apart.withColumn("tiles", F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("shingles") / most)).cast("int")).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    apart = apart.select("node", "key", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).select(F.xxhash64("key", F.least("t", "o"), F.greatest("t", "o")).alias("part"), "node")
    return _confirmed(scratch.table(together.unionByName(apart), "dealt"), classes, texts, scratch)


def keep_one(docs: DataFrame, tile: int = 2_000) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: the smallest doc_id (null last), then the smallest text by its first 64 characters.

    Rows are told apart by their text, not by doc_id: rows that share a doc_id
    but are not similar all stay. Null, empty and blank texts are copies of each
    other. Rows equal in doc_id and text are chosen from by a hash of the other
    columns (which must not be maps). Other columns of any name pass unchanged; an
    empty table gives no rows. Very long texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "near")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(*doc_key(), F.xxhash64(*others).alias("k3"), F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", 1, 64).alias("head"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("rest"))
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "head", "k1", "k2", "k3")
    marked = _marked(keyed)
    classes = marked.groupBy("s1", "s2").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # numbered once and at rest: the numbers are as they were written, whichever task is run again
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    texts = keyed.select("k1", "k2", "text")
    known = classes.select("node", "row.k1", "row.k2", "n", "fp", "bands")
    found = scratch.table(close(known, texts, scratch, tile), "close")
    joined = scratch.table(connected_components(found, scratch), "joined")
    found = found.unionByName(scratch.table(links(known, texts, scratch, joined, tile), "links"))
    roots = scratch.table(connected_components(found, scratch), "roots")
    kept = classes.select("node", "row").join(roots.hint("merge"), "node", "left")
    scratch.sweep()
    kept = scratch.table(kept.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select("row.k1", "row.k2", "row.k3"), "kept")
    key = ["k1", "k2", "k3"]
    # rows that agree in all columns are numbered; one stays
    left = keyed.select(*key, "text", "rest").join(kept.hint("merge"), key).withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*key))).where("nth = 1")
    return left.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
