"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprint: 64 bits over word shingles (Charikar 2002). Search: Qin and Xiao,
"Pigeonring: A Principle for Faster Thresholded Similarity Search" (VLDB 2018).
With m = tau + 1 segments on a ring, two fingerprints at Hamming distance at
most tau have a segment from which every chain of l consecutive segments holds
at most floor(l * tau / m) differing bits. So the first segment agrees and the
next differs in at most one bit: an index on "first segment, next segment less
one of four bit groups" meets every pair. Chains of three and four segments
prune what shares a key before the full Hamming check.

Work is on distinct fingerprints, so groups of copies count once. A key's
members are searched breadth first inside one task, which gives a spanning tree
of the group and not its pairs; a key with more than ``tile`` members is dealt
to tasks by pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents
from .components import Forest, connected_components

GROUPS = 4


def fingerprint(data: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; null, empty and blank texts give 0."""
    words = (data or b"").lower().split()  # ASCII letters and the six ASCII spaces only, as bytes
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        digests = [xxhash.xxh64_digest(text, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = [digest(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return majority(np.frombuffer(b"".join(digests), np.uint8))


def majority(digests: np.ndarray) -> int:
    """The bits set in over half of the 8-byte ``digests``, laid end to end, as a signed 64-bit integer."""
    n, counts = len(digests) // 8, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        counts += np.unpackbits(digests[8 * k : 8 * (k + (1 << 14))].reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp BIGINT)`` for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, width, seed) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring(tau: int) -> list[int]:
    """Masks of the tau + 1 segments of a 64-bit ring, from the highest bits on."""
    m = tau + 1
    cuts = [round(64 * k / m) for k in range(m + 1)]
    return [((1 << (cuts[k + 1] - cuts[k])) - 1) << (64 - cuts[k + 1]) for k in range(m)]


def key_masks(tau: int) -> list[int]:
    """Of each start on the ring and each bit group of the next segment: the bits that must agree."""
    segments, out = ring(tau), []
    for k, first in enumerate(segments):
        bits = [b for b in range(64) if segments[(k + 1) % (tau + 1)] >> b & 1]
        for g in range(GROUPS):
            dropped = bits[len(bits) * g // GROUPS : len(bits) * (g + 1) // GROUPS]
            out.append(first | sum(1 << b for b in bits if b not in dropped))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Chains:
    """The pigeonring test of pairs from one start of the ring, then the Hamming distance."""

    def __init__(self, tau: int):
        self.tau, m, masks = tau, tau + 1, ring(tau)
        self.quota = [(n * tau) // m for n in range(1, m + 1)]
        self.prefix = [np.array([sum(masks[(k + j) % m] for j in range(n)) for n in range(1, m + 1)], np.uint64) for k in range(m)]

    def linked(self, differing: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        alive = np.arange(len(differing))
        starts = np.broadcast_to(np.asarray(start), differing.shape)
        table = np.stack(self.prefix)
        for n, most in enumerate(self.quota):  # ever longer chains; the last is the whole ring
            alive = alive[np.bitwise_count(differing[alive] & table[starts[alive], n]) <= most]
        return alive


def _search(tau: int, small: int = 48):
    chains = _Chains(tau)

    def group(fps: np.ndarray, table: int, forest: Forest, out: list) -> None:
        """Breadth first over one key's members: a spanning tree of what is linked."""
        rest = np.arange(len(fps))
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                hit = chains.linked(fps[rest] ^ fps[x], table // GROUPS)
                if len(hit):
                    for y in rest[hit].tolist():
                        queue.append(y)
                        a, b = int(fps[x].astype(np.int64)), int(fps[y].astype(np.int64))
                        if forest.join(a, b):
                            out.append((a, b))
                    rest = np.delete(rest, hit)

    def flush(keys: np.ndarray, tables: np.ndarray, fps: np.ndarray, forest: Forest) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(cuts)
        big = sizes > small
        for a, n in zip(cuts[:-1][big], sizes[big]):
            for t in np.unique(tables[a : a + n]):  # keys of two tables may collide
                group(np.unique(fps[a : a + n][tables[a : a + n] == t]), int(t), forest, out)
        size_of = np.repeat(sizes, sizes)
        left = np.flatnonzero(size_of <= small)
        step = 1
        while len(left):
            left = left[left + step < len(keys)]
            left = left[keys[left] == keys[left + step]]
            pairs = left[(tables[left] == tables[left + step]) & (fps[left] != fps[left + step])]
            hit = pairs[chains.linked(fps[pairs] ^ fps[pairs + step], tables[pairs] // GROUPS)]
            for a, b in zip(fps[hit].astype(np.int64).tolist(), fps[hit + step].astype(np.int64).tolist()):
                if forest.join(a, b):
                    out.append((a, b))
            step += 1
        return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in batches:  # sorted by key; a key's rows may go over several batches
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint64)]
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if cut:
                yield flush(*[x[:cut] for x in rows], forest)
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield flush(*held, forest)

    return run


def links(nodes: DataFrame, scratch: Scratch, tau: int = 4, tile: int = 20_000, small: int = 48) -> DataFrame:
    """A spanning forest ``(a, b)`` of the fingerprints ``nodes(fp)`` that differ in at most ``tau`` bits.

    Keys of up to ``small`` members are compared pair by pair, many at once; that changes the plan only.
    """
    masks = key_masks(tau)
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("tab", "bits")).select(F.xxhash64("tab", "bits").alias("key"), F.col("tab").cast("int").alias("tab"), "fp")
    hot = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile), "hot")
    plain = keys
    if hot.head(1):
        tiles = F.ceil(F.col("n") / tile).cast("int")
        dealt = keys.join(hot, "key", "left").withColumn("tiles", F.coalesce(tiles, F.lit(1))).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        dealt = dealt.select("tab", "fp", "key", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
        plain = dealt.select(F.xxhash64("key", F.least("t", "o"), F.greatest("t", "o")).alias("key"), "tab", "fp")
    return plain.repartition("key").sortWithinPartitions("key").mapInArrow(_search(tau, small), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = 4, width: int = 4, tile: int = 20_000) -> DataFrame:
    """One row a row of ``docs``: ``doc_id, fp, component_id`` (smallest doc_id reachable by links), ``root`` (its smallest fingerprint).

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Equal texts and repeated rows share a fingerprint, hence a component. A null
    doc_id gets the component's smallest known one (null if there is none). Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, width), "fps")
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = scratch.table(connected_components(links(nodes, scratch, tau, tile), scratch), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.select("fp", "root").join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    return fps.join(named.select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
