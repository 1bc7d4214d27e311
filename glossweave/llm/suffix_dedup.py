"""Suffix-array dedup by bucket-pointer refinement: removal of long strings that start more than once.

Schuermann and Stoye, "An incomplex algorithm for fast suffix array construction"
(2007): suffixes are put into buckets by their first q bytes, a position's pointer
names its bucket, and a bucket is refined by sorting on the pointers found as many
bytes later as its members agree on; new pointers are used at once by the buckets
refined after it, so what is told apart grows faster than by doubling.

Which positions can share a bucket is settled first, so that not every position of
the corpus is sorted together. Each window of ``length`` bytes is assigned to its
smallest q-gram by hash (q = length / 4), a matter of its content alone; successive
windows of one q-gram make a context. Equal windows are in contexts of equal
q-grams: the initial buckets. Those with one gram only hold nothing repeated.
The bytes of the others travel once a task and distinct context, equal contexts are
merged by their bytes, and what is left in a bucket is refined on its suffixes.
Hashes only deal out work: a byte goes only if bytes were compared.

A bucket with over ``hot`` different occurrences (a common passage, whose contexts
reach into its neighbours) first loses windows that are unique, dealt by hashes of
their bytes and not by bucket. Windows whose gram is in nearly the same place make a
block; a block is unique if what its windows share is, and repeats throughout if all
of it does. Only windows of the other blocks, some at each edge of a passage, are
hashed one by one. What has a hash of its own is unique, so this drops nothing that
repeats; of contexts that are equal, one stands for all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, doc_key, documents, slices

LENGTH = 200
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Positions of a text that are hashed at once, as a power of two: memory does not follow the text's length.
_BITS = 18
_POWERS: list[np.ndarray] = []
KEY = ("k1", "k2")
#: Documents with contexts in hot buckets, up to which only their texts travel there; the texts of more come with all others.
HOLDERS = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, _INVERSE):
            x = np.full(1 << _BITS, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit rolling hash of each q-gram of at most 2 ** 18 bytes; equal grams have equal hashes."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[q:] - sums[:-q]) * down[: len(data) - q + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, q: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, gram position, first window, last window): each window of ``length`` bytes with its leftmost smallest q-gram."""
    return contexts_of(data, length, q or length // 2)[:4]


def _leftmost(h: np.ndarray, grams: int) -> np.ndarray:
    """Of each ``grams`` successive hashes, the place of the leftmost smallest."""
    low = (h & np.uint64((1 << 64) - (1 << _BITS))) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < grams:
        low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
    return (low & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def contexts_of(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors``, and whether the windows have several grams.

    Successive windows whose grams have one hash are put together, as many as a
    single gram can have, so a run of one character has few contexts. The
    position is that of the first window's gram. Equal windows have their gram at
    the same place, so only a context of several grams can hold a window twice.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, none.astype(bool)
    found, step = [], (1 << _BITS) - 2 * length
    grams = length - q + 1
    for start in range(0, len(data) - length + 1, step):
        part = data[start : start + step + length - 1]
        h = gram_hashes(part, q)
        at = _leftmost(h, grams)
        g = h[at]
        new = np.r_[True, g[1:] != g[:-1]]
        since = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        cut = np.flatnonzero(since % grams == 0)
        first, last = cut, np.r_[cut[1:] - 1, len(at) - 1]
        found.append((g[cut], at[cut] + start, first + start, last + start, at[first] != at[last]))
    return tuple(np.concatenate(x) for x in zip(*found))


_ENDED = np.int64(1 << 40)


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    out, padded = np.zeros(len(data), np.uint64), np.r_[data, np.zeros(8, np.uint8)]
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def pointers(word: np.ndarray, sizes: np.ndarray, length: int, parts: int = 16) -> np.ndarray:
    """Of each position of texts of ``sizes`` bytes, laid end to end, the place of its bucket among the sorted suffixes.

    ``word`` are the ``words`` of the texts. Suffixes end with their text. Buckets
    are ordered as their suffixes; positions stay in one bucket only if they agree
    on ``length`` bytes or up to both ends.
    """
    n = len(word)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    word = word.copy()
    for k in range(1, 8):  # bytes of the next text do not count
        at = np.flatnonzero(left == k)
        word[at] &= ~np.uint64(0) << np.uint64(8 * (8 - k))
    order = np.argsort(word)
    bucket = np.empty(n, np.int64)
    bucket[order] = np.cumsum(np.r_[False, word[order][1:] != word[order][:-1]])
    key = bucket * 16 + np.minimum(left, 9)  # what ends comes first, and is apart
    order = np.argsort(key)
    bucket[order] = np.maximum.accumulate(np.where(np.r_[True, key[order][1:] != key[order][:-1]], np.arange(n), 0))
    agree = np.where(left <= 8, _ENDED, 8)
    del word, key, order
    blocks = int(left.max()) // parts + 1
    while True:
        open_ = np.flatnonzero((np.bincount(bucket, minlength=n)[bucket] > 1) & (agree < length))
        if not len(open_):
            return bucket
        # buckets near the ends of texts first: the others find their pointers refined
        near = np.full(n, n, np.int64)
        np.minimum.at(near, bucket[open_], left[open_])
        block = (near[bucket[open_]] // blocks).astype(np.uint8)
        open_ = open_[np.argsort(block, kind="stable")]
        for part in np.split(open_, np.cumsum(np.bincount(block))[:-1]):
            b, d = bucket[part], agree[part]
            ended = d >= left[part]
            after = np.where(ended, 0, part + d)
            p = np.where(ended, 0, bucket[after] + 1)
            gain = np.where(ended, _ENDED, agree[after])
            key = b * (n + 1) + p
            o = np.argsort(key)
            key, b, part = key[o], b[o], part[o]
            at = np.arange(len(part))
            head = np.maximum.accumulate(np.where(np.r_[True, b[1:] != b[:-1]][: len(b)], at, 0))
            run = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]][: len(b)], at, 0))
            bucket[part] = b + run - head
            agree[part] = np.minimum(d[o] + gain[o], _ENDED)


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, sizes: np.ndarray | None = None) -> np.ndarray:
    """Classes of the positions ``starts``: equal exactly where the ``length`` bytes from there on are equal.

    ``data`` is one text, or texts of ``sizes`` bytes end to end; at least
    ``length`` bytes of a start's own text follow it. Neighbours among the sorted
    suffixes are compared byte by byte, eight at a time.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    word = words(data)
    bucket = pointers(word, np.array([len(data)]) if sizes is None else sizes, length)
    order = np.argsort(bucket[starts], kind="stable")
    p = starts[order]
    differ = np.ones(len(p), bool)
    same = np.arange(1, len(p))
    if length < 8:
        word, step = data, range(length)
    else:
        step = dict.fromkeys([length - 8, *range(0, length - 7, 8)])
    for k in step:
        same = same[word[p[same - 1] + k] == word[p[same] + k]]
    differ[same] = False
    out = np.empty(len(p), np.int64)
    out[order] = np.cumsum(differ) - 1
    return out


def _pos(first: np.ndarray, last: np.ndarray, several: np.ndarray) -> np.ndarray:
    """A context's first window, a bit for several grams, and the number of windows after it in 16 bits."""
    return (first << 17) | (several.astype(np.int64) << 16) | (last - first)


def _place(pos: int) -> tuple[int, int]:
    return pos >> 17, (pos >> 17) + (pos & 0xFFFF)


_LISTED = "k1 long, k2 long, pos long, g long, c long"


def _listed(docs: DataFrame, length: int, q: int) -> DataFrame:
    """``k1, k2, pos, g, c``: of each context its windows, its q-gram and the hash of its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 256):
            out: list[list[np.ndarray]] = []
            src, rows = [], 0

            def made() -> pa.RecordBatch:
                at = pa.array(np.repeat([s for s, _ in src], [n for _, n in src]), pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(np.concatenate([x[j] for x in out]), pa.int64()) for j in range(3)]], [*KEY, "pos", "g", "c"])

            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                if not text.is_valid or len(raw := text.as_buffer()) < length:
                    continue
                view = memoryview(raw)
                g, _, first, last, several = contexts_of(np.frombuffer(raw, np.uint8), length, q)
                c = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64, len(g))
                for a in range(0, len(g), 100_000):
                    b = min(len(g), a + 100_000)
                    out.append([_pos(first[a:b], last[a:b], several[a:b]), g[a:b].view(np.int64), c[a:b].view(np.int64)])
                    src.append((i, b - a))
                    rows += b - a
                    if rows > 100_000:
                        yield made()
                        out, src, rows = [], [], 0
            if rows:
                yield made()

    return docs.select(*KEY, "text").mapInArrow(run, _LISTED)


def _blocks(dealt: DataFrame, length: int, q: int) -> DataFrame:
    """``id, a, b, core, hull``: the blocks of the contexts in ``need``, from the context's window a to b, with a hash of the bytes that all its windows share and of all their bytes."""
    grams = length - q + 1
    step = max(1, grams // 12)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for text, need in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                view = memoryview(text.as_buffer())
                for x in need:
                    first, last = _place(x["pos"])
                    raw = view[first : last + length]
                    at = _leftmost(gram_hashes(np.frombuffer(raw, np.uint8), q), grams)
                    offset = at - np.arange(len(at))  # equal windows have their gram at the same one
                    block = offset // step
                    edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (block[1:] != block[:-1]), True])
                    g = x["g"] & ((1 << 64) - 1)
                    for a, b in zip(edges[:-1].tolist(), (edges[1:] - 1).tolist()):
                        k, o, gram = int(block[a]), int(offset[a]), int(at[a])
                        low, high = gram - k * step, gram - min(k * step + step, grams) + 1 + length
                        core, hull = digest(raw[low:high], g ^ k), digest(raw[a : b + length], g ^ (o + 1 << 32))
                        rows.append((x["id"], a, b, core - (1 << 63), hull - (1 << 63)))
                    if len(rows) > 50_000:
                        yield _table(rows, ["id", "a", "b", "core", "hull"])
                        rows = []
            yield _table(rows, ["id", "a", "b", "core", "hull"])

    return dealt.mapInArrow(run, "id long, a long, b long, core long, hull long")


def _windows(dealt: DataFrame, length: int) -> DataFrame:
    """``id, a, h, only``: each window of the blocks named in ``need`` with its hash; ``only`` is 0 for blocks that repeat throughout."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for text, need in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                view = memoryview(text.as_buffer())
                for x in need:
                    first, g = _place(x["pos"])[0], x["g"] & ((1 << 64) - 1)
                    rows += [(x["id"], k, digest(view[first + k : first + k + length], g) - (1 << 63), x["only"]) for k in range(x["a"], x["b"] + 1)]
                    if len(rows) > 50_000:
                        yield _table(rows, ["id", "a", "h", "only"])
                        rows = []
            yield _table(rows, ["id", "a", "h", "only"])

    return dealt.mapInArrow(run, "id long, a long, h long, only long")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(names))], names)


def _contexts(dealt: DataFrame, length: int, held_bytes: int = 8 << 20) -> DataFrame:
    """``g, c, n, context``: the bytes of the contexts named in ``need``; equal ones of a task are counted together."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], int] = {}
        size = 0

        def made() -> pa.RecordBatch:
            columns = [[k[0] for k in held], [k[1] for k in held], list(held.values()), [k[2] for k in held]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["g", "c", "n", "context"])

        for batch in slices(batches, 64):
            for text, need in zip(batch.column(3).cast(pa.binary()), batch.column(4).to_pylist()):
                if not need:
                    continue
                view = memoryview(text.as_buffer())
                for x in need:
                    first, last = _place(x["pos"])
                    key = (x["g"], x["c"], bytes(view[first : last + length]))
                    if key in held:
                        held[key] += 1
                    else:
                        held[key] = 1
                        size += len(key[2])
                    if size > held_bytes:
                        yield made()
                        held, size = {}, 0
        yield made()

    return dealt.mapInArrow(run, "g long, c long, n long, context binary")


def _refined(contexts: DataFrame, length: int, at_once: int = 1 << 17) -> DataFrame:
    """``g, c, first, last``: runs of windows, from a context's first, that start more than once."""

    def settle(held: list[list]) -> list[tuple[int, int, int, int]]:
        out = []
        sizes = np.array([len(r[3]) for r in held])
        n = sizes - length + 1
        bucket, count = np.array([r[0] for r in held]), np.array([r[2] for r in held])
        _, inverse = np.unique(bucket, return_inverse=True)
        whole = np.bincount(inverse, count == 1)[inverse] == 0  # each of the bucket's contexts has been met twice, byte by byte
        out += [(r[0], r[1], 0, int(w) - 1) for r, w, x in zip(held, n, whole) if x]
        some = np.flatnonzero(~whole)
        if len(some):
            sizes, n = sizes[some], n[some]
            data = np.frombuffer(b"".join(held[k][3] for k in some), np.uint8)
            which = np.repeat(np.arange(len(some)), n)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            cls = refine(data, (np.cumsum(sizes) - sizes)[which] + offset, length, sizes)
            weight = np.bincount(cls, np.array([held[k][2] for k in some], np.float64)[which])
            hit = np.flatnonzero(weight[cls] > 1)
            for part in np.split(hit, np.flatnonzero((np.diff(hit) != 1) | (which[hit][1:] != which[hit][:-1])) + 1):
                if len(part):
                    r = held[some[which[part[0]]]]
                    out.append((r[0], r[1], int(offset[part[0]]), int(offset[part[-1]])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 2048):  # sorted by bucket, hash and bytes
            for g, c, n, context in zip(*[batch.column(j).to_pylist() for j in range(4)]):
                if held and held[-1][0] == g and held[-1][1] == c:
                    if held[-1][3] != context:
                        raise RuntimeError("two contexts share 128 bits of hash; no result is given rather than a wrong one")
                    held[-1][2] += n
                    continue
                if held and held[-1][0] != g and size > at_once:
                    yield _table(settle(held), ["g", "c", "first", "last"])
                    held, size = [], 0
                held.append([g, c, n, context])
                size += len(context)
        if held:
            yield _table(settle(held), ["g", "c", "first", "last"])

    return contexts.repartition("g").sortWithinPartitions("g", "c", "context").mapInArrow(run, "g long, c long, first long, last long")


def _hot(docs: DataFrame, hot: DataFrame, scratch: Scratch, length: int, q: int) -> DataFrame:
    """``k1, k2, pos, g, c`` of what is left of the contexts ``hot(k1, k2, pos, g, c)`` without windows that are unique by hash.

    Contexts that have an equal stay whole; of the others, runs of windows stay, named by the hashes of their parts.
    """

    def named(places: DataFrame, *more: str) -> DataFrame:
        need = places.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "g", "id", *more)).alias("need"))
        return docs.select(*KEY, "text").join(need.hint("merge"), list(KEY)).select("text", "need")

    holders = scratch.table(hot.select(*KEY).distinct(), "holders")
    if holders.count() <= HOLDERS:
        docs = docs.join(F.broadcast(holders), list(KEY), "left_semi")
    equal = hot.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "pos")).alias("one"))
    # numbered once and at rest
    each = scratch.table(equal.select("one.*", "g", "c", "n", F.monotonically_increasing_id().alias("id")), "hot")
    blocks = scratch.table(_blocks(named(each), length, q), "blocks")
    scratch.sweep()
    weight = each.select("id", F.least("n", F.lit(2)).alias("w"))
    block = F.struct("id", "a", "b")
    hulls = blocks.join(weight.hint("merge"), "id").groupBy("core", "hull").agg(F.sum("w").alias("n"), F.min(block).alias("one"))
    hulls = scratch.table(hulls, "hulls")
    cores = hulls.groupBy("core").agg(F.count("*").alias("hulls"), F.min("n").alias("least")).where("hulls > 1 and least = 1")
    open_ = hulls.join(cores.select("core").hint("merge"), "core", "left_semi").select("one.*", F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("only"))
    open_ = scratch.table(open_.join(each.select("id", *KEY, "pos", "g").hint("merge"), "id"), "open")
    windows = scratch.table(_windows(named(open_, "a", "b", "only"), length), "windows")
    scratch.sweep()
    again = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    parts = windows.where("only = 1").join(again.hint("merge"), "h", "left_semi").select("id", "a", F.col("a").alias("b"), "h")
    throughout = blocks.join(hulls.where("n > 1").select("core", "hull").hint("merge"), ["core", "hull"], "left_semi").select("id", "a", "b", F.col("hull").alias("h"))
    alone = each.where("n = 1").select("id", *KEY, "pos", "g")
    parts = parts.unionByName(throughout).join(alone.hint("merge"), "id")
    by = W.partitionBy("id").orderBy("a")
    parts = parts.withColumn("new", F.when(F.col("a") == F.lag("b").over(by) + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = parts.groupBy("id", "run").agg(*[F.first(x).alias(x) for x in (*KEY, "pos", "g")], F.min("a").alias("first"), F.max("b").alias("last"), F.array_sort(F.collect_list(F.struct("a", "h"))).alias("h"))
    begin = F.shiftright("pos", 17) + F.col("first")
    runs = scratch.table(runs.select(*KEY, (F.shiftleft(begin, 17) + F.col("last") - F.col("first")).alias("pos"), "g", F.xxhash64("h.h").alias("c")), "runs")
    for done in (blocks, hulls, open_, windows, holders):
        scratch.drop(done)
    return hot.join(each.where("n > 1").select("g", "c").hint("merge"), ["g", "c"], "left_semi").select(*KEY, "pos", "g", "c").unionByName(runs)


def repeated(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot: int = 4_000) -> DataFrame:
    """``docs(k1, k2, doc_id, text)`` with ``spans``: byte ranges (first, last, end exclusive), unmerged, that are covered by repeated strings; null if none."""
    if length > 1 << 16:
        raise ValueError("strings of more than 65,536 bytes are not supported")
    dealt = lambda places: docs.join(places.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "g", "c")).alias("need")), list(KEY), "left").select(*KEY, "doc_id", "text", "need")
    each = scratch.table(_listed(docs, length, max(1, length // 4)), "contexts")
    grams = F.sum(1 + F.shiftright("pos", 16).bitwiseAND(F.lit(1)))  # a context of several counts as two
    buckets = each.groupBy("g").agg(grams.alias("n"), (F.min("c") < F.max("c")).alias("several")).where("n > 1")
    places = scratch.table(each.join(buckets.select("g", (F.col("several") & (F.col("n") > hot)).alias("hot")), "g").select(*KEY, "pos", "g", "c", "hot"), "places")
    scratch.drop(each)
    del each, buckets
    scratch.sweep()
    if places.where("hot").head(1):
        left = scratch.table(_hot(docs, places.where("hot").drop("hot"), scratch, length, max(1, length // 4)), "left")
        scratch.sweep()
        places = places.where("not hot").drop("hot").unionByName(left)
    # both joins read the documents by the same exchange
    found = _refined(_contexts(dealt(places), length), length)
    spans = places.join(found, ["g", "c"]).select(*KEY, (F.shiftright("pos", 17) + F.col("first")).alias("first"), (F.shiftright("pos", 17) + F.col("last") + length).alias("last"))
    spans = spans.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return docs.join(spans, list(KEY), "left")


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs, left to right."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeated(docs: DataFrame, length: int = LENGTH, hot: int = 4_000) -> DataFrame:
    """``doc_id, kept BINARY, spans``: each row of ``docs(doc_id, text)`` without the bytes that repeated strings cover.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else,
    in the same text (overlapping too), in another one or in a repeated row; so no
    copy stays. Matches never cross documents. Null texts count as empty, shorter
    ones than ``length`` stay whole. Rows with null ids are like any other; other
    columns are ignored. ``hot`` changes the plan, never the result.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = repeated(plain.select(*doc_key(), "doc_id", "text"), scratch, length, hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches, 256):
            kept, spans = [], []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                runs, at, parts = merged(found), 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
                spans.append([{"first": a, "last": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "kept", "spans"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, spans array<struct<first: long, last: long>>")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of ``remove_repeated`` over all documents: nulls are empty texts, a row of output for each row of input."""
    out = remove_repeated(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return out.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes of every text, in hexadecimal so that positions are bytes.
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
again AS MATERIALIZED (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
runs AS MATERIALIZED (SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, count(*) FILTER (prev IS NULL OR p > prev + 200) OVER (PARTITION BY r ORDER BY p) AS g
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM again)) GROUP BY r, g),
parts AS (SELECT r, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept
  FROM (SELECT runs.*, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS piece FROM runs JOIN d USING (r)) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""
