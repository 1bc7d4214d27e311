"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last few line hashes chooses chunk
boundaries, so inserting or deleting a line moves boundaries only nearby. A chunk
of several lines that occurs more than once in the corpus, compared byte by byte,
is kept where it comes first (smallest doc_id, then position) and removed
everywhere else. Single lines and blank ones are never removed.

Chunks at the edges of a repeated passage hold neighbours' lines and do not
repeat. So with ``pairs`` the pieces are also every two successive lines that are
not blank, with the blank ones between them: a run of two lines and more that came
earlier consists of such pairs and goes whole, up to its edges.

What is shuffled first is one row of hashes a piece. Bytes follow only for pieces
whose hash repeats, out of the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, doc_key, documents, free, slices

#: Lines that the rolling hash sees, the mean number of lines between boundaries, and the longest chunk.
WINDOW, DIVISOR, LONGEST = 2, 4, 64
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunk_bounds(hashes: list[int], window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(first, end) of each chunk of lines: a boundary follows a line where the rolling hash of the last ``window`` lines is 0 modulo ``divisor``."""
    out, start, rolled, power = [], 0, 0, pow(_BASE, window, 1 << 64)
    for k, h in enumerate(hashes):
        rolled = (rolled * _BASE + h) & _MASK
        if k >= window:
            rolled = (rolled - hashes[k - window] * power) & _MASK
        if (rolled >> 32) % divisor == 0 or k + 1 - start >= longest:
            out.append((start, k + 1))
            start = k + 1
    if start < len(hashes):
        out.append((start, len(hashes)))
    return out


def chunks(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, lines) in bytes of the chunks of a text; a chunk ends before the line break that follows it."""
    lines = data.split(b"\n")
    digest = xxhash.xxh3_64_intdigest
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    return [(starts[a], starts[b - 1] + len(lines[b - 1]), b - a) for a, b in chunk_bounds([digest(x) for x in lines])]


class Pieces:
    """What of a text may repeat: spans (first, end) of lines; the chunks, and with ``pairs`` the pairs."""

    def __init__(self, data: bytes, pairs: bool):
        self.data, lines = data, data.split(b"\n")
        digest = xxhash.xxh3_64_intdigest
        ends = list(accumulate(len(x) + 1 for x in lines))
        self.starts, self.ends = [0, *ends[:-1]], [x - 1 for x in ends]
        self.spans = chunk_bounds([digest(x) for x in lines])
        if pairs:
            filled = [j for j, x in enumerate(lines) if x and not x.isspace()]
            self.spans = list({*self.spans, *((a, b + 1) for a, b in zip(filled, filled[1:]))})

    def bytes_of(self, a: int, b: int) -> bytes:
        return self.data[self.starts[a] : self.ends[b - 1]]


def _listed(docs: DataFrame, pairs: bool) -> DataFrame:
    """``k1, k2, doc_id, a, b, h1, h2`` of each piece of several lines of ``docs(k1, k2, doc_id, text)``: the 128 bits of its hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in slices(batches):
            rows, src = [], []
            for i, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                own = Pieces(text or b"", pairs)
                for a, b in own.spans:
                    if b - a > 1 and not (piece := own.bytes_of(a, b)).isspace():
                        h = digest(piece)
                        rows.append((a, b, (h >> 64) - (1 << 63), (h & _MASK) - (1 << 63)))
                        src.append(i)
            src = pa.array(src, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(src) for j in range(3)], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], ["k1", "k2", "doc_id", "a", "b", "h1", "h2"])

    return docs.select("k1", "k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, a int, b int, h1 long, h2 long")


def _bytes_of(dealt: DataFrame) -> DataFrame:
    """``h1, h2, piece``: the bytes of the pieces named in ``ats`` beside the hash they are listed under."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, ats in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                own = Pieces(text or b"", False)
                rows += {(x["h1"], x["h2"], own.bytes_of(x["a"], x["b"])) for x in ats}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h1", "h2", "piece"])

    return dealt.select("text", "ats").mapInArrow(run, "h1 long, h2 long, piece binary")


def _removals(keyed: DataFrame, scratch: Scratch, pairs: bool) -> DataFrame:
    """``k1, k2, ats``: of each document, the spans of lines to remove.

    A hash only names a piece. The bytes of all pieces whose hash repeats are
    compared, each distinct one of a task once; should two texts share a hash, the
    query fails rather than remove what does not repeat. Joins on a hash are between
    plain exchanges, so those of a very common piece are split at run time.
    """
    hashes, key = ["h1", "h2"], ["k1", "k2"]
    each = scratch.table(_listed(keyed, pairs), "pieces")
    repeated = each.groupBy(*hashes).agg(F.count("*").alias("n")).where("n > 1").select(*hashes)
    placed = scratch.table(each.join(repeated.hint("merge"), hashes, "left_semi"), "placed")
    scratch.drop(each)
    del each, repeated
    scratch.sweep()
    wanted = placed.groupBy(*key).agg(F.collect_list(F.struct("a", "b", *hashes)).alias("ats"))
    texts = _bytes_of(keyed.select(*key, "text").join(wanted.hint("merge"), key)).distinct()
    compared = scratch.table(texts.groupBy(*hashes).agg(F.count("*").alias("texts")), "compared")
    first = placed.groupBy(*hashes).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key, "a", "b")).alias("first"))
    first = scratch.table(first.join(compared, hashes).select(*hashes, F.when(F.col("texts") == 1, F.col("first")).otherwise(F.raise_error(F.lit("two pieces share 128 bits of hash"))).alias("first")), "first")
    del texts, wanted
    scratch.sweep()
    own = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    later = placed.join(first.hint("merge"), hashes).where(~own | (F.col("a") != F.col("first.a")))
    fresh = F.when(own, F.greatest("a", "first.b")).otherwise(F.col("a"))  # what it shares with its first occurrence stays
    return later.groupBy(*key).agg(F.collect_set(F.struct(fresh.alias("a"), "b")).alias("ats"))


def remove_repeated(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """``docs`` with all its columns, its text without repeated chunks, and ``__lines, __removed``.

    With ``pairs``, without repeated runs of two lines and more up to their edges;
    what repeats right after itself keeps its first two lines. Rows that agree in
    doc_id and text are one document and share the result. Null texts stay null;
    empty texts and those of one line stay as they are; a text whose pieces all
    came earlier becomes empty. A null doc_id sorts last. Other columns of any
    name pass unchanged; where one is called ``__lines`` or ``__removed``, the
    count's name gets underscores after it, and the counts are the last two columns.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(*doc_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.struct(*others) if others else F.lit(None)).alias("rest"))
    gone = scratch.table(_removals(keyed.select("k1", "k2", "doc_id", "text"), scratch, pairs), "gone")

    @F.pandas_udf("text string, lines int, removed int")
    def cut(texts, ats):
        import pandas as pd

        rows = []
        for text, out in zip(texts, ats):
            if text is None:
                rows.append((None, 0, 0))
                continue
            data = text.encode()
            lines = data.count(b"\n") + 1
            if out is None or not len(out):
                rows.append((text, lines, 0))
                continue
            own = Pieces(data, False)
            drop = {j for x in out for j in range(x["a"], x["b"])}
            kept = [data[a:b] for j, (a, b) in enumerate(zip(own.starts, own.ends)) if j not in drop]
            rows.append((b"\n".join(kept).decode(), lines, len(drop)))
        return pd.DataFrame(rows, columns=["text", "lines", "removed"])

    joined = keyed.select("k1", "k2", "text", "rest").join(gone.hint("merge"), ["k1", "k2"], "left").select("rest", cut("text", "ats").alias("cut"))
    columns = [F.col("cut.text").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.col("cut.lines").alias(free(docs.columns, "__lines")), F.col("cut.removed").alias(free(docs.columns, "__removed")))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines removed and a digest of the text left, of every row of documents (null where the text is null)."""
    out = remove_repeated(documents(spark, sf_dir).select("doc_id", "text"), pairs=True)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
