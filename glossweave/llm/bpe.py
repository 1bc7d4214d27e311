"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are listed with their positions, each distinct one is encoded once in
the whole corpus, ids are joined back, and texts are put together by position;
decoding joins the table of token bytes.

What travels is packed by blocks of documents, the token-byte table too: it is
joined to the rows of blocks, of which each gets one packed copy (some hundred KB
for 32 MB of text). A block holds its texts as
sequences of slots (the positions), and lists its distinct words once, dealt by
a hash of the word into buckets. The first exchange brings a bucket's words from
all blocks together, where each is encoded once; the second brings the ids back
to their block. A row is a block's part of a bucket, so no word is ever a hot
key: it has one entry a block, however often it occurs. Positions take both
exchanges, compressed near their entropy: keeping them out of the first one would
mean to write the blocks to disk, which costs more than it saves.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._shared import documents

#: Kind 0: a block's documents (ids, lengths) and positions (data). Kind 1: words of one bucket (data) and their slots. Kind 2: their ids (data) and numbers of ids (lengths).
ROW = "block long, kind int, bucket int, docs array<long>, known array<boolean>, lengths binary, slots binary, data binary"
FIELDS = [("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("slots", pa.binary()), ("data", pa.binary())]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """A tokenizer's ranks and pattern, small enough (some 50,000 tokens) to travel with the code."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        ranks = load_ranks(path)
        self.packed = zlib.compress("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()).encode())

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, zlib.decompress(self.packed).splitlines())}

    def tokens(self, spark: SparkSession) -> DataFrame:
        """``(id, token BINARY)``: its size is that of the vocabulary, so it may be broadcast."""
        ranks = self.ranks()
        return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks.keys(), pa.binary())}))


def public(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


_ENCODERS: dict[int, tiktoken.Encoding] = {}


def _encoder(v: Vocabulary) -> tiktoken.Encoding:
    key = hash((v.packed, v.pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})
    return _ENCODERS[key]


def _pack_table(ranks: dict[bytes, int]) -> bytes:
    """Token bytes by id, packed: ids, lengths and bytes."""
    ids = sorted((r, t) for t, r in ranks.items())
    head = np.array([len(ids), *[r for r, _ in ids], *[len(t) for _, t in ids]], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(t for _, t in ids))


def _unpack_table(data: bytes) -> dict[int, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    numbers = np.frombuffer(raw, np.uint32, 2 * n, 4)
    ends = np.cumsum(numbers[n:].astype(np.int64)) + 4 + 8 * n
    return {r: raw[b - k : b] for r, k, b in zip(numbers[:n].tolist(), numbers[n:].tolist(), ends.tolist())}


def _pack(x: np.ndarray | bytes) -> bytes:
    """Compressed; numbers by planes of their bytes, whose upper ones are nearly constant."""
    if not isinstance(x, bytes):
        x = np.ascontiguousarray(np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpack(x: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view(np.uint32).ravel()


def _pack_codes(x: np.ndarray) -> bytes:
    """Slots by frequency, near their entropy: lengths in bits, compressed, and then by length the bits below the leading one."""
    v = x.astype(np.uint32) + np.uint32(1)
    length = (np.frexp(v.astype(np.float64))[1] - 1).astype(np.uint8)
    parts = [zstandard.ZstdCompressor(level=3).compress(length.tobytes())]
    for k in range(1, 32):
        own = v[length == k]
        parts.append(np.packbits(np.unpackbits(own.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - k :]).tobytes())
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _unpack_codes(data: bytes) -> np.ndarray:
    sizes = np.frombuffer(data, np.uint32, 32)
    ends = np.cumsum(sizes.astype(np.int64)) + 128
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[128 : ends[0]]), np.uint8)
    v = np.left_shift(np.uint32(1), length.astype(np.uint32))
    for k in range(1, 32):
        at = np.flatnonzero(length == k)
        if len(at):
            bits = np.unpackbits(np.frombuffer(data, np.uint8, int(sizes[k]), int(ends[k - 1])), count=len(at) * k).reshape(-1, k)
            wide = np.zeros((len(at), 32), np.uint8)
            wide[:, 32 - k :] = bits
            v[at] |= np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)
    return v - np.uint32(1)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(FIELDS)], schema=pa.schema(FIELDS))


def blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int = 32 << 20) -> DataFrame:
    """The documents' positions (kind 0) and distinct words (kind 1); a block ends after ``block_chars`` of text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seq, size = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32, 0
        slot: dict[str, int] = {}
        ids, lengths, sequences = [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            codes = np.concatenate(sequences)
            order = np.argsort(-np.bincount(codes, minlength=len(slot)), kind="stable")  # frequent words get small slots
            rank = np.empty(len(slot), np.uint32)
            rank[order] = np.arange(len(slot), dtype=np.uint32)
            yield _rows([(seq, 0, int(xxhash.xxh32_intdigest(str(seq))) % buckets, ids, [x is not None for x in ids], _pack(np.array(lengths)), None, _pack_codes(rank[codes]))])
            dealt: dict[int, list] = {}
            for word, k in slot.items():
                raw = word.encode()
                dealt.setdefault(xxhash.xxh32_intdigest(raw) % buckets, []).append((raw, k))
            for bucket, words in dealt.items():
                words.sort()
                yield _rows([(seq, 1, bucket, None, None, _pack(np.array([len(w) for w, _ in words])), _pack(rank[[k for _, k in words]]), _pack(b"".join(w for w, _ in words)))])
            seq += 1
            slot.clear()
            for x in (ids, lengths, sequences):
                x.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(text or "")
                get = slot.setdefault
                sequences.append(np.fromiter((get(w, len(slot)) for w in words), np.uint32, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                size += len(text or "")
                if size >= block_chars:
                    yield from close()
                    size = 0
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW)


def encode_words(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """Kind 1 becomes kind 2: a bucket's distinct words are encoded once each; kind 0 passes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known, bucket = _encoder(v)._encode_single_piece, {}, None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].as_py() == 0:
                    yield batch.slice(k, 1)
                    continue
                row = batch.slice(k, 1).to_pylist()[0]
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                data, at, found = zstandard.ZstdDecompressor().decompress(row["data"]), 0, []
                for n in _unpack(row["lengths"]).tolist():
                    word = data[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(piece(word), np.uint32)
                    found.append(ids)
                yield _rows([(row["block"], 2, bucket, None, None, _pack(np.array([len(x) for x in found])), row["slots"], _pack(np.concatenate(found)))])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ROW)


def decode_ids(encoded: DataFrame, v: Vocabulary, key: str) -> DataFrame:
    """``key, ids, bytes`` from ``(key, ids)``, one row a key: each id is joined to the table of token bytes and put together by position."""
    tokens = F.broadcast(v.tokens(encoded.sparkSession))
    each = encoded.select(key, F.posexplode_outer("ids").alias("at", "id"))
    each = each.join(tokens, "id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id", "token"))).alias("t"))
    # by way of hexadecimal, as array_join is linear where folding with concat is not
    joined = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["token"])), ""))
    return each.select(key, F.filter(F.transform("t", lambda x: x["id"]), lambda x: x.isNotNull()).alias("ids"), joined.alias("bytes"))


def by_document(docs: DataFrame, v: Vocabulary, schema: str, make, buckets: int | None = None) -> DataFrame:
    """``make(ids_of_slot, token_bytes)`` prepares a block and returns what turns a document's slots into columns after doc_id.

    A bucket is for some 8 million characters of text, counted in a pass of its own
    unless ``buckets`` is given.
    """
    if buckets is None:
        buckets = max(64, (docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) >> 23)
    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(f"doc_id long, {schema}"))]
    names = [f.name for f in _parse_datatype_string(f"doc_id long, {schema}")]

    def run(group: pa.Table) -> pa.Table:
        parts: list = []
        texts, table = [], None
        for row in group.to_pylist():
            if row["kind"] == 0:
                texts.append(row)
                table = table or _unpack_table(row["tokens"])
            else:
                slots, n = _unpack(row["slots"]), _unpack(row["lengths"])
                parts.append((slots, np.split(_unpack(row["data"]), np.cumsum(n)[:-1])))
        ids: list = [None] * sum(len(s) for s, _ in parts)
        for slots, found in parts:
            for k, x in zip(slots.tolist(), found):
                ids[k] = x
        each, out = make(ids, table), []
        for row in texts:
            lengths, codes = _unpack(row["lengths"]), _unpack_codes(row["data"])
            ends = np.cumsum(lengths.astype(np.int64))
            for doc_id, known, a, b in zip(row["docs"], row["known"], (ends - lengths).tolist(), ends.tolist()):
                out.append((doc_id if known else None, *each(codes[a:b])))
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(names, kinds))})

    packed = docs.sparkSession.createDataFrame(pa.table({"kind": pa.array([0], pa.int32()), "tokens": pa.array([_pack_table(v.ranks())], pa.binary())}))
    joined = encode_words(blocks(docs, v.pattern, buckets), v).join(F.broadcast(packed), "kind", "left")
    return joined.groupBy("block").applyInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, ids ARRAY<INT>``, one row a row of ``docs(doc_id, text)``.

    Each match of the pattern is encoded by itself, without special tokens. Null
    and empty texts have no ids; repeated rows, null doc_ids and very long texts
    are documents like any other; other columns are ignored.
    """

    def make(ids: list, table: dict[int, bytes]):
        return lambda codes: ([x for c in codes.tolist() for x in ids[c].tolist()],)

    return by_document(docs, v, "ids array<int>", make)


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, text`` from ``(doc_id, ids)``; rows that agree in both share the result, each keeping its row."""
    keyed = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.xxhash64("doc_id", "ids", F.size("ids")).alias("__k"))
    texts = decode_ids(keyed.dropDuplicates(["__k"]).select("__k", "ids"), v, "__k").select("__k", "bytes")
    return keyed.join(texts, "__k").select("doc_id", F.decode("bytes", "UTF-8").alias("text"))


def digests(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: per document, digests of the ids as text and of the bytes that the ids join to in the token table.

    Null texts count as empty; a row of output for each row of input, repeated rows,
    null doc_ids and very long texts included; other columns are ignored.
    """

    def make(ids: list, table: dict[int, bytes]):
        count = np.array([len(x) for x in ids], np.int64)
        text = [b" ".join([b"%d" % x for x in own]) for own in (x.tolist() for x in ids)]
        raw = [b"".join([table[x] for x in own]) for own in (x.tolist() for x in ids)]

        def each(codes: np.ndarray) -> tuple:
            own = codes.tolist()
            return int(count[codes].sum()), hashlib.sha256(b" ".join(map(text.__getitem__, own))).hexdigest(), hashlib.sha256(b"".join(map(raw.__getitem__, own))).hexdigest()

        return each

    return by_document(docs, v, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digests`` of all documents under the public byte-level vocabulary."""
    return digests(documents(spark, sf_dir), public())
