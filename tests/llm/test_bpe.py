import hashlib

import numpy as np
import tiktoken

from glossweave.llm.bpe import _encoder, _pack_codes, _unpack_codes, blocks, decode, digests, encode, public

TEXTS = [None, "", " ", "a", "don't  stop\n\n\tnow  ", "élan vital über 12345 €€ 漢字 \U0001f600", "<|endoftext|> is text", "x" * 5000, "word " * 30000, "the the the", "the the the", "   mixed\r\nspace"]


def test_round_trip_and_reference_encoder(spark):
    v = public()
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})
    rows = [(k if k != 3 else None, t, "clash") for k, t in enumerate(TEXTS)] + [(1, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(docs, v)
    want = sorted((d if d is not None else -1, tuple(enc.encode_ordinary(t or ""))) for d, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in got.collect()) == want
    texts = sorted((d if d is not None else -1, t or "") for d, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in decode(got, v).collect()) == texts
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in digests(docs, v).collect():
        if r.doc_id is not None:
            t = TEXTS[r.doc_id] or ""
            ids = enc.encode_ordinary(t)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert encode(docs.limit(0), v).count() == 0 and digests(docs.limit(0), v).count() == 0


def test_small_blocks(spark):
    v = public()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    rows = blocks(docs, v.pattern, 5, 1000)
    assert rows.where("kind = 0").count() >= 3
    assert rows.where("kind = 1").select("bucket").distinct().count() <= 5
    assert _encoder(v) is _encoder(v)


def test_packed_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = (rng.pareto(0.7, n) * 3).clip(0, 2**31).astype(np.uint32)
        assert (_unpack_codes(_pack_codes(x)) == x).all()
