"""The registered queries on small Parquet tables: names, types, and values against independent brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash

from glossweave.llm import queries
from glossweave.llm.bpe import public
from glossweave.llm.line_dedup import chunk_bounds

Q = {re.match(r"op\d+", k)[0]: f for k, f in queries.QUERIES.items() if k.startswith("op")}
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def line(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta"]) + str(rng.randrange(60)) for _ in range(n))


def document_rows():
    rng = random.Random(11)
    shared = ["\n".join(line(rng, 12) for _ in range(4)) for _ in range(3)]
    rows = []
    for k in range(90):
        parts = [line(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[k // 3 % 3])
        if k % 4 == 0:
            parts.append(f"mail me{k}@host.example.org or call +44 20 7946 0{k:03d}, card 4111 1111 1111 1111, from 10.0.{k}.7")
        rows.append((k, "\n".join(parts), "en", f"s{k % 5}"))
    near = rows[7][1] + "\n" + line(rng, 60)
    rows += [(100, rows[5][1], "de", "s1"), (101, rows[5][1], "de", None), (102, near, "en", "s2"), (103, near.replace("alpha", "omega", 1), "en", "s2")]
    rows += [(110, None, None, None), (111, "", "en", "s0"), (112, " \t\n ", "en", "s0"), (113, "one", "en", "s0"), (114, "Word " * 30_000 + "x" * 3000, "en", "s4"), (115, "same row", "en", "s3"), (115, "same row", "en", "s3"), (None, "no id at all", "en", "s3")]
    return rows


@pytest.fixture(scope="module", params=["long", "int"])
def tables(spark, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp(request.param))
    rows = document_rows()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash") for r in rows], f"doc_id {request.param}, text string, lang string, source string, n_chars long, k string, size string")
    docs.repartition(3, "text").write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(5)
    labels = [(r[0], 1, int(r[0] % 9 == 0)) for r in rows if r[0] is not None and r[0] < 90]
    spark.createDataFrame(labels, f"doc_id {request.param}, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    base = rng.normal(size=(300, 8))
    base[200:] = base[rng.integers(0, 200, 100)] + rng.normal(size=(100, 8)) * rng.choice([0.0, 0.05, 0.2], 100)[:, None]
    vectors = [(k, [float(x) for x in v], int(k % 3) if k % 17 else None, "clash") for k, v in enumerate(base)]
    vectors += [(400, None, 1, ""), (500, [0.0] * 8, 1, ""), (501, [float("nan")] * 8, 1, ""), (502, [None] * 8, 1, ""), (503, vectors[1][1], 1, "")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, score string").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def run(spark, name, tables, kinds):
    df = Q[name](spark, tables[0])
    assert {c: k for c, k in df.dtypes if c in kinds} == kinds
    return df.collect()


def by_row(got, rows, *more):
    """The rows of a result beside the input's, by doc_id and, where it repeats, in any order."""
    want = Counter(r[0] for r in rows)
    assert Counter(r.doc_id for r in got) == want
    return {r.doc_id: r for r in got}


def fingerprint(text):
    words = WORD.findall((text or "").encode())
    words = [w.lower() for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1(spark, tables):
    rows = [r for r in tables[1] if r[0] != 114]
    got = by_row(run(spark, "op1", tables, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}), tables[1])
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    for d, x in fp.items():
        assert got[d].fingerprint == f"{x:016x}"
        seen, queue = {d}, [d]
        while queue:
            y = queue.pop()
            new = {z for z in fp if z not in seen and (fp[y] ^ fp[z]).bit_count() <= 4}
            seen |= new
            queue += new
        assert got[d].component_id == min(z for z in seen if z is not None) if seen != {None} else got[d].component_id is None


def test_op2(spark, tables):
    got = run(spark, "op2", tables, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    by_row(got, tables[1])
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op3(spark, tables):
    got = by_row(run(spark, "op3", tables, {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}), tables[1])
    data = [(r[0], (r[1] or "").encode()) for r in tables[1]]
    n = Counter(x[p : p + 200] for _, x in data for p in range(len(x) - 199))
    for d, x in data:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - 199):
            if n[x[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans, kept = int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(b for b, out in zip(x, gone) if not out)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def vectors_of(spark, tables):
    return {r.vec_id: (r.embedding, r.label) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()}


def test_op4(spark, tables):
    got = run(spark, "op4", tables, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    v = {i: np.array(x, float) for i, (x, _) in vectors_of(spark, tables).items() if usable(x)}
    hits = 0
    asked = [i for i in v if i % 100 == 0]
    assert {r.query_id for r in got} == set(asked)
    for q in asked:
        want = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q)[:10]
        own = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 11)) and [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        assert all(abs(s - np.linalg.norm(v[q] - v[i])) < 1e-12 for _, s, i in own)
        hits += len({i for _, i in want} & {i for *_, i in own})
    assert hits >= 0.9 * 10 * len(asked)


def own_bounds(h, window, divisor, longest):
    """The rolling hash without rolling: the polynomial over the last lines, anew for each."""
    out, start = [], 0
    for k in range(len(h)):
        value = sum(x * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, x in enumerate(reversed(h[max(0, k - window + 1) : k + 1]))) % (1 << 64)
        if (value >> 32) % divisor == 0 or k + 1 - start == longest:
            out.append((start, k + 1))
            start = k + 1
    return out + ([(start, len(h))] if start < len(h) else [])


def test_chunk_bounds_without_rolling():
    rng = random.Random(2)
    for window, divisor, longest in ((2, 4, 64), (3, 7, 10), (5, 100, 16)):
        h = [rng.getrandbits(64) for _ in range(400)]
        assert chunk_bounds(h, window, divisor, longest) == own_bounds(h, window, divisor, longest)


def test_op5(spark, tables):
    got = run(spark, "op5", tables, {"n_lines": "int", "n_removed": "int", "kept_sha256": "string"})
    found = by_row(got, tables[1])
    first = {}
    for d, text in sorted({(r[0], r[1]) for r in tables[1] if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, drop = text.split("\n"), set()
        for k in range(len(lines) - 1):
            if lines[k].strip() and lines[k + 1].strip():
                at = first.setdefault((lines[k], lines[k + 1]), (d, k))
                if at != (d, k):
                    drop |= {k + 1} if at == (d, k - 1) else {k, k + 1}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in drop)
        assert (found[d].n_lines, found[d].n_removed, found[d].kept_sha256) == (len(lines), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    assert (found[110].n_lines, found[110].n_removed, found[110].kept_sha256) == (0, 0, None)
    assert sum(r.n_removed for r in got) > 100


def test_op6(spark, tables):
    got = by_row(run(spark, "op6", tables, {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}), tables[1])
    enc = tiktoken.Encoding("own", pat_str=public().pattern, mergeable_ranks=public().ranks(), special_tokens={})
    for d, text, *_ in tables[1]:
        ids, data = enc.encode_ordinary(text or ""), (text or "").encode()
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest())


def test_op8(spark, tables):
    got = run(spark, "op8", tables, {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    v = vectors_of(spark, tables)
    unit = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, (x, y) in v.items() if usable(x) and y is not None}
    near = {i: [j for j in unit if j != i and v[j][1] == v[i][1] and unit[i] @ unit[j] >= 0.98] for i in unit}
    assert sum(map(len, near.values())) > 20
    for r in got:
        seen, queue = {r.vec_id}, [r.vec_id]
        while queue:
            new = set(near.get(queue.pop(), [])) - seen
            seen |= new
            queue += new
        assert tuple(r)[:4] == (r.vec_id, len(near.get(r.vec_id, [])), min(seen), r.vec_id == min(seen))


def spans_of(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else kind == "email" or 9 <= len(d) <= 15

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return sorted([(m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if ok(k, m[0])])


def test_op9(spark, tables):
    kinds = {f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}
    got = by_row(run(spark, "op9", tables, {"doc_id": "bigint", "base_sha256": "string", "spans": "string"} | kinds), tables[1])
    for d, text, *_ in tables[1]:
        base = spans_of(text or "")
        written = [f"{k}:{a}:{b}" for a, _, k, b in base]
        n = Counter(k for _, _, k, _ in base)
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(written) <= set(every) and [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
    assert sum(r.n_card for r in got.values()) > 10


def spark_hash(*parts, seed=42):
    """Spark's xxhash64 of a row: each known part with the hash of those before it as seed."""
    for x in parts:
        if x is not None:
            seed = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.encode(), seed & (2**64 - 1))
    return seed - (1 << 64) if seed >> 63 else seed


def test_op10(spark, tables):
    got = run(spark, "op10", tables, {"doc_id": "bigint" if tables[0].count("long") else "int", "size": "bigint", "target": "double", "taken": "bigint"})
    kind = "<q" if "long" in tables[0].rsplit("/", 1)[-1] else "<i"
    rows = []
    for d, text, _, source in tables[1]:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        tie = spark_hash(None if d is None else struct.pack(kind, d), text, struct.pack("<i", 42))
        u = (spark_hash(struct.pack("<q", tie), struct.pack("<i", 42)) % (1 << 52) + 0.5) / (1 << 52)
        chars, odd = len(text or ""), sum(c in "0123456789#$%&*{}[]<>|\\^~=_+@" for c in text or "")
        shape = 1.0 if 3 <= chars / max(1, size) <= 12 else 0.5
        weight = 0.5 if text is None else max(0.5, 2.0 * shape * max(0.0, 1 - 4 * odd / max(1, chars)))
        rows.append((source, -math.log(u) / weight, d, size))
    sizes = {}
    for source, _, _, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, fixed = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in fixed)
        target = {s: 3 * sizes[s] if s in fixed else rest * weight[s] / sum(weight[t] for t in names if t not in fixed) for s in names}
        above = {s for s in names if s not in fixed and target[s] > 3 * sizes[s]}
        if not above:
            break
        fixed |= above
    want = Counter()
    for s in names:
        epochs, before = int(target[s] / sizes[s] + 1e-9) if sizes[s] else 0, 0
        for _, _, d, size in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            more = size > 0 and before + size / 2 <= target[s] - epochs * sizes[s]
            before += size
            want[(d, s, size, (epochs + more) * size)] += 1
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for f in Q.values():
        assert f(spark, str(tmp_path)).count() == 0
