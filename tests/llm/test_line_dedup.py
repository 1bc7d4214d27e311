import random

import xxhash

from glossweave.llm.line_dedup import chunk_bounds, chunks, remove_repeated


def brute(rows):
    """(doc_id, text) rows, distinct: keep the first occurrence of each multi-line chunk."""
    cut = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen = set()
    for doc_id, text in order:
        kept, removed, data = [], 0, (text or "").encode()
        for a, b, n in chunks(data):
            piece = data[a:b]
            if n > 1 and not piece.isspace() and piece in seen:
                removed += n
            else:
                kept.append(piece)
            if n > 1:
                seen.add(piece)
        cut[doc_id] = (b"\n".join(kept).decode() if text is not None else None, removed)
    return cut


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh", "é"]) + str(rng.randrange(40)) for _ in range(4))
    shared = [[line() for _ in range(12)] for _ in range(3)]
    rows = []
    for k in range(n):
        lines = [line() for _ in range(rng.randint(0, 8))]
        if k % 2:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared[k % 3]
        rows.append((k, "\n".join(lines)))
    return rows + [(n + j, rows[5][1]) for j in range(4)]


def test_bounds_are_content_defined():
    rng = random.Random(1)
    h = [rng.getrandbits(64) for _ in range(500)]
    a, b = chunk_bounds(h), chunk_bounds([7, 8, 9, *h])
    shared = {(x, y) for x, y in a} & {(x - 3, y - 3) for x, y in b}
    assert len(shared) > 0.9 * len(a)
    assert [x for x, _ in a] == [0, *[y for _, y in a][:-1]] and a[-1][1] == 500
    assert chunk_bounds([]) == [] and chunks(b"") == [(0, 0, 1)]
    assert max(y - x for x, y in chunk_bounds([5] * 1000)) <= 64


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, text string, k string, ats string")
    out = remove_repeated(docs)
    assert out.columns[:4] == docs.columns
    got = {r.doc_id: (r.text, r["__removed"]) for r in out.collect()}
    want = brute(rows)
    assert got == want and sum(n for _, n in want.values()) > 100
    assert len(xxhash.xxh3_128_digest(b"x")) == 16


def test_edges(spark):
    text = "\n".join(f"line {k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "\n\n\n\n\n\n\n\n\n"), (6, "\n\n\n\n\n\n\n\n\n"), (7, "one"), (8, "one"), (9, "z" * 100_000 + "\n" + "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id): (r.text, r["__lines"], r["__removed"]) for r in remove_repeated(docs).collect()}
    assert got[1] == (text, 40, 0)
    assert got[2][2] == got[None][2] > 30 and got[2][0] == got[None][0]
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5][2] == got[6][2] == got[7][2] == got[8][2] == got[9][2] == 0
    assert remove_repeated(docs.limit(0)).count() == 0
