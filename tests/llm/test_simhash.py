import random

import pytest
import xxhash

from glossweave.llm._shared import Scratch
from glossweave.llm.simhash import fingerprint, links, near_duplicates


def brute_fingerprint(text, width=4):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A É b c d e f\x0bg", "x " * 40_000, "uno dos tres cuatro cinco seis"])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def components(fps, tau=4):
    left, out = set(fps), []
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= tau}
            left -= near
            queue += near
        out.append(frozenset(group))
    return set(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("tile", [20_000, 50])
def test_links_find_every_component(spark, tile):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            fps.add(signed(x))
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = links(nodes, Scratch(spark, "t"), tile=tile).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)
    up = {x: {x} for x in fps}
    for a, b in found:
        both = up[a] | up[b]
        for x in both:
            up[x] = both
    assert {frozenset(x) for x in up.values()} == components(fps)


def test_near_duplicates_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base, "y"), (3, base, "y"), (9, None, None), (8, "", None), (None, " ", None), (7, "one two", None), (None, "only here and nowhere else at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (-1, 8), (7, 7), (-1, -1)])
    assert near_duplicates(docs.limit(0)).count() == 0
