"""The near-dedup stage's own method: groups by SimHash and pigeonring, confirmed on whole shingle sets, before the bands."""

import random

import corpus_pipeline as P
import numpy as np

from glossweave.llm import near_dedup
from glossweave.llm._shared import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3):
    rng, texts = random.Random(seed), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(base))
        for n in (1, 1, 2, 3, 5, 8, 20):
            words = list(base)
            for _ in range(n):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def test_groups_of_fingerprints_hold_exactly_what_is_similar(spark):
    texts = corpus()
    sets = [near_dedup.shingles(t.encode()) for t in texts]
    fps = [near_dedup.fingerprint(s) for s in sets]
    n = len(texts)
    apart = lambda a, b: ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count()
    shared = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))

    def parts(linked):
        root = list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    if root[a] < root[b] and linked(a, b):
                        root[b] = root[a]
        return root

    near = np.array([[apart(a, b) <= near_dedup.TAU for b in range(n)] for a in range(n)])
    group = parts(lambda a, b: near[a, b])
    alike = np.array([[group[a] == group[b] and shared(a, b) >= 0.8 for b in range(n)] for a in range(n)])
    want = parts(lambda a, b: alike[a, b])
    assert sum(want[k] != k for k in range(n)) > 30
    classes = spark.createDataFrame([(k, k, 0, len(s), fps[k]) for k, s in enumerate(sets)], "node long, k1 long, k2 long, n long, fp long")
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "k1 long, k2 long, text string")
    found = [(r.a, r.b) for r in near_dedup.close(classes, rows, Scratch(spark, "t")).collect()]
    assert all(alike[a, b] for a, b in found)
    assert parts(lambda a, b: (a, b) in found or (b, a) in found) == want


def test_stage_finds_close_copies_without_the_bands(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "links", lambda *a, **k: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(500)]
    one, two = list(base), list(base)
    one[70], two[300] = "changed", "other"
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate([base, one, two, [f"x{k}" for k in range(300)]])], SCHEMA)
    assert sorted(r.doc_id for r in P.keep_one(spark, docs, "").collect()) == [0, 3]
