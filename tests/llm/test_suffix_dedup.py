import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glossweave.llm.suffix_dedup import anchors, refine, remove_repeated


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if n[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "eps", "漢字", "zeta"]
    line = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    shared = [line(60) for _ in range(3)]
    texts = []
    for k in range(n):
        t = line(rng.randint(1, 80))
        if k % 2:
            s = shared[k % 3]
            a = rng.randint(0, 100)
            t = t[: rng.randint(0, len(t))] + s[a : a + rng.randint(100, 500)] + t[-40:]
        texts.append(t)
    texts += [texts[1], texts[1], texts[3][:250], texts[5].replace("alpha", "ALPHA", 1), None, "", "a" * 450, "ab" * 300, "short"]
    return texts


def test_anchors_cover_each_window():
    data = np.frombuffer("".join(map(str, range(700))).encode(), np.uint8)
    g, at, first, last = anchors(data, 200)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at <= first + 100)).all()
    shifted = anchors(np.r_[data[50:60], data], 200)
    assert set(g.tolist()) <= set(shifted[0].tolist())


def test_refine_is_exact():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 900).astype(np.uint8)
    for length in (5, 8, 13, 16, 24, 200):
        starts = np.arange(len(data) - length + 1)
        got = refine(data, starts, length)
        names = {}
        want = [names.setdefault(data[p : p + length].tobytes(), p) for p in starts]
        assert len(set(got.tolist())) == len(names)
        assert len({(a, b) for a, b in zip(got.tolist(), want)}) == len(names)


@pytest.mark.parametrize(("length", "hot"), [(200, 4000), (200, 1), (40, 4000)])
def test_against_brute_force(spark, length, hot):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: r for r in remove_repeated(docs, length, hot).collect()}
    for k, want in enumerate(brute(texts, length)):
        r = got[k]
        removed = sum(s["last"] - s.first for s in r.spans)
        assert (len(r.kept) + removed, removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want, k


def test_repeated_rows_and_empty(spark):
    t = " ".join(map(str, range(200)))
    docs = spark.createDataFrame([(1, t), (1, t), (None, None)], "doc_id long, text string")
    assert sorted(len(r.kept) for r in remove_repeated(docs).collect()) == [0, 0, 0]
    assert remove_repeated(docs.limit(0)).count() == 0
