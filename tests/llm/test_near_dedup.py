import random

import corpus_pipeline as P
import pytest

from glossweave.llm.near_dedup import keep_one

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def components(texts):
    left, out = set(range(len(texts))), []
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            near = {y for y in left if jaccard(texts[x], texts[y]) >= 0.8}
            left -= near
            queue += near
        out.append(group)
    return out


def corpus(seed=5):
    rng, rows = random.Random(seed), []
    for k in range(25):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 600)))
        rows.append(base)
        rows += [edited(rng, base, max(1, len(base.split()) * share // 1000)) for share in (5, 12, 18, 22, 30, 60)]
    return rows


@pytest.mark.parametrize("tile", [2_000, 3])
def test_all_pairs_of_0_8_and_no_others(spark, tile):
    texts = corpus()
    pairs = [jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    assert sum(0.8 <= x < 0.9 for x in pairs) > 30 and sum(0.5 < x < 0.8 for x in pairs) > 30
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    left = {r.doc_id for r in keep_one(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()}
    assert left == {min(group) for group in components(texts)}


def test_stage_drops_copies_that_fingerprints_do_not_link(spark):
    rng = random.Random(9)
    base = " ".join(f"w{k}" for k in range(400))
    copies = [c for c in (edited(rng, base, 6) for _ in range(20)) if 0.8 <= jaccard(base, c) < 0.95]
    assert len(copies) > 10
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([base, *copies])], SCHEMA)
    assert [r.doc_id for r in P.keep_one(spark, docs, "").collect()] == [0]


def test_edges(spark):
    rows = [(3, None, None, "s", None), (2, " \n", None, "s", None), (9, "one two", "en", "s", 1), (9, "One  two", "en", "s", 1), (None, "one two", "en", "s", 1), (None, "quite alone", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r.doc_id or 0, r.text) for r in P.keep_one(spark, docs, "").collect())) == [(0, "quite alone"), (2, " \n"), (9, "One  two")]
    assert P.keep_one(spark, docs.limit(0), "").count() == 0


def test_repeated_ids_of_different_texts_all_stay(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(50))
    rows = [(1, text("a"), "en", "s", 0), (5, text("a"), "en", "s", 0), (5, text("b"), "en", "s", 0), (5, text("c"), "en", "s", 0)]
    got = P.keep_one(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text[0]) for r in got) == [(1, "a"), (5, "b"), (5, "c")]
