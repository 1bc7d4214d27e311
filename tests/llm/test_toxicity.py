import random

from glossweave.llm.toxicity import Model, fit, held_out, score, segments, train
from pyspark.sql import functions as F


def brute_segments(scores):
    """Take the best segment, then the best of what lies left and right of it (shortest, leftmost on ties)."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2]):
                best = (a, b + 1, total)
    if not best:
        return []
    a, b, s = best
    right = [(x + b, y + b, t) for x, y, t in brute_segments(scores[b:])]
    return brute_segments(scores[:a]) + [best] + right


def test_segments_are_maximal():
    assert segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 5]) + rng.random() / 1e3 for _ in range(rng.randint(0, 14))]
        got, want = segments(scores), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want], scores
    assert segments([]) == [] and segments([-1.0]) == []


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["zounds", "drat", "fiend", "knave"]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "clash") for a, b, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, t, 1) for a, _, t in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    model = train(docs, labels)
    got = score(docs, model).withColumn("out", held_out(F.col("doc_id"))).where("out").collect()
    truth = {a: t for a, _, t in rows}
    assert len(got) > 200
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in got) / len(got) > 0.95
    assert all(r.n_passages == len(r.passages) for r in got)


def test_edges(spark):
    model = fit([(t, y) for _, t, y in corpus(400)])
    rows = [(1, None), (2, ""), (3, " \n"), (None, "knave"), (4, "knave drat fiend zounds"), (4, "knave drat fiend zounds"), (5, "wa " * 60_000)]
    got = sorted(score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect(), key=str)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].score > 0.7 > by[1].score == by[2].score == by[3].score and by[5].n_passages == 0
    assert score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert fit([]).score("knave") < 0.1 and fit([("a b", 0)]).evidence("a") == (0.0, [], 1)
    assert Model().score(None) < 0.1
