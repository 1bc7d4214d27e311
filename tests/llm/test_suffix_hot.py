"""Buckets of a common passage: few rows a context, the same result as brute force."""

import random

import pytest

from glossweave.llm import suffix_dedup
from glossweave.llm._shared import Scratch
from glossweave.llm.suffix_dedup import remove_repeated

from .test_suffix_dedup import brute


@pytest.mark.parametrize("holders", [1 << 18, 0])
def test_a_common_passage_needs_few_windows(spark, monkeypatch, holders):
    monkeypatch.setattr(suffix_dedup, "HOLDERS", holders, raising=False)
    rng = random.Random(6)
    words = lambda n: " ".join(f"u{rng.randrange(10**5)}" for _ in range(n))
    passage = words(90)
    texts = [words(rng.randint(30, 60)) + passage[: rng.choice((260, 420, 600))] + words(rng.randint(30, 60)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[2][7:], "z" * 700, "xy" * 400, passage[:300] * 3]
    rows, table = {}, Scratch.table

    def counted(self, df, name="t"):
        out = table(self, df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeated(docs, hot=20).collect()}
    for k, want in enumerate(brute(texts, 200)):
        spans = got[k].spans
        assert (sum(s["last"] - s.first for s in spans), len(spans)) == want[1:3], k
    # one by one, each passage had over a hundred
    assert 0 < rows["windows"] < 40 * len(texts)
