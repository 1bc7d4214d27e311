import pytest
from pyspark.sql import functions as F

from glossweave.llm._shared import Scratch
from glossweave.llm.mixing import mix, plan, targets


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(cap * sizes[s] for s in fixed)
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] for s in fixed} | share
        fixed |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 5, None: 1000}, {"x": 0, "y": 7}, {"x": 1}, {f"s{k}": 3**k for k in range(9)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def rows(n=3000):
    out = [(k, "word " * (k % 37), ["big", "mid", None][0 if k % 3 else 1 + k % 2]) for k in range(n)]
    return out + [(1, "same row here", "mid")] * 3 + [(None, "no id", "mid"), (2, None, "mid"), (3, "", None), (4, "long " * 5000, "mid")]


def test_plan(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = plan(docs, Scratch(spark, "t"), bin_rows=64).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.size
        s[1] += r.size * r.copies
    for size, taken, source_size, target in by.values():
        assert size == source_size
        assert abs(taken - target) <= 5000 or taken == 0
    assert abs(sum(s[3] for s in by.values()) - sum(s[0] for s in by.values())) < 1e-3
    again = plan(docs.repartition(5), Scratch(spark, "t"), bin_rows=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_and_empty(spark):
    docs = spark.createDataFrame(rows(300), "doc_id long, text string, source string")
    want = sum(r.copies for r in plan(docs, Scratch(spark, "t")).collect())
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == want
    assert mix(docs.limit(0)).count() == 0
