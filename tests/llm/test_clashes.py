"""Columns of the input that have the names the operators use inside."""

import pytest
from pyspark.sql import functions as F

from glossweave.llm import line_dedup, mixing, near_dedup

NAMES = ("k", "k1", "k2", "a", "b", "h1", "ats", "rest", "cut", "first", "__lines", "__removed", "__row", "__n", "__k", "__copies", "__node", "__bands", "t_doc_id", "size", "key", "tie", "weight", "a.b", "lines")


@pytest.fixture
def docs(spark):
    text = "\n".join(f"this is line {k} of the text that stands twice" for k in range(30))
    rows = [(1, text, "s"), (2, "other\n" + text, "s"), (3, None, "s"), (4, "", None), (5, "alone", "t"), (5, "alone", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


@pytest.mark.parametrize("operator", [lambda d: line_dedup.remove_repeated(d, pairs=True), mixing.mix, near_dedup.keep_one])
def test_columns_pass_unchanged(docs, operator):
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert [r[3 + k] for k in range(len(NAMES))] == [f"{n}{r.doc_id}" for n in NAMES]
        assert operator is not mixing.mix or r[1] == {1: docs.first().text}.get(r.doc_id, r[1])


def test_rows_that_differ_in_other_columns_only(spark):
    docs = spark.createDataFrame([(1, "some words here", "s", k) for k in range(9)] + [(2, "many other words " * 3, "t", 0)], "doc_id long, text string, source string, x int")
    want = sorted(map(str, mixing.mix(docs).collect()))
    assert all(sorted(map(str, mixing.mix(docs.repartition(n, "x")).collect())) == want for n in (1, 3, 7))
