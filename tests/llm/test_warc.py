import duckdb
import pytest
from pyspark.sql import functions as F

from glossweave.llm.warc import OP7_SQL, canonical_url, merge_headers, op7_revisits, resolve_revisits

SCHEMA = "record_id long, url string, date long, status int, headers array<struct<name: string, value: string>>, payload string, digest string, canonical string"


def brute(rows):
    full = [r for r in rows if r[3] == 200 and r[5] is not None and r[1] is not None and r[2] is not None]
    out = []
    for r in rows:
        if r[3] != 304:
            continue
        before = [f for f in full if r[1] is not None and r[2] is not None and f[1] == r[1] and (f[2], f[0]) < (r[2], r[0])]
        if not before:
            out.append((r[0], None, "missing", None))
            continue
        s = max(before, key=lambda f: (f[2], f[0]))
        old, new = ({k.lower(): v for k, v in (x[4] or [])} for x in (s, r))
        verdict = "unchecked"
        if "etag" in old and "etag" in new:
            verdict = "etag" if old["etag"].removeprefix("W/") == new["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in old and "last-modified" in new:
            verdict = "last-modified" if old["last-modified"] == new["last-modified"] else "mismatch"
        elif s[6] and r[6]:
            verdict = "digest" if s[6] == r[6] else "mismatch"
        out.append((r[0], s[0], verdict, None if verdict == "mismatch" else s[5]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot):
    rows = []
    for k in range(200):
        tags = [("ETag", f"{'W/' if k % 4 else ''}v{k // 20}")] if k % 3 else [("Last-Modified", f"d{k // 30}")] if k % 2 else []
        rows.append((k, None if k == 77 else f"u{k % 3}", None if k == 78 else k // 2, 304 if k % 2 else 200, None if k % 11 == 0 else tags, None if k % 2 or k % 17 == 0 else f"body{k}", f"x{k // 40}" if k % 5 else None, "clash"))
    rows.append(rows[51])
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA), hot).collect()
    assert sorted([(r.record_id, r.resolved_id, r.verdict, r.payload) for r in got], key=str) == brute(rows)
    assert resolve_revisits(spark.createDataFrame([], SCHEMA), hot).count() == 0


def test_canonical_and_headers(spark):
    urls = {"HTTP://www.A.com:80/x/?b=2&ref=q&a=1#f": "a.com/x?a=1&b=2", "https://m.a.com": "a.com", "a.com/p//": "a.com/p", "": "", "http://u:p@h/?utm_source=x": "h"}
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls | {None: None}
    h = "array<struct<name: string, value: string>>"
    df = spark.createDataFrame([([("Content-Length", "5"), ("X", "1"), ("Vary", "a")], [("content-length", "0"), ("VARY", "b"), ("Expires", "z")])], f"a {h}, b {h}")
    got = df.select(merge_headers(F.col("a"), F.col("b")).alias("m")).first().m
    assert [tuple(x) for x in got] == [("Content-Length", "5"), ("Expires", "z"), ("VARY", "b"), ("X", "1")]


def test_query_agrees_with_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op7_revisits(spark, d).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert got == sorted(con.sql(OP7_SQL).fetchall(), key=str)


def test_repeated_responses_and_shared_ids(spark):
    full = (2, "u", 1, 200, [("ETag", "x")], "body", None, None)
    rows = [full, full, full, (3, "u", 5, 304, [("etag", "x")], None, None, None), (2, "v", 0, 200, [], "an earlier one", None, None)]
    got = [(r.record_id, r.resolved_id, r.verdict, r.payload) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(3, 2, "etag", "an earlier one")]
    got = [r.payload for r in resolve_revisits(spark.createDataFrame(rows[:4], SCHEMA)).collect()]
    assert got == ["body"]
