import random

from glossweave.llm.line_dedup import remove_repeated


def brute(rows):
    """Each line that stands, with a neighbour, in a run of two lines that came earlier and does not share lines with it."""
    first, out = {}, {}
    for doc_id, text in rows:
        lines, drop = text.split("\n"), set()
        for k in range(len(lines) - 1):
            at = first.setdefault((lines[k], lines[k + 1]), (doc_id, k))
            if at != (doc_id, k):
                drop |= {k + 1} if at == (doc_id, k - 1) else {k, k + 1}
        out[doc_id] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def lines_of(rng, n):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_repeated_runs_go_up_to_their_edges(spark):
    rng = random.Random(4)
    shared = [lines_of(rng, n) for n in (2, 2, 3, 3, 4, 5, 7, 12)]
    rows = []
    for k in range(120):
        lines = lines_of(rng, rng.randint(0, 6))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = shared[rng.randrange(len(shared))]
        rows.append((k, "\n".join(lines)))
    rows.append((200, "\n".join(["a line again"] * 9 + lines_of(rng, 2))))
    got = {r.doc_id: (r.text, r["__removed"]) for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), pairs=True).collect()}
    want = brute(rows)
    by_chunk = {r.doc_id: r.text for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: t for k, (t, _) in got.items()} == want
    assert sum(len(by_chunk[k]) > len(want[k]) for k in want) > 20  # the chunks alone leave edges
    assert all(got[k][1] == len(text.split("\n")) - len([x for x in want[k].split("\n") if x]) for k, text in rows if text)


def test_blank_lines_between_and_single_lines(spark):
    rows = [(1, "one\n\ntwo\nthree"), (2, "x\none\n\ntwo\ny"), (3, "one\n\nz"), (4, "\nthree"), (5, "q\n\nthree")]
    got = {r.doc_id: r.text for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), pairs=True).collect()}
    assert got[1] == rows[0][1] and got[2] == "x\ny" and got[3] == "one\n\nz" and got[5] == "q\n\nthree"
