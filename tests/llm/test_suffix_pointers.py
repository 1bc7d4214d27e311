import numpy as np
import pytest

from glossweave.llm.suffix_dedup import anchors, pointers, refine, remove_repeated, words


def test_pointers_order_suffixes_of_several_texts():
    rng = np.random.default_rng(4)
    for _ in range(100):
        sizes = rng.integers(1, 60, rng.integers(1, 6))
        data = rng.integers(0, rng.integers(1, 4), sizes.sum()).astype(np.uint8)
        ends = np.repeat(np.cumsum(sizes), sizes)
        suffixes = [data[p:e].tobytes() for p, e in enumerate(ends)]
        order = np.argsort(pointers(words(data), sizes, 100), kind="stable")
        assert [suffixes[p] for p in order] == sorted(suffixes)


def test_refine_of_several_texts():
    rng = np.random.default_rng(5)
    for length in (1, 3, 8, 9, 16, 27):
        sizes = rng.integers(1, 70, 6)
        data = rng.integers(0, 2, sizes.sum()).astype(np.uint8)
        starts = np.concatenate([np.arange(e - s, max(e - s, e - length + 1)) for s, e in zip(sizes, np.cumsum(sizes))])
        got, want = refine(data, starts, length, sizes).tolist(), [data[p : p + length].tobytes() for p in starts]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_long_texts_are_cut_into_bounded_parts():
    one = np.full(3_000_000, 97, np.uint8)
    g, _, first, last = anchors(one, 200, 50)
    assert len(set(g.tolist())) == 1 and len(g) < len(one) / 140
    assert first[0] == 0 and last[-1] == len(one) - 200 and (first[1:] == last[:-1] + 1).all() and (last - first).max() <= 150


@pytest.mark.parametrize("hot", [4000, 5])
def test_a_passage_in_many_documents_and_a_long_text(spark, hot):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(260)
    rows = [(k, noise(rng.integers(0, 150)) + chr(33 + k) + passage + chr(33 + k) + noise(rng.integers(0, 150))) for k in range(60)]  # its neighbours differ
    rows += [(100, "z" * 1_500_000), (101, noise(400_000)), (102, passage[:199])]
    got = {r.doc_id: r for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    for k, text in rows[:60]:
        at = text.index(passage)
        assert [(s.first, s["last"]) for s in got[k].spans] == [(at, at + 260)] and got[k].kept.decode() == text[:at] + text[at + 260 :]
    assert got[100].kept == b"" and got[101].spans == [] and got[102].spans == []


def test_strings_too_long(spark):
    with pytest.raises(ValueError, match="65,536"):
        remove_repeated(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=70_000)


def test_periodic_texts_repeat_within_themselves(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = [(k, noise(40) + noise(k) * 60 + noise(30)) for k in (1, 2, 5, 7, 12, 31, 99)] + [(200, noise(150) * 2 + noise(100)), (201, "ab" * 101), (202, "c" * 200), (203, "d" * 201)]
    got = {r.doc_id: [(s.first, s["last"]) for s in r.spans] for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        seen = {}
        for p in range(len(text) - 199):
            seen.setdefault(text[p : p + 200], []).append(p)
        gone = sorted({x for at in seen.values() if len(at) > 1 for p in at for x in range(p, p + 200)})
        want = [] if not gone else [(x[0], x[-1] + 1) for x in np.split(gone, np.flatnonzero(np.diff(gone) != 1) + 1)]
        assert got[k] == want, k
