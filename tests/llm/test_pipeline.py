import hashlib
import random
from collections import Counter

import corpus_pipeline as P
import tiktoken

from glossweave.llm.bpe import public


def rows():
    base = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(40)]
    out = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    out += [(100 + k, base[k].replace("w", "w", 1) + " tail", "en", "s0", 0) for k in range(10)]
    return out + [(200, base[0], "en", None, 0), (200, base[0], "en", None, 0), (300, None, None, "s1", None), (301, "", "de", "s1", 0), (None, "nobody knows this one here", None, None, None)]


def write(spark, folder, documents, labels):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def kept_by_force(before):
    """Of each group linked by five-word shingles at 0.8 and more, the row that comes first by id (null last), then text."""
    left, out = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")), []
    while left:
        out.append(left[0])
        queue, left = [left[0]], left[1:]
        while queue:
            x = queue.pop()
            near = [r for r in left if alike(x.text, r.text)]
            left = [r for r in left if r not in near]
            queue += near
    return out


def stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, str(folder))
        if name != "BPE":
            assert docs.columns == list(P.COLUMNS)
        docs.write.parquet(f"{folder}/{name.replace(' ', '')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '')}")
        seen[name] = (before.collect(), docs.collect())
    return seen


def test_stages_against_brute_force(spark, tmp_path):
    write(spark, tmp_path, rows(), [(k, 1, 0) for k in range(40)])
    seen = stages(spark, tmp_path)
    assert len(seen["toxicity"][1]) == len(rows())  # nothing toxic is labelled, so nothing goes
    assert sorted(r.text or "" for r in seen["line dedup"][1]) == sorted(r[1] or "" for r in rows())
    before, after = seen["SimHash near-dedup"]
    assert any(r.doc_id is None for r in after)
    assert sorted(map(str, after)) == sorted(map(str, kept_by_force(before)))
    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and after
    assert max(Counter(map(str, after)).values()) <= 3
    enc, (before, after) = tiktoken.Encoding("own", pat_str=public().pattern, mergeable_ranks=public().ranks(), special_tokens={}), seen["BPE"]
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in after) == want


def test_toxic_documents_passages_and_near_copies(spark, tmp_path):
    """Planted cases of each stage, beside a very long text, ties, repeated rows and a blank one."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(4000)}" + rng.choice("abc") for _ in range(n))
    bad = ["grumble" + c for c in "abcdefghij"]
    passage = "\n".join(words(20) for _ in range(4))
    clean = {k: "\n".join(words(rng.randint(20, 60)) for _ in range(5)) for k in range(150)}
    toxic = {200 + k: f"{words(30)} {' '.join(rng.choice(bad) for _ in range(15))} {words(30)}" for k in range(150)}
    shared = {400 + k: f"{words(30)}\n{passage}\n{words(30)}" for k in range(8)}
    near = {}
    for k in range(10):
        text = words(300).split()
        near[500 + 2 * k] = " ".join(text)
        text[rng.randrange(300)] = "changed"
        near[501 + 2 * k] = " ".join(text)
    odd = {600: " \n ", 601: words(60_000)}
    docs = [(k, t, "en", f"s{k % 4}", len(t)) for part in (clean, toxic, shared, near, odd) for k, t in part.items()]
    docs += [docs[0], docs[0]]
    write(spark, tmp_path, docs, [(k, 1, int(200 <= k < 400)) for k, *_ in docs[:300] if k % 2 == 0])
    seen = stages(spark, tmp_path)
    left = {r.doc_id for r in seen["toxicity"][1]}
    assert not left & set(toxic) and left == {k for k, *_ in docs} - set(toxic)
    texts = {r.doc_id: r.text for r in seen["line dedup"][1]}
    assert passage in texts[400] and all(passage not in texts[k] and texts[k] == "\n".join(x for x in shared[k].split("\n") if x not in passage.split("\n")) for k in range(401, 408))
    assert all(texts[k] == t for part in (clean, near, odd) for k, t in part.items())
    kept = Counter(r.doc_id for r in seen["SimHash near-dedup"][1])
    assert all(kept[k] == 1 for k in clean) and all(kept[k] == (k % 2 == 0) for k in near) and kept[600] == kept[601] == 1


def test_extra_columns_do_not_matter(spark, tmp_path):
    write(spark, tmp_path, rows(), [(k, 1, 0) for k in range(40)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = docs.selectExpr("*", "'x' AS k", "1 AS k1", "2 AS __node", "3 AS size", "4 AS rest")
    for _, stage in P.STAGES:
        want = sorted(map(str, stage(spark, docs, str(tmp_path)).collect()))
        assert sorted(map(str, stage(spark, more, str(tmp_path)).collect())) == want


def test_run_and_empty(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert P.run(spark, str(tmp_path)).count() == 0
