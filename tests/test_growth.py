"""What failed only on larger tables, on inputs as small as show it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.plans import fixtures
from glossweave.operators import build, cluster, digraph, feedback, numbered, rank, structure


def test_squared_distances_past_32_bits(spark):
    n = 70_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("node"), F.col("id").alias("x"), (-F.col("id")).alias("y"))
    assert rank.spearman_d2(rows, "x", "y").first() == (n, pytest.approx(-1.0))
    assert rank.spearman_d2(rows.where("x < 0"), "x", "y").first() == (0, None)


def test_attacks_of_a_large_clique_are_counted_without_pairs(spark):
    senses = spark.range(200_003).select(F.concat(F.lit("s"), F.col("id")).alias("node"), F.when(F.col("id") < 3, "small").otherwise("large").alias("lemma"), F.lit("n").alias("pos"))
    got = {r.key: (r["size"], r.attacks) for r in build.rival_counts(senses).collect()}
    assert got == {"small": (3, 6), "large": (200_000, 200_000 * 199_999)}
    few = senses.where("id < 40")
    pairs, cliques = build.rival_attacks(few)
    want = {r.key: len(r.members) for r in cliques.collect()}
    got = {r.key: (r["size"], r.attacks) for r in build.rival_counts(few).collect()}
    assert {k: n for k, (n, _) in got.items()} == want and pairs.count() == sum(a for _, a in got.values())


def _random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("seed", range(60))
def test_solvers_on_numbers_choose_as_those_on_sets(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(numbered, "PLAIN", rng.choice([0, 3, 20_000]))
    monkeypatch.setattr(numbered, "CHUNK", rng.choice([5, 4_000_000]))
    n = rng.choice([5, 14, 40, 60])
    pairs = _random_edges(seed, n, int(n * rng.choice([1.2, 1.8, 2.5, 5])))
    g = digraph.graph_of(range(n), pairs)
    new = lambda: numbered.Graph(n, np.array([a for a, _ in pairs], np.int32), np.array([b for _, b in pairs], np.int32))
    assert dict(enumerate(new().components(np.arange(n)).tolist())) == {v: p[0] for p in digraph.components(g) for v in p}
    for limit in (1, 3, 12):
        h = new()
        assert sorted(numbered.exact_small_greedy(h, h.cyclic(np.arange(n)), limit)) == sorted(digraph._exact_small_greedy_sets(g, limit)["seed"])
    for method, k in (("bounded-scc", 1), ("bounded-scc", 3), ("exact-cutting", 6)):
        h, want = new(), digraph.METHODS[method](g, k)
        got, left = numbered.METHODS[method][0](h, h.cyclic(np.arange(n)), k)
        assert (sorted(got), len(left)) == (sorted(want["seed"]), want["residual"])


def test_stages_go_on_until_no_cycle_is_left(spark):
    """In one task as in rounds, also past 200 of them; and a graph of the size that took rounds before stays in one task."""
    pairs = [(f"v{a:03d}", f"v{b:03d}") for a, b in _random_edges(5, 40, 130)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    (one, m), (more, k) = feedback.staged(df, hubs=1, passes=1, small=3), feedback.staged(df, hubs=1, passes=1, small=3, one_task_edges=0)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, k.collect())) and sorted(map(tuple, one.collect())) == sorted(map(tuple, more.collect()))
    full = np.array([(a, b) for a in range(260) for b in range(260)], np.int32)
    seed, metrics = numbered.staged(numbered.Graph(260, full[:, 0], full[:, 1]), 1, 1, 3, None)
    assert len(seed) == 260 and metrics[-1][3] == 0 and len(metrics) > 400


def test_solved_components_keep_their_labels(spark):
    pairs = [(f"v{a:02d}", f"v{b:02d}") for a, b in _random_edges(3, 30, 60)]
    g = digraph.graph_of({x for p in pairs for x in p}, pairs)
    df = spark.createDataFrame(pairs, "src string, dst string")
    for method in numbered.METHODS:
        seed, per = feedback.solve(df, structure.scc(df), method, 4)
        want = {p[0]: (len(p), digraph.METHODS[method](digraph.graph_of(p, pairs), 4)) for p in digraph.cyclic_components(g)}
        assert {r.scc: (r["size"], r.seeds, r.exact, r.residual) for r in per.collect()} == {k: (n, len(w["seed"]), w["exact"], w["residual"]) for k, (n, w) in want.items()}
        assert {r.node for r in seed.collect()} == {v for _, w in want.values() for v in w["seed"]}


def _senses(spark, seed, n=60):
    rng = random.Random(seed)
    words = [f"qu{c}" for c in "abcdefghijkl"] + ["lamb", "kid"]
    rows = [(f"s{k}", rng.choice(words[:6]), rng.choice(["n", "v", None] if seed == 2 else ["n", "v"]), k % 5, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "node string, lemma string, pos string, rank int, definition string")


def _resolved(rows, fallback, own_lemma):
    """Every candidate of every gloss, by the definition."""
    rows = [r for r in rows if r[4]]
    lemmas, out, counters = {r[1] for r in rows}, set(), {}
    signature = {r[0]: set(r[4].split()) | ({r[1]} if own_lemma else set()) for r in rows}
    for node, _, pos, _, text in rows:
        for c in text.split():
            if c not in lemmas:
                continue
            some = [r for r in rows if r[1] == c and r[0] != node]
            same = [r for r in some if pos is not None and r[2] == pos]
            level, some = ("same_pos_", same) if same else ("any_pos_", some)
            how, won = "self_only", None
            if len(some) == 1:
                how, won = level + "unique", some[0][0]
            elif some:
                how = "ambiguous"
                shared = sorted((-len((signature[node] & signature[r[0]]) - {c}), r[0]) for r in some)
                if shared[0][0] < 0 and shared[0][0] < shared[1][0]:
                    how, won = level + "overlap", shared[0][1]
                elif fallback:
                    how, won = level + "fallback", min((r[3], r[0]) for r in some)[1]
            counters[how] = counters.get(how, 0) + 1
            if won:
                out.add((won, node))
    return out, counters


@pytest.mark.parametrize(("seed", "fallback", "own_lemma"), [(1, False, True), (2, True, True), (3, True, False)])
def test_senses_are_told_apart_by_blocks_as_one_by_one(spark, monkeypatch, seed, fallback, own_lemma):
    monkeypatch.setattr(build, "BLOCK", 25)
    rows, df = _senses(spark, seed)
    g = build.sense_graph(df, fallback, own_lemma)
    want, counters = _resolved(rows, fallback, own_lemma)
    assert {tuple(r) for r in g.edges.collect()} == want
    assert {r.resolution: r.n for r in g.counters.collect()} == counters
    plan = g.edges._jdf.queryExecution().toString()
    assert "row_number" not in plan  # no window over pairs of senses, which filled the disks


def test_gate_scores_are_those_of_the_gate(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SENSES", 3)
    rows, df = _senses(spark, 4)
    s = df.withColumnRenamed("node", "sense_id")
    pairs = spark.createDataFrame([("qua", "qub", ["r"]), ("quc", "quf", ["r"]), ("qud", "none", ["q"])], "a string, b string, rules array<string>")
    want = {(r.a, r.b): (r.rules, r.best_score, r.accepted) for r in cluster.gloss_gate(pairs, s, 0.4).collect()}
    assert {(r.a, r.b): (r.rules, r.best_score, r.accepted) for r in cluster.gate_scores(pairs, s, 0.4).collect()} == want


@pytest.mark.parametrize("seed", range(30))
def test_reach_is_counted_in_blocks_of_bits(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(numbered, "BLOCK_BYTES", rng.choice([1, 700, 64_000_000]))
    n = rng.choice([5, 40, 150])
    pairs = _random_edges(seed, n, int(n * rng.choice([0.8, 1.2, 2])))
    got = numbered.reach_counts(numbered.Graph(n, np.array([a for a, _ in pairs], np.int32), np.array([b for _, b in pairs], np.int32)))
    g = digraph.graph_of(range(n), pairs)
    for v in range(n):
        seen, todo = set(), list(g[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += g[w]
        assert got[v] == len(seen)


def test_pairs_that_would_not_fit_are_counted(spark):
    """A ring of 60,000 nodes has 3.6 billion pairs."""
    ring = spark.range(60_000).select(F.col("id").cast("string").alias("src"), ((F.col("id") + 1) % 60_000).cast("string").alias("dst"))
    assert structure.reach_counts(ring).groupBy("n").count().collect() == [(60_000, 60_000)]


def test_a_lemma_needs_no_tokens_of_the_whole_text(spark, tmp_path):
    rows = [(1, "en", "  (The lamb's) kid", "a", 3), (2, "de", "12 !", "a", 4), (3, "de", None, "a", 0), (4, "fr", "Don't", "b", 5)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    e = fixtures.entries(spark, str(tmp_path))
    assert sorted(map(tuple, e.select("ord", "lemma", "form", "gloss").collect())) == [(1, "the", "The", ["lambs", "kid"]), (4, "dont", "Don't", [])]
    assert "regexp_extract_all" not in e.select("lemma", "n_chars")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [0, 1])
def test_swaps_on_numbers_are_those_on_names(spark, seed):
    """As the same chain over a set of pairs of names, which held every edge as strings."""
    pairs = [(f"v{a:02d}", f"v{b:02d}") for a, b in _random_edges(seed, 30, 120)]
    df = rank.edge_swaps(spark.createDataFrame(pairs, "src string, dst string"), 500, seed)
    assert "InPandas" not in df._jdf.queryExecution().toString()
    got = {tuple(r) for r in df.collect()}
    rng, e = random.Random(seed), sorted({p for p in pairs if p[0] != p[1]})
    have = set(e)
    for _ in range(500):
        i, j = rng.randrange(len(e)), rng.randrange(len(e))
        (a, b), (c, d) = e[i], e[j]
        if len({a, b, c, d}) == 4 and (a, d) not in have and (c, b) not in have:
            have = have - {(a, b), (c, d)} | {(a, d), (c, b)}
            e[i], e[j] = (a, d), (c, b)
    assert got == set(e) != set(pairs)
