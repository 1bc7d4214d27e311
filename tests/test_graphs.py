"""Toy graphs with known answers, and random ones against closures and enumeration."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from glossweave.operators import argument, build, digraph, feedback, rank, structure


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def names(df, column="node"):
    return {r[column] for r in df.collect()}


@pytest.mark.parametrize(("text", "want"), [("a>b b>c c>c", "abc"), ("s>x x>x x>d y>d y>e", "sx"), ("a>b a>c b>c", "")])
def test_kernel(spark, text, want):
    assert names(structure.kernel(edges(spark, text))) == set(want)


def random_graph(seed, n=14, m=26):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)})


def closure(pairs):
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_structure_against_closure(spark, seed):
    pairs = random_graph(seed)
    df = spark.createDataFrame(pairs, "src string, dst string")
    reach, nodes = closure(pairs), {x for p in pairs for x in p}
    want = {v: min([v] + [w for w in nodes if (v, w) in reach and (w, v) in reach]) for v in nodes}
    assert {r.node: r.scc for r in structure.scc(df).collect()} == want
    assert {r.node: r.scc for r in structure.scc(df, one_task_edges=0).collect()} == want
    assert names(structure.kernel(df)) == {a for a, b in reach if (b, b) in reach}
    assert {(r.src, r.dst) for r in structure.reachable(df).collect()} == reach
    triples = {tuple(sorted((a, b, c))) for a, b in pairs for x, c in pairs if x == b and (c, a) in pairs and len({a, b, c}) == 3}
    assert {(r.a, r.b, r.c) for r in structure.three_cycles(df).collect()} == triples


@pytest.mark.parametrize("seed", range(6))
def test_seeds_leave_no_cycle(seed):
    pairs = random_graph(seed, 11, 24)
    g = digraph.graph_of({x for p in pairs for x in p}, pairs)
    best = len(digraph.smallest_set(g))
    found = digraph.exact_small_greedy(g)
    assert digraph.acyclic(digraph.without(g, found["seed"])) and found["exact"] and len(found["seed"]) == best
    cut = digraph.exact_cutting(g)
    assert digraph.acyclic(digraph.without(g, cut["seed"])) and len(cut["seed"]) == best
    some = digraph.bounded(g)
    assert not some["exact"] and len(digraph.cyclic_components(digraph.without(g, some["seed"]))) == some["residual"]


def test_named_solver_cases(spark):
    ring = " ".join(f"n{k}>n{(k + 1) % 13}" for k in range(13))
    for text, method, exact, size in [("a>b b>c c>a", "exact-cutting", True, 1), (ring, "exact-small-greedy", False, 1), ("a>b b>a c>d d>c", "bounded-scc", False, 2)]:
        e = edges(spark, text)
        seed, per = feedback.solve(e, structure.scc(e), method)
        assert seed.count() == size
        assert all(r.exact == exact and r.residual == 0 and (r.lower_bound is None) == (not exact) for r in per.collect())
    with pytest.raises(ValueError):
        feedback.solve(e, structure.scc(e), "guess")
    with pytest.raises(ValueError):
        structure.core_satellite(e, structure.scc(e), "guess")


def test_analyze_and_staged(spark):
    e = edges(spark, "a>b b>a a>c c>d d>c d>e")
    a = structure.analyze(e, "exact-small-greedy")
    m = {r.node: r for r in a["membership"].collect()}
    assert {v for v, r in m.items() if r.is_kernel} == set("abcd") and {v for v, r in m.items() if r.is_core} == set("ab")
    assert sum(r.is_seed for r in m.values()) == 2 and all(m[v].layer is not None for v in "abcd")
    seeds, metrics = feedback.staged(e, hubs=1, passes=1)
    gone = names(seeds)
    assert digraph.acyclic(digraph.without(digraph.graph_of("abcde", [tuple(x.split(">")) for x in "a>b b>a a>c c>d d>c d>e".split()]), gone)) and metrics.count() >= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_size(spark, seed):
    pairs = random_graph(seed, 7, 12)
    best = max(k for k in range(len(pairs) + 1) if any(len({a for a, _ in c}) == k == len({b for _, b in c}) for c in combinations(pairs, k)))
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = feedback.max_matching(df).collect()
    assert len(got) == best == len({r.tail for r in got}) == len({r.head for r in got}) and {(r.tail, r.head) for r in got} <= set(pairs)
    free = names(feedback.drivers(df, feedback.max_matching(df), structure.all_nodes(df)))
    assert {v for v in names(structure.all_nodes(df)) if v not in {b for _, b in pairs}} <= free


def test_layers(spark):
    e = edges(spark, "s>a a>b s>b b>c x>y y>x y>c q>q q>z")
    got = {r.node: r.layer for r in structure.layers(e, structure.all_nodes(e), spark.createDataFrame([("s",), ("x",)], "node string")).collect()}
    assert got == {"s": 0, "x": 0, "a": 1, "b": 2, "y": 1, "c": 3}


def test_ranks(spark):
    e = edges(spark, "a>b a>d b>c c>a")
    scores, info = rank.pagerank(e, reverse=True, tol=1e-4)
    assert abs(sum(r.score for r in scores.collect()) - 1) < 1e-9 and info["converged"]
    v, info = rank.by_policy(e, "largest-scc")
    assert abs(info["eigenvalue"] - 1) < 1e-9 and {round(r.score, 6) for r in v.collect()} == {round(1 / 3, 6)}
    ring = edges(spark, " ".join(f"n{k}>n{(k + s) % 8}" for k in range(8) for s in (1, 3)))
    swapped = rank.edge_swaps(ring, 200, seed=3)
    assert {tuple(r) for r in structure.degrees(swapped).collect()} == {tuple(r) for r in structure.degrees(ring).collect()}
    assert {tuple(r) for r in swapped.collect()} != {tuple(r) for r in ring.collect()}
    pairs = spark.createDataFrame([(1.0, 4.0), (1.0, 3.0), (2.0, 3.0), (5.0, 1.0)], "x double, y double")
    assert abs(rank.spearman(pairs, "x", "y").first().rho + 5 / 6) < 1e-9
    assert rank.spearman(pairs.limit(2), "x", "y").first().rho is None
    with pytest.raises(ValueError):
        rank.by_policy(e, "guess")


def brute_stable(g):
    v = sorted(g)
    return {frozenset(s) for k in range(len(v) + 1) for s in combinations(v, k) if not any(g[a] & set(s) for a in s) and all(any(w in g[a] for a in s) for w in set(v) - set(s))}


@pytest.mark.parametrize("seed", range(25))
def test_stable_sets(seed):
    pairs = random_graph(seed, 7, 11)
    g = digraph.graph_of({x for p in pairs for x in p}, pairs)
    found, complete = argument.stable_sets(g)
    assert complete and set(found) == brute_stable(g) and len(found) == len(set(found))


def test_acceptance(spark):
    def labels(text):
        e = edges(spark, text)
        return {r.node: r.label for r in argument.grounded(structure.all_nodes(e), e).collect()}

    assert labels("a>b b>c") == {"a": "in", "b": "out", "c": "in"}
    assert set(labels("x>y y>x").values()) == {"undec"}
    for text, exists, count in [("c>c", False, 0), ("x>y y>x", True, 2), ("a>b b>a b>x x>y y>z z>x", True, 1), ("a>b b>a x>y y>z z>x", False, 0), ("a>b b>a c>d d>c e>f f>e g>h h>g", True, 16)]:
        e = edges(spark, text)
        s = argument.stable_summary(argument.stable_parts(structure.all_nodes(e), e))
        assert (s["exists"], s["count"]) == (exists, count), text
    e = edges(spark, "a>b b>a x>y y>z z>x")
    assert {(r.credulous, r.skeptical) for r in argument.accepts(structure.all_nodes(e), e).collect()} == {(False, False)}
    core = {frozenset(r.core) for r in argument.stable_core(structure.all_nodes(e), e).collect()}
    assert core == {frozenset("xyz")}
    g = digraph.graph_of("ab", [("a", "b"), ("b", "a")])
    assert set(argument.preferred_sets(g)) == {frozenset("a"), frozenset("b")} and len(argument.enforce_skeptical(g, "a")) == 1


def test_derived_and_rules(spark):
    att, sup = edges(spark, "s1>s2 s2>s1 x>a"), edges(spark, "r1>s1 a>b b>c")
    got = {(r.src, r.dst) for r in argument.derived_defeats(att, sup).collect()}
    assert {("r1", "s2"), ("x", "b"), ("x", "c")} <= got
    rules = spark.createDataFrame([("r1", "b", ["a"]), ("r2", "c", ["b", "a"]), ("r3", "d", ["d"]), ("r4", "nc", ["a"])], "rule_id string, head string, body array<string>")
    facts = spark.createDataFrame([("a",)], "atom string")
    assert names(argument.horn(rules, facts), "atom") == {"a", "b", "c", "nc"}
    sup2, con = spark.createDataFrame([("r2", "r4")], "winner string, loser string"), spark.createDataFrame([("c", "nc")], "atom string, other string")
    atoms = spark.createDataFrame([(x,) for x in ("a", "b", "c", "nc", "d")], "atom string")
    assert {r.atom: r.answer for r in argument.defeasible(rules, facts, sup2, con, atoms).collect()} == {"a": "YES", "b": "YES", "c": "YES", "nc": "NO", "d": "UNDECIDED"}


def test_rivals_and_projection(spark):
    s = spark.createDataFrame([("s1", "bank", "n"), ("s2", "bank", "n"), ("s3", "bank", "v"), ("s4", "cat", "n")], "node string, lemma string, pos string")
    pairs, cliques = build.rival_attacks(s)
    assert pairs.count() == 6 and [r.members for r in cliques.collect()] == [["s1", "s2", "s3"]]
    assert build.rival_attacks(s, per_pos=True)[0].count() == 2
    stats = argument.clique_stats(cliques).first()
    assert stats.cliques == 1 and abs(stats.log10_extensions - 0.477121) < 1e-6
    ic = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B")], "node string, ic string")
    assert {(r.src, r.dst) for r in build.project(pairs, ic).collect()} == {("A", "B"), ("B", "A")}
    assert structure.degree_stats(structure.degrees(pairs)).first().nodes == 3
    assert structure.all_nodes(pairs).where(F.col("node") == "s1").count() == 1


def test_kernel_and_layers_in_one_task_and_in_rounds(spark):
    rng = random.Random(17)
    for k in range(6):
        names = [f"n{j}" for j in range(30)]
        rows = {(rng.choice(names), rng.choice(names)) for _ in range(12 + 8 * k)}
        edges = spark.createDataFrame(sorted(rows), "src string, dst string")
        both = [sorted(r.node for r in structure.kernel(edges, one_task_edges=n).collect()) for n in (0, 10**6)]
        assert both[0] == both[1]
        alive = set(names)
        while (kept := {a for a, b in rows if a in alive and b in alive}) != alive:
            alive = kept
        assert both[0] == sorted(alive)
        seed = spark.createDataFrame([(v,) for v in rng.sample(names, 8)] + [("outside",)], "node string")
        nodes = structure.all_nodes(edges)
        one, many = (sorted(map(tuple, structure.layers(edges, nodes, seed, one_task_edges=n).collect())) for n in (10**6, 0))
        assert one == many and len(one) > 8
    empty = spark.createDataFrame([], "src string, dst string")
    assert structure.kernel(empty).count() == structure.kernel(empty, one_task_edges=-1).count() == 0
    assert structure.layers(empty, structure.all_nodes(empty), empty.select("src").toDF("node")).count() == 0
