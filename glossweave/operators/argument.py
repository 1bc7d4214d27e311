"""Argumentation over attack edges: grounded, stable and preferred acceptance, gradual ranking, defeasible rules."""

from __future__ import annotations

import time
from collections import deque
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators import digraph
from glossweave.operators.build import induced
from glossweave.operators.feedback import weak_components
from glossweave.operators.loops import cut, is_empty


def grounded(args: DataFrame, attacks: DataFrame, max_rounds: int = 100_000, until: float | None = None) -> DataFrame | None:
    """``node, label``: in (all attackers out), out (an attacker in), undec. A self-attacker is never in.

    None if a round is still to do when the monotonic clock passes ``until``.
    """
    nodes, att = cut(args.select("node").distinct()), cut(induced(attacks, args).distinct())
    ins = outs = nodes.limit(0)
    live = att
    for _ in range(max_rounds):
        decided = ins.union(outs)
        new_in = cut(nodes.join(decided, "node", "left_anti").join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if is_empty(new_in):
            break
        if until is not None and time.monotonic() > until:
            return None
        ins = cut(ins.union(new_in))
        new_out = cut(att.join(new_in.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(outs, "node", "left_anti"))
        outs = cut(outs.union(new_out))
        live = cut(live.join(new_out.withColumnRenamed("node", "src"), "src", "left_anti"))  # attacks by arguments not out
    label = ins.withColumn("label", F.lit("in")).union(outs.withColumn("label", F.lit("out")))
    return nodes.join(label, "node", "left").select("node", F.coalesce("label", F.lit("undec")).alias("label"))


def derived_defeats(attacks: DataFrame, supports: DataFrame, max_pairs: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Attacks closed under support on either side: a attacks b and b supports c, or a supports b and b attacks c, make a attack c."""
    sup = cut(supports.select("src", "dst").distinct())
    every = new = cut(attacks.select("src", "dst").distinct())
    for _ in range(max_rounds):
        n = new.withColumnRenamed("dst", "m")
        after = n.join(sup.withColumnRenamed("src", "m"), "m").select("src", "dst")
        before = sup.withColumnRenamed("dst", "m").join(new.withColumnRenamed("src", "m"), "m").select("src", "dst")
        new = cut(after.union(before).distinct().join(every, ["src", "dst"], "left_anti"))
        if is_empty(new):
            return every
        every = cut(every.union(new))
        if max_pairs is not None and every.count() > max_pairs:
            raise RuntimeError(f"more than {max_pairs} derived attacks")
    raise RuntimeError("derived attacks did not settle")


def stable_sets(g: digraph.Graph, budget: int = 2_000_000, most: int | None = None, forced_in: frozenset[str] = frozenset(), forced_out: frozenset[str] = frozenset()) -> tuple[list[frozenset[str]], bool]:
    """Stable extensions of one graph, and whether the search was complete within ``budget`` branches.

    Labels spread by unit propagation (an argument whose attackers are all out is
    in, whatever is attacked from in is out, a self-attacker is out, and an out
    argument with one attacker left needs it); then the undecided argument with
    most attacks is tried both ways.
    """
    into: dict[str, set[str]] = {v: set() for v in g}
    for a, out in g.items():
        for b in out:
            into[b].add(a)

    def spread(label: dict[str, bool], todo: deque) -> bool:
        while todo:
            v, value = todo.popleft()
            if v in label:
                if label[v] != value:
                    return False
                continue
            label[v] = value
            if value:
                if v in g[v]:
                    return False
                todo.extend((w, False) for w in (*g[v], *into[v]))
            for w in (v, *g[v]):
                if label.get(w) is True:
                    continue
                open_ = [a for a in into[w] if label.get(a) is not False]
                if label.get(w) is False:
                    if not any(label.get(a) for a in open_):
                        rest = [a for a in open_ if a not in label and a not in g[a]]
                        if not rest:
                            return False
                        if len(rest) == 1:
                            todo.append((rest[0], True))
                elif not open_:
                    todo.append((w, True))
        return True

    first = deque([*((v, False) for v in g if v in g[v]), *((v, True) for v in g if not into[v]), *((v, True) for v in forced_in), *((v, False) for v in forced_out)])
    found: list[frozenset[str]] = []
    work: list[tuple[dict[str, bool], deque]] = [({}, first)]
    steps = 0
    while work:
        label, todo = work.pop()
        steps += 1
        if steps > budget:
            return found, False
        if not spread(label, todo):
            continue
        rest = [v for v in g if v not in label]
        if not rest:
            ext = frozenset(v for v, x in label.items() if x)
            if all(v in ext or into[v] & ext for v in g):
                found.append(ext)
                if most is not None and len(found) >= most:
                    return found, True
            continue
        v = max(rest, key=lambda v: (len(g[v]) + len(into[v]), v))
        work.append((dict(label), deque([(v, False)])))
        work.append((label, deque([(v, True)])))
    return sorted(set(found), key=sorted), True


def preferred_sets(g: digraph.Graph) -> list[frozenset[str]]:
    """Maximal admissible sets, by subsets: small graphs only."""
    names = sorted(g)
    into = {v: {a for a in g if v in g[a]} for v in g}
    found: list[frozenset[str]] = []
    for k in range(len(names), -1, -1):
        for some in map(frozenset, combinations(names, k)):
            if any(some <= f for f in found) or any(g[a] & some for a in some):
                continue
            if all(any(c in some for c in into[b]) for a in some for b in into[a]):
                found.append(some)
    return found


def enforce_skeptical(g: digraph.Graph, node: str, max_cost: int = 2) -> list[tuple[str, str]] | None:
    """The fewest attacks to add so that every stable extension, of which there is one, holds ``node``; None beyond ``max_cost``."""
    names = sorted(g)
    free = [(a, b) for a in names for b in names if b not in g[a]]
    for cost in range(max_cost + 1):
        for more in combinations(free, cost):
            h = {v: set(out) for v, out in g.items()}
            for a, b in more:
                h[a].add(b)
            found, _ = stable_sets(h)
            if found and all(node in e for e in found):
                return list(more)
    return None


def _by_part(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """Arguments with the attacks they make, dealt by connected component: ``part, node, targets``."""
    att = induced(attacks, args).distinct()
    parts = weak_components(att)
    out = att.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return args.select("node").distinct().join(parts, "node", "left").join(out, "node", "left").select(F.coalesce("part", "node").alias("part"), "node", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def stable_parts(args: DataFrame, attacks: DataFrame, budget: int = 200_000, keep: int = 1) -> DataFrame:
    """One row a connected component: ``part, size, n_extensions, complete, witness, in_all, in_some``. Extensions multiply across components.

    A component that is not complete within the budget says so and its count is a lower bound: nothing is guessed.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = digraph.graph_of(pdf.node, ((a, b) for a, t in zip(pdf.node, pdf.targets) for b in t))
        found, complete = stable_sets(g, budget)
        every = sorted(frozenset.intersection(*found)) if found else []
        some = sorted(frozenset().union(*found))
        return pd.DataFrame([(pdf.part.iloc[0], len(g), len(found), complete, sorted(found[0]) if found else None, every, some)], columns=["part", "size", "n_extensions", "complete", "witness", "in_all", "in_some"])

    return _by_part(args, attacks).groupBy("part").applyInPandas(run, "part string, size long, n_extensions long, complete boolean, witness array<string>, in_all array<string>, in_some array<string>")


def stable_summary(parts: DataFrame) -> dict:
    """exists (True, False or None for unknown), exact count as an integer of any size, and what it is made of."""
    small = parts.groupBy("n_extensions", "complete").agg(F.count("*").alias("k")).collect()  # one row a distinct count
    exists: bool | None = True
    count: int | None = 1
    for r in small:
        if r.complete and r.n_extensions == 0:
            exists = False
        elif not r.complete:
            exists = exists if exists is False else (True if r.n_extensions else None) if exists else exists
            count = None
        if count is not None:
            count *= int(r.n_extensions) ** int(r.k)
    return {"exists": exists, "count": 0 if exists is False else count, "choices": {int(r.n_extensions): int(r.k) for r in small if r.n_extensions != 1}}


def accepts(args: DataFrame, attacks: DataFrame, semantics: str = "stable") -> DataFrame:
    """``node, credulous, skeptical``; both false where there is no extension. Null where the search was cut short."""
    if semantics == "grounded":
        return grounded(args, attacks).select("node", (F.col("label") == "in").alias("credulous"), (F.col("label") == "in").alias("skeptical"))
    if semantics != "stable":
        raise ValueError(f"unknown semantics {semantics!r}")
    parts = cut(stable_parts(args, attacks))
    none = parts.agg(F.coalesce(F.max(((F.col("n_extensions") == 0) & F.col("complete")).cast("int")), F.lit(0)).alias("none"), F.coalesce(F.min(F.col("complete").cast("int")), F.lit(1)).alias("sure"))
    some = parts.select(F.explode("in_some").alias("node"), F.lit(True).alias("c"))
    every = parts.select(F.explode("in_all").alias("node"), F.lit(True).alias("s"))
    out = args.select("node").distinct().join(some, "node", "left").join(every, "node", "left").crossJoin(F.broadcast(none))
    value = lambda c: F.when(F.col("none") == 1, False).when(F.col("sure") == 0, F.lit(None)).otherwise(F.coalesce(c, F.lit(False)))
    return out.select("node", value(F.col("c")).alias("credulous"), value(F.col("s")).alias("skeptical"))


def stable_core(args: DataFrame, attacks: DataFrame, loops: bool = True, budget: int = 50_000) -> DataFrame:
    """``part, core``: of each component without a stable extension a minimal set of arguments that must each be settled (in, or attacked from in) and cannot all be."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = digraph.graph_of(pdf.node, ((a, b) for a, t in zip(pdf.node, pdf.targets) for b in t if loops or a != b))
        found, complete = stable_sets(g, budget, most=1)
        if found or not complete:
            return pd.DataFrame([], columns=["part", "core"])
        core = sorted(g)
        for v in sorted(g):
            rest = [w for w in core if w != v]
            if not _settles(g, rest, budget):
                core = rest
        return pd.DataFrame([(pdf.part.iloc[0], core)], columns=["part", "core"])

    return _by_part(args, attacks).groupBy("part").applyInPandas(run, "part string, core array<string>")


def _settles(g: digraph.Graph, asked: list[str], budget: int) -> bool:
    """Is there a conflict-free set in which each of ``asked`` is in or attacked? Others may be left open."""
    into = {v: {a for a in g if v in g[a]} for v in g}
    work, steps = [frozenset()], 0
    seen = set(work)
    while work:
        ins = work.pop()
        steps += 1
        if steps > budget:
            return True
        open_ = [v for v in asked if v not in ins and not into[v] & ins]
        if not open_:
            return True
        v = min(open_, key=lambda v: (len(into[v]), v))
        for w in sorted({v} | into[v]):
            if w not in g[w] and not (g[w] & ins) and not any(w in g[x] for x in ins):
                nxt = ins | {w}
                if nxt not in seen:
                    seen.add(nxt)
                    work.append(nxt)
    return False


def wl_signature(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``node, colour``: Weisfeiler-Lehman refinement by sorted colours before and after, from degrees and loops. Not complete: no verdict may rest on it."""
    e = cut(induced(edges, nodes).distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("l"))
    colour = cut(nodes.select("node").distinct().join(loops, "node", "left").select("node", F.coalesce("l", F.lit(0)).cast("string").alias("colour")))
    for _ in range(rounds):
        side = lambda a, b, n: e.join(colour.withColumnRenamed("node", b), b).groupBy(F.col(a).alias("node")).agg(F.array_join(F.array_sort(F.collect_list("colour")), ",").alias(n))
        colour = cut(colour.join(side("dst", "src", "x"), "node", "left").join(side("src", "dst", "y"), "node", "left").select("node", F.md5(F.concat_ws("|", "colour", F.coalesce("x", F.lit("")), F.coalesce("y", F.lit("")))).alias("colour")))
    return colour


#: score from the sum over attackers of their scores.
FORMULAS = {
    "h_categoriser": lambda s: 1.0 / (1.0 + F.least(F.lit(1.0), s)),
    "categoriser": lambda s: 1.0 / (1.0 + s),
    "counting": lambda s: 1.0 / (1.0 + 0.98 * s),
    "burden": lambda s: 1.0 + s,
}


def gradual(args: DataFrame, attacks: DataFrame, formula: str, rounds: int = 30, tol: float = 0.0, every: int = 5) -> tuple[DataFrame, dict]:
    """``node, score`` after so many rounds (or once no score moves by ``tol``); burden sums inverse burdens and lower is better."""
    e, n = cut(induced(attacks, args).distinct()), cut(args.select("node").distinct())
    score = n.withColumn("score", F.lit(1.0))
    old, given = score, (1.0 / F.col("score") if formula == "burden" else F.col("score"))
    for done in range(1, rounds + 1):
        got = e.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(given).alias("s"))
        score = n.join(got, "node", "left").select("node", FORMULAS[formula](F.coalesce("s", F.lit(0.0))).alias("score"))
        if done % every == 0:
            score = cut(score)
            if tol:
                most = score.join(old.withColumnRenamed("score", "o"), "node").agg(F.max(F.abs(F.col("score") - F.col("o"))).alias("c")).first()["c"]
                if most is None or most < tol:
                    return score, {"converged": True, "iterations": done}
                old = score
    return score, {"converged": False, "iterations": rounds}


def clique_stats(cliques: DataFrame) -> DataFrame:
    """One row: rival cliques, nodes in them, and log10 of the stable extensions of their disjoint union, sum log10 k."""
    k = F.size("members")
    return cliques.agg(F.count("*").alias("cliques"), F.coalesce(F.sum(k), F.lit(0)).alias("nodes"), F.round(F.coalesce(F.sum(F.log10(k)), F.lit(0.0)), 6).alias("log10_extensions"))


def horn(rules: DataFrame, facts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``atom``: the least fixpoint of ``rules(rule_id, head, body ARRAY)``; a rule with an empty body holds at once."""
    known = cut(facts.select("atom").distinct())
    heads = cut(rules.select("rule_id", "head"))
    body = cut(rules.select("rule_id", F.explode("body").alias("atom")).distinct())
    for _ in range(max_rounds):
        unmet = body.join(known, "atom", "left_anti").select("rule_id").distinct()
        new = cut(heads.join(unmet, "rule_id", "left_anti").select(F.col("head").alias("atom")).distinct().join(known, "atom", "left_anti"))
        if is_empty(new):
            return known
        known = cut(known.union(new))
    raise RuntimeError("rules did not settle")


def defeasible(rules: DataFrame, facts: DataFrame, superior: DataFrame, conflicts: DataFrame, atoms: DataFrame) -> DataFrame:
    """``atom, answer``: YES (holds, no applicable superior rule for a conflicting atom), NO (a conflicting atom is YES), else UNDECIDED.

    ``superior(winner, loser)`` are rule ids, ``conflicts(atom, other)`` is read both ways.
    """
    both = conflicts.select("atom", "other").union(conflicts.select("other", "atom")).distinct()
    holds = cut(horn(rules.select("rule_id", "head", "body"), facts))
    unmet = rules.select("rule_id", F.explode("body").alias("atom")).join(holds, "atom", "left_anti").select("rule_id").distinct()
    live = cut(rules.select("rule_id", "head").join(unmet, "rule_id", "left_anti"))
    rivals = live.select(F.col("rule_id").alias("loser"), F.col("head").alias("atom")).join(both, "atom").join(live.select(F.col("rule_id").alias("winner"), F.col("head").alias("other")), "other")
    beaten = rivals.join(superior, ["winner", "loser"], "left_semi").select(F.col("loser").alias("rule_id")).distinct()
    standing = cut(rules.join(live.select("rule_id"), "rule_id", "left_semi").join(beaten, "rule_id", "left_anti"))
    left = cut(horn(standing.select("rule_id", "head", "body"), facts))
    sure = facts.select("atom").distinct()
    split = left.join(both, "atom").join(left.select(F.col("atom").alias("other")), "other", "left_semi").select("atom").distinct().join(sure, "atom", "left_anti")
    yes = cut(left.join(split, "atom", "left_anti"))
    no = both.join(yes.select(F.col("atom").alias("other")), "other", "left_semi").select("atom").distinct()
    return atoms.select("atom").distinct().join(yes.withColumn("y", F.lit(True)), "atom", "left").join(no.withColumn("n", F.lit(True)), "atom", "left").select("atom", F.when(F.col("y"), "YES").when(F.col("n"), "NO").otherwise("UNDECIDED").alias("answer"))


def fingerprint(nodes: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted hashes of the names, by their first byte so that no task holds them all; and how many there are."""
    parts = nodes.select("node").distinct().select(F.sha2("node", 256).alias("h")).groupBy(F.left("h", F.lit(2)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"), F.count("*").alias("k"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("fingerprint"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
