"""Probes of argumentation frameworks: what a graph gives as a framework, acceptance within limits of time and steps, bipolar ranking."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators import argument, digraph, rank, structure
from glossweave.operators.build import induced, two_kinds
from glossweave.operators.loops import cut


def frameworks(edges: DataFrame, attacks: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``(arguments, edges with kind)``: edges as attacks (``dung``), as supports without attacks (``support``), and with attacks of their own (``both``)."""
    e = edges.select("src", "dst").distinct()
    none = e.limit(0)
    out = {"dung": (structure.all_nodes(e), two_kinds(none, e)), "support": (structure.all_nodes(e), two_kinds(e, none))}
    if attacks is not None:
        out["both"] = (structure.all_nodes(e.union(attacks.select("src", "dst"))).distinct(), two_kinds(e, attacks.select("src", "dst").distinct()))
    return out


def kernel_framework(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = cut(structure.kernel(edges))
    return k, induced(edges, k)


def largest_scc_framework(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the components with the most nodes the one with the smallest name."""
    labels = cut(structure.scc(edges))
    top = labels.groupBy("scc").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "scc").limit(1)
    nodes = cut(labels.join(F.broadcast(top), "scc", "left_semi").select("node"))
    return nodes, induced(edges, nodes)


def grounded_within(args: DataFrame, attacks: DataFrame, seconds: float) -> tuple[DataFrame | None, dict]:
    """The grounded labels, or none once the rounds take longer than that; and how it went. Time is looked at between rounds."""
    began = time.monotonic()
    labels = argument.grounded(args, attacks, until=began + seconds)
    return labels, {"finished": labels is not None, "seconds": time.monotonic() - began}


def probe(args: DataFrame, attacks: DataFrame, budget: int = 200_000) -> DataFrame:
    """One row: arguments, attacks, grounded in and out, whether a stable extension exists (null: unknown), the digest of the arguments."""
    att = cut(induced(attacks, args).distinct())
    g = argument.grounded(args, att).agg(F.count("*").alias("arguments"), F.sum((F.col("label") == "in").cast("long")).alias("grounded_in"), F.sum((F.col("label") == "out").cast("long")).alias("grounded_out"))
    parts = argument.stable_parts(args, att, budget)
    s = parts.agg(F.max(((F.col("n_extensions") == 0) & F.col("complete")).cast("int")).alias("no"), F.min((F.col("n_extensions") > 0).cast("int")).alias("yes"))
    stable = F.when(F.col("no") == 1, False).when(F.col("yes") == 1, True)
    return g.crossJoin(att.agg(F.count("*").alias("attacks"))).crossJoin(s).crossJoin(argument.fingerprint(args).select("fingerprint")).select("arguments", "attacks", "grounded_in", "grounded_out", stable.alias("stable"), "fingerprint")


def component_probe(edges: DataFrame, budget: int = 50_000) -> DataFrame:
    """``scc, size, kind, status`` of the kernel's components.

    Kinds: ``component``, ``self-loop`` (one node that attacks itself: no stable
    extension) and ``single``. Status: ``sat``, ``unsat``, or ``skipped`` where the
    search took more steps than ``budget``. Each component is searched by itself.
    """
    nodes, inside = kernel_framework(edges)
    inside = cut(inside)
    labels = cut(structure.scc(inside).join(nodes, "node", "right").select("node", F.coalesce("scc", "node").alias("scc")))
    inner = structure.scc_edges(inside, labels).where("s = d").groupBy(F.col("src").alias("node")).agg(F.collect_set("dst").alias("targets"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = digraph.graph_of(pdf.node, ((a, b) for a, t in zip(pdf.node, pdf.targets) if t is not None for b in t))
        found, complete = argument.stable_sets(g, budget, most=1)
        loop = len(g) == 1 and bool(g[next(iter(g))])
        kind = "component" if len(g) > 1 else "self-loop" if loop else "single"
        return pd.DataFrame([(pdf.scc.iloc[0], len(g), kind, "sat" if found else "unsat" if complete else "skipped")], columns=["scc", "size", "kind", "status"])

    return labels.join(inner, "node", "left").groupBy("scc").applyInPandas(run, "scc string, size long, kind string, status string")


def preferred_parts(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """``part, size, n_extensions, in_all``: preferred extensions of each connected component, by subsets; for components of few arguments."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = digraph.graph_of(pdf.node, ((a, b) for a, t in zip(pdf.node, pdf.targets) for b in t))
        found = argument.preferred_sets(g)
        return pd.DataFrame([(pdf.part.iloc[0], len(g), len(found), sorted(frozenset.intersection(*found)))], columns=["part", "size", "n_extensions", "in_all"])

    return argument._by_part(args, attacks).groupBy("part").applyInPandas(run, "part string, size long, n_extensions long, in_all array<string>")


def enforced(args: DataFrame, attacks: DataFrame, node: str, max_cost: int = 1) -> DataFrame:
    """``part, cost``: the fewest attacks to add within its component so that each stable extension, of which there is one, holds ``node``; -1 beyond ``max_cost``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if node not in set(pdf.node):
            return pd.DataFrame([], columns=["part", "cost"])
        g = digraph.graph_of(pdf.node, ((a, b) for a, t in zip(pdf.node, pdf.targets) for b in t))
        more = argument.enforce_skeptical(g, node, max_cost)
        return pd.DataFrame([(pdf.part.iloc[0], -1 if more is None else len(more))], columns=["part", "cost"])

    return argument._by_part(args, attacks).groupBy("part").applyInPandas(run, "part string, cost long")


def bipolar_ranking(supports: DataFrame, attacks: DataFrame, formula: str = "h_categoriser", rounds: int = 30, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Scores with supports read as attacks, and with both kinds of edges so read, ``(node, support, both, attackers)``; and how they compare.

    The second table has one row a pair: ``pair, n, rho`` (Spearman) of either score
    with the negated number of attackers, and of the two scores. Scores are rounded
    to ``digits`` first, so that ties are ties.
    """
    one, two = supports.select("src", "dst").distinct(), supports.select("src", "dst").union(attacks.select("src", "dst")).distinct()
    nodes = cut(structure.all_nodes(two))
    score = lambda e, n: argument.gradual(nodes, e, formula, rounds)[0].select("node", F.round("score", digits).alias(n))
    into = two.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("attackers"))
    table = cut(score(one, "support").join(score(two, "both"), "node").join(into, "node", "left").fillna(0, ["attackers"]))
    t = table.withColumn("fewer", -F.col("attackers"))
    pairs = (("support-attackers", "support", "fewer"), ("both-attackers", "both", "fewer"), ("support-both", "support", "both"))
    rows = [rank.spearman(t, a, b).select(F.lit(name).alias("pair"), "n", "rho") for name, a, b in pairs]
    return table, rows[0].union(rows[1]).union(rows[2])
