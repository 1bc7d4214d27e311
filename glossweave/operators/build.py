"""Definition graphs: from entries and their glosses to nodes and edges.

An edge goes from a defining word to the word whose gloss holds it. Lexicon
tables: ``entry(ord, lemma, pos, definition, ...)`` with ``ord`` the order that
"first wins" rules refer to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from glossweave.functions import text as T
from glossweave.operators.loops import cut

#: Tables of up to so many lemmas go to every executor.
BROADCAST_LEMMAS = 1_000_000


@dataclass
class LexicalGraph:
    """Nodes (``node`` and what is known of it), edges (``src, dst``) and counters."""

    nodes: DataFrame
    edges: DataFrame
    counters: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


@F.pandas_udf(ArrayType(IntegerType()))
def _orbit(widths: pd.Series) -> pd.Series:
    """Positions that a scan visits which jumps by the width found at each."""

    def one(jump) -> list[int]:
        out, i = [], 0
        while i < len(jump):
            out.append(i)
            i += int(jump[i])
        return out

    return widths.map(one)


def longest_matches(texts: DataFrame, lemmas: DataFrame, key: str, text: str = "text", max_n: int = 3) -> DataFrame:
    """``key, occ, candidate``: longest n-grams of ``lemmas(lemma)`` in the text, left to right.

    Stopwords go first. At each place the widest run of capitalised words (2 or
    more) is skipped; else the longest n-gram that is a lemma is taken; else one
    word is passed. ``occ`` counts a text's emissions from 0.
    """
    pairs = F.filter(F.transform(T.raw_tokens(F.col(text)), lambda r: F.struct(r.alias("raw"), T.plain_token(r).alias("tok"))), lambda p: ~T.is_stopword(p["tok"]))
    words = texts.select(F.col(key).alias("key"), pairs.alias("w"))
    at = words.select("key", F.col("w"), F.posexplode("w").alias("i", "p")).select("key", "i", *[F.slice("w", F.col("i") + 1, n).alias(f"s{n}") for n in range(1, max_n + 1)])
    for n in range(1, max_n + 1):
        gram = F.when(F.size(f"s{n}") == n, F.array_join(F.transform(f"s{n}", lambda p: p["tok"]), "_"))
        title = (F.size(f"s{n}") == n) & F.forall(f"s{n}", lambda p: p["raw"].rlike("^[A-Z]"))
        at = at.withColumn(f"g{n}", gram).withColumn(f"t{n}", title)
    keep = ["key", "i", *[f"{x}{n}" for n in range(1, max_n + 1) for x in "gt"]]
    at = at.select(*keep)
    known = cut(lemmas.select("lemma").distinct())
    known = F.broadcast(known) if known.count() <= BROADCAST_LEMMAS else known  # so that the words, by far the larger side, stay where they are
    for n in range(1, max_n + 1):
        at = at.join(known.select(F.col("lemma").alias(f"g{n}"), F.lit(True).alias(f"m{n}")), f"g{n}", "left")
    skip = F.coalesce(*[F.when(F.col(f"t{n}"), n) for n in range(max_n, 1, -1)])
    hit = F.coalesce(*[F.when(F.col(f"m{n}"), n) for n in range(max_n, 0, -1)])
    found = F.when(skip.isNull(), F.coalesce(*[F.when(F.col(f"m{n}"), F.col(f"g{n}")) for n in range(max_n, 0, -1)]))
    rows = at.select("key", "i", F.coalesce(skip, hit, F.lit(1)).alias("jump"), found.alias("c"))
    whole = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "jump", "c"))).alias("p"))
    visited = whole.select("key", "p", _orbit(F.transform("p", lambda x: x["jump"])).alias("v"))
    taken = F.filter(F.transform("v", lambda i: F.get("p", i)["c"]), lambda c: c.isNotNull())
    return visited.select(F.col("key").alias(key), F.posexplode(taken).alias("occ", "candidate"))


def lemma_graph(entries: DataFrame) -> LexicalGraph:
    """Nodes are lemmas; every distinct definition of a lemma is scanned; loops stay."""
    defs = entries.where("definition is not null and definition <> ''").select("lemma", "definition").distinct()
    defs = defs.withColumn("k", F.xxhash64("lemma", "definition"))
    hits = longest_matches(defs, entries, "k", "definition").join(defs.select("k", "lemma"), "k")
    per = entries.groupBy(F.col("lemma").alias("node")).agg(F.count("*").alias("senses"), F.countDistinct(F.when(F.col("definition") != "", F.col("definition"))).alias("definitions"))
    return LexicalGraph(per, hits.select(F.col("candidate").alias("src"), F.col("lemma").alias("dst")).distinct())


def resolve_pos(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``src`` and ``resolution``: the node of the same lemma and pos, else the lemma's only node, else none.

    ``hits(node, pos, candidate)``, ``nodes(node, lemma, pos)``.
    """
    own = nodes.select(F.col("node").alias("same"), F.col("lemma").alias("candidate"), "pos")
    alone = nodes.groupBy(F.col("lemma").alias("candidate")).agg(F.count("*").alias("n"), F.min("node").alias("only"))
    out = hits.join(own, ["candidate", "pos"], "left").join(alone, "candidate", "left")
    how = F.when(F.col("same").isNotNull(), "same_pos").when(F.col("n") == 1, "unambiguous_pos").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("resolution", how).withColumn("src", F.when(how == "same_pos", F.col("same")).when(how == "unambiguous_pos", F.col("only")))


def _pos_graph(defs: DataFrame) -> LexicalGraph:
    nodes = defs.withColumn("node", T.node_key(F.col("lemma"), F.col("pos"))).withColumn("label", T.truncate_text(F.col("definition")))
    hits = longest_matches(nodes, nodes, "node", "definition").join(nodes.select("node", "pos"), "node")
    found = resolve_pos(hits, nodes.select("node", "lemma", "pos"))
    edges = found.where("src is not null").select("src", F.col("node").alias("dst")).distinct()
    return LexicalGraph(nodes, edges, found.groupBy("resolution").agg(F.count("*").alias("n")))


def paper_graph(entries: DataFrame) -> LexicalGraph:
    """Nodes are lemma and pos; the first entry with a definition stands for its key."""
    first = F.min_by(F.struct("definition", "ord"), "ord")
    defs = entries.where("definition is not null and definition <> ''").groupBy("lemma", "pos").agg(first.alias("f")).select("lemma", "pos", "f.definition", "f.ord")
    return _pos_graph(defs)


def merged_graph(entries: DataFrame) -> LexicalGraph:
    """As ``paper_graph``, but all definitions of a key are joined with `` ; `` in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "definition"))), lambda x: x["definition"]), " ; ")
    defs = entries.where("definition is not null and definition <> ''").groupBy("lemma", "pos").agg(joined.alias("definition"), F.min("ord").alias("ord"))
    return _pos_graph(defs)


def resolve_overlap(choices: DataFrame) -> DataFrame:
    """Of ``choices(target, occ, node, context, signature, blocked)`` the node whose signature shares most with the context.

    The candidate's own tokens are blocked on both sides; a win needs an overlap
    above zero and strictly above the next.
    """
    overlap = F.size(F.array_intersect(F.array_except("context", "blocked"), F.array_except("signature", "blocked")))
    order = W.partitionBy("target", "occ").orderBy(F.desc("overlap"), "node")
    top = choices.withColumn("overlap", overlap).withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    best = top.groupBy("target", "occ").agg(F.max("overlap").alias("overlap"), F.min_by("node", "rn").alias("node"), F.max(F.when(F.col("rn") == 2, F.col("overlap"))).alias("next"))
    return best.where("overlap > 0 and overlap > coalesce(next, -1)").select("target", "occ", "node", "overlap")


#: Senses whose signatures a task holds at once (some 2 KB each), and tasks to have at least.
BLOCK, TASKS = 100_000, 12


def sense_graph(senses: DataFrame, fallback: bool = False, own_lemma: bool = True) -> LexicalGraph:
    """Nodes are senses ``(node, lemma, pos, rank, definition)``.

    A candidate's senses exclude the target. One with the target's pos is taken;
    several are told apart by overlap; without any the same goes over all pos, and
    if none is left the candidate was the target itself. With ``fallback`` a tie
    takes the lowest (rank, node). ``own_lemma``: a signature holds its lemma.

    Each block of targets meets each block of lemmas once, in a task that counts what
    all their words (as 64-bit hashes) share; pairs of senses are never rows.
    """
    s = senses.where("definition is not null and definition <> ''")
    own = T.content_tokens(F.col("definition"))
    sig = F.array_distinct(F.concat(own, F.array("lemma") if own_lemma else F.array().cast("array<string>")))
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    told = cut(s.select("node", "lemma", "pos", F.col("rank").cast("long").alias("rank"), hashed(sig).alias("context")))
    lemma_blocks = -(-told.count() // BLOCK) or 1
    target_blocks = max(-(-TASKS // lemma_blocks), lemma_blocks)
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    # a candidate resolves alike wherever it occurs in a gloss: once a target, weighted by its occurrences
    hits = longest_matches(s, told, "node", "definition").groupBy(F.col("node").alias("target"), "candidate").agg(F.count("*").alias("k"))
    hits = hits.groupBy("target", block("candidate", lemma_blocks).alias("j")).agg(F.collect_list(F.struct("candidate", "k")).alias("h"))
    context = told.select(F.col("node").alias("target"), "pos", "context")
    asked = hits.join(context, "target").select(block("target", target_blocks).alias("i"), "j", "target", "pos", "context", F.col("h.candidate").alias("candidates"), F.col("h.k").alias("ks"))
    told = told.withColumn("signature", F.array_except("context", hashed(F.split("lemma", "_")))).withColumn("j", block("lemma", lemma_blocks)).drop("context")
    told = told.select(F.explode(F.sequence(F.lit(0), F.lit(target_blocks - 1))).alias("i"), "j", "node", "lemma", "pos", "rank", "signature")

    def run(left, right):
        import pyarrow as pa

        from glossweave.operators import overlap

        if len(left) and len(right):
            return overlap.resolve(left, right, fallback)
        return pa.table({"target": pa.array([], pa.string()), "node": pa.array([], pa.string()), "resolution": pa.array([], pa.string()), "k": pa.array([], pa.int64())})

    met = asked.groupBy("i", "j").cogroup(told.groupBy("i", "j")).applyInArrow(run, "target string, node string, resolution string, k long")
    counters = met.groupBy("resolution").agg(F.sum("k").alias("n"))
    return LexicalGraph(s, met.where("node is not null").select(F.col("node").alias("src"), F.col("target").alias("dst")).distinct(), counters)


def synset_graph(synsets: DataFrame, fallback: bool = False) -> LexicalGraph:
    """Nodes are synsets ``(node, lemma, pos, rank, definition)``, a row a member lemma; a signature is the definition's words alone."""
    return sense_graph(synsets, fallback, own_lemma=False)


def rival_attacks(senses: DataFrame, per_pos: bool = False) -> tuple[DataFrame, DataFrame]:
    """Symmetric attacks ``(src, dst)`` among the senses of a lemma (or lemma and pos), and its cliques of two and more."""
    key = T.node_key(F.col("lemma"), F.col("pos")) if per_pos else F.col("lemma")
    s = senses.select("node", key.alias("key"))
    cliques = s.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("members")).where("size(members) > 1")
    pairs = s.select("key", F.col("node").alias("src")).join(s.select("key", F.col("node").alias("dst")), "key").where("src <> dst").select("src", "dst").distinct()
    return pairs, cliques


def rival_counts(senses: DataFrame, per_pos: bool = False) -> DataFrame:
    """``key, size, attacks`` of the cliques of two and more. In a clique each sense attacks all others, so no pair is made."""
    key = T.node_key(F.col("lemma"), F.col("pos")) if per_pos else F.col("lemma")
    size = senses.select(key.alias("key"), "node").distinct().groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return size.select("key", "size", (F.col("size") * (F.col("size") - 1)).alias("attacks"))


def project(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between classes ``(node, ic)``; those within one are dropped."""
    a, b = classes.select(F.col("node").alias("src"), F.col("ic").alias("s")), classes.select(F.col("node").alias("dst"), F.col("ic").alias("d"))
    return edges.join(a, "src").join(b, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def strip_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def two_kinds(supports: DataFrame, attacks: DataFrame) -> DataFrame:
    return supports.select("src", "dst", F.lit("support").alias("kind")).union(attacks.select("src", "dst", F.lit("attack").alias("kind")))
