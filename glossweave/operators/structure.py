"""Structure of a definition graph ``edges(src, dst)``: kernel, components, core, layers, cycles, degrees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.operators import digraph, numbered
from glossweave.operators.build import induced, transpose
from glossweave.operators.loops import cut, is_empty

#: Up to so many edges, components, kernels and layers are found in one task, on numbers (at most some 30 bytes an edge); beyond, by rounds over the cluster.
ONE_TASK_EDGES = 100_000_000
#: Tables of up to so many nodes go to every executor.
BROADCAST_NODES = 2_000_000


def all_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def number(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``node, id`` from 0 in the order of the names, at rest, and how many."""
    ids = cut(nodes.select("node", (F.row_number().over(W.orderBy("node")) - 1).cast("int").alias("id")))
    n = ids.count()
    return (F.broadcast(ids) if n <= BROADCAST_NODES else ids), n


def by_number(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges between numbered nodes."""
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def gathered(batches, seen=lambda t: None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends out of batches, 8 bytes an edge. ``seen`` is shown each batch."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for t in batches:
        seen(t)
        parts.append((t.column(0).to_numpy().astype(np.int32), t.column(1).to_numpy().astype(np.int32)))
    n, at = sum(len(a) for a, _ in parts), 0
    src, dst = np.empty(n, np.int32), np.empty(n, np.int32)
    parts.reverse()
    while parts:
        a, b = parts.pop()
        src[at : at + len(a)], dst[at : at + len(a)] = a, b
        at += len(a)
    return src, dst


def in_one_task(pairs: DataFrame, solve, schema: str) -> DataFrame:
    """What ``solve(src, dst)`` gives, as columns, of all numbered edges."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        src, dst = gathered(batches)
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in solve(src, dst)], names=names)

    return pairs.repartition(1).mapInArrow(run, schema)


def kernel(edges: DataFrame, max_rounds: int = 10_000, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node``: those that survive taking away, again and again, all without an edge to a survivor. A loop survives.

    Each node counts its edges to survivors; a round counts down the predecessors
    of what has just gone, so every edge is used once. Up to ``one_task_edges`` edges
    the rounds are those of one task.
    """
    e = cut(edges.select("src", "dst").distinct())
    if e.count() <= one_task_edges:
        ids, n = number(all_nodes(e))
        left = in_one_task(by_number(e, ids), lambda src, dst: [np.flatnonzero(digraph.surviving(n, src, dst)).astype(np.int32)], "id int")
        return left.join(ids, "id").select("node")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("left"))
    state = cut(all_nodes(e).join(out, "node", "left").fillna(0, ["left"]))
    for _ in range(max_rounds):
        gone = state.where("left = 0").select(F.col("node").alias("dst"))
        if is_empty(gone):
            return state.select("node")
        fewer = e.join(gone, "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
        state = cut(state.where("left > 0").join(fewer, "node", "left").select("node", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left")))
    raise RuntimeError("the kernel did not settle")


def _one_task(edges: DataFrame) -> DataFrame:
    ids, n = number(all_nodes(edges))

    def solve(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        every = np.arange(n, dtype=np.int32)
        return [every, numbered.Graph(n, src, dst).components(every)]

    found = in_one_task(by_number(edges, ids), solve, "id int, low int")
    return found.join(ids, "id").join(ids.select(F.col("id").alias("low"), F.col("node").alias("scc")), "low").select("node", "scc")


def _spread(labels: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """The smallest label that reaches each node along the edges (node, label) -> (node, label)."""
    labels, before = cut(labels), None
    for _ in range(max_rounds):
        moved = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        labels = cut(labels.union(moved).groupBy("node").agg(F.min("label").alias("label")))
        now = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == before:
            return labels
        before = now
    raise RuntimeError("labels did not settle")


def _rounds(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Colouring: nodes take the smallest name that reaches them; those that reach their colour's namesake back are its component."""
    nodes = all_nodes(edges)
    left, done = cut(edges.where("src <> dst").distinct()), None
    for _ in range(max_rounds):
        while True:  # nodes without an edge in or out are alone
            n = left.count()
            left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
            if left.count() == n:
                break
        if is_empty(left):
            break
        colour = _spread(all_nodes(left).withColumn("label", F.col("node")), left, max_rounds)
        same = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = label")
        part = cut(_spread(roots, back, max_rounds).select("node", F.col("label").alias("scc")))
        done = part if done is None else done.union(part)
        left = cut(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return nodes.select("node", F.col("node").alias("scc"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def scc(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, scc``: strongly connected components, named after their smallest node."""
    edges = cut(edges.select("src", "dst").distinct())
    if edges.count() <= one_task_edges:
        return _one_task(edges)
    return _rounds(edges)


def scc_table(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``scc, size, has_loop, is_cyclic``."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("loop")).distinct()
    per = labels.join(loops, "node", "left").groupBy("scc").agg(F.count("*").alias("size"), F.coalesce(F.max("loop"), F.lit(0)).alias("has_loop"))
    return per.withColumn("is_cyclic", (F.col("size") > 1) | (F.col("has_loop") == 1))


def scc_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the components of their ends: ``src, dst, s, d``."""
    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("s")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")


def source_sccs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``scc``: components that no edge enters from another."""
    entered = scc_edges(edges, labels).where("s <> d").select(F.col("d").alias("scc")).distinct()
    return labels.select("scc").distinct().join(entered, "scc", "left_anti")


def core_satellite(edges: DataFrame, labels: DataFrame, policy: str = "source-union") -> DataFrame:
    """``node, is_core``: the union of the source components, or the largest one (ties: smaller name)."""
    if policy == "source-union":
        core = source_sccs(edges, labels)
    elif policy == "largest-scc":
        core = labels.groupBy("scc").count().orderBy(F.desc("count"), "scc").limit(1).select("scc")
    else:
        raise ValueError(f"unknown core policy {policy!r}")
    return labels.join(core.withColumn("c", F.lit(True)), "scc", "left").select("node", F.coalesce("c", F.lit(False)).alias("is_core"))


def layers(edges: DataFrame, nodes: DataFrame, seed: DataFrame, max_rounds: int = 10_000, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, layer``: seeds 0; a node follows once all its other predecessors have a layer, one above the highest; behind a cycle none.

    Each node counts the predecessors it waits for; a round counts down the
    successors of the layer before, so every node and edge is used once. Up to
    ``one_task_edges`` edges and nodes the rounds are those of one task.
    """
    start = cut(seed.select("node").distinct())
    e = cut(induced(edges, nodes).distinct().join(start.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if e.count() <= one_task_edges:
        ids, n = number(nodes.select("node").union(start).distinct())
        first = start.join(ids, "node").select(F.col("id").alias("src"), F.lit(-1).alias("dst"))  # seeds are marked by an end of -1
        last = ids.where(F.col("id") == n - 1).select("id", F.lit(-2).alias("dst"))  # so that there is a row

        def solve(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
            seeds = np.zeros(n, bool)
            seeds[src[dst == -1]] = True
            found = digraph.layered(n, src[dst >= 0], dst[dst >= 0], seeds)
            at = np.flatnonzero(found >= 0)
            return [at.astype(np.int32), found[at].astype(np.int32)]

        return in_one_task(by_number(e, ids).union(first).union(last), solve, "id int, layer int").join(ids, "id").select("node", "layer")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("left"))
    state = cut(nodes.select("node").distinct().join(start, "node", "left_anti").join(into, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).alias("m")))
    done = [start.withColumn("layer", F.lit(0))]
    last = done[0]
    for _ in range(max_rounds):
        fewer = e.join(last.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"), F.max("layer").alias("h"))
        state = cut(state.where("left > 0" if len(done) > 1 else "true").join(fewer, "node", "left").select("node", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left"), F.greatest("m", F.coalesce("h", F.lit(0))).alias("m")))
        last = state.where("left = 0").select("node", (F.col("m") + 1).alias("layer"))
        if is_empty(last):
            break
        done.append(last)
        if len(done) % 32 == 0:  # a union of parts at rest, put together now and then
            done = [cut(_together(done[:-1])), last]
    return _together(done)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, indeg, outdeg, degree`` over distinct edges; a loop counts on both sides."""
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outdeg")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("indeg"))
    n = nodes.select("node").distinct() if nodes is not None else all_nodes(e)
    d = n.join(out, "node", "left").join(into, "node", "left").fillna(0, ["indeg", "outdeg"])
    return d.select("node", "indeg", "outdeg", (F.col("indeg") + F.col("outdeg")).alias("degree"))


def top_degrees(table: DataFrame, n: int) -> DataFrame:
    return table.orderBy(F.desc("degree"), "node").limit(n)


def degree_stats(table: DataFrame) -> DataFrame:
    """One row: nodes, edges, max, the value a tenth down from the top, the upper median."""
    counts = table.groupBy("degree").count()
    up = counts.withColumn("below", F.sum("count").over(W.orderBy("degree")) - F.col("count"))
    total = counts.agg(F.sum("count").alias("n"), F.sum(F.col("degree") * F.col("count")).alias("d"), F.max("degree").alias("max_degree"))
    at = lambda k: F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("count") > k), F.col("degree")))
    n = F.col("n")
    return up.crossJoin(F.broadcast(total)).groupBy("n", "d", "max_degree").agg(at(n - 1 - F.floor(n * 0.1)).alias("p90_degree"), at(F.floor(n / 2)).alias("median_degree")).select(n.alias("nodes"), (F.col("d") / 2).cast("long").alias("edges"), "max_degree", "p90_degree", "median_degree")


def two_cycles(edges: DataFrame) -> DataFrame:
    """``a, b``, a < b, with edges both ways."""
    e = edges.select("src", "dst").distinct()
    return e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("a")), ["a", "b"], "left_semi")


def three_cycles(edges: DataFrame) -> DataFrame:
    """``a, b, c``, sorted: distinct triples of nodes on a directed cycle of three."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    x = e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("m"))  # from the smallest node on
    y = e.select(F.col("src").alias("m"), F.col("dst").alias("z"))
    t = x.join(y, "m").where("z > a").join(e.select(F.col("src").alias("z"), F.col("dst").alias("a")), ["z", "a"], "left_semi")
    return t.select("a", F.least("m", "z").alias("b"), F.greatest("m", "z").alias("c")).distinct()


def condensation(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The DAG of components ``(src, dst)`` and their topological level ``(node, layer)``, sources first."""
    dag = scc_edges(edges, labels).where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    names = labels.select(F.col("scc").alias("node")).distinct()
    return dag, layers(dag, names, names.limit(0))


def diagnostics(edges: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """One row: components, sources, sinks; of the largest component (ties: smaller name) its size, parallel edges into and out of it and whether it is a source or sink; the ``top`` sizes."""
    e = cut(scc_edges(edges, labels))
    sizes = labels.groupBy("scc").agg(F.count("*").alias("size"))
    into, out = e.where("s <> d").groupBy(F.col("d").alias("scc")).agg(F.count("*").alias("in_edges")), e.where("s <> d").groupBy(F.col("s").alias("scc")).agg(F.count("*").alias("out_edges"))
    per = cut(sizes.join(into, "scc", "left").join(out, "scc", "left").fillna(0))
    big = per.orderBy(F.desc("size"), "scc").limit(1).select(F.struct("scc", "size", "in_edges", "out_edges").alias("big"))
    first = per.orderBy(F.desc("size"), "scc").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(-F.col("size"))), lambda x: (-x).cast("string")), ",").alias("top_sizes"))
    agg = per.agg(F.count("*").alias("sccs"), F.sum((F.col("in_edges") == 0).cast("long")).alias("sources"), F.sum((F.col("out_edges") == 0).cast("long")).alias("sinks"))
    b = lambda c: F.col(f"big.{c}")
    return agg.crossJoin(big).crossJoin(first).select("sccs", "sources", "sinks", b("size").alias("largest"), b("in_edges").alias("largest_in"), b("out_edges").alias("largest_out"), (b("in_edges") == 0).alias("largest_is_source"), (b("out_edges") == 0).alias("largest_is_sink"), "top_sizes")


def loop_report(edges: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """``totals(metric, value)``, ``histogram(size, n)`` of cyclic components, ``largest(scc, size)`` the top of them."""
    e = cut(edges.select("src", "dst").distinct())
    table = cut(scc_table(e, cut(scc(e))))
    cyclic = table.where("is_cyclic")
    row = table.agg(F.count("*").alias("components"), F.sum(F.col("is_cyclic").cast("long")).alias("cyclic"), F.sum(F.when(F.col("is_cyclic"), F.col("size")).otherwise(0)).alias("nodes_in_cyclic"), F.max("size").alias("largest"))
    row = row.crossJoin(e.agg(F.sum((F.col("src") == F.col("dst")).cast("long")).alias("self_loops"))).crossJoin(two_cycles(e).agg(F.count("*").alias("two_cycles"))).crossJoin(three_cycles(e).agg(F.count("*").alias("three_cycles")))
    totals = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in row.columns])).alias("x")).select("x.*")
    return {"totals": totals, "histogram": cyclic.groupBy("size").agg(F.count("*").alias("n")), "largest": cyclic.orderBy(F.desc("size"), "scc").limit(top).select("scc", "size")}


def analyze(edges: DataFrame, method: str = "bounded-scc", policy: str = "source-union") -> dict[str, DataFrame]:
    """Kernel, components, core, seed and layers (none while a cycle is left), and one table with all flags."""
    from glossweave.operators import feedback

    k = cut(kernel(edges))
    inside = cut(induced(edges, k).distinct())
    labels = cut(scc(inside).join(k, "node", "right").select("node", F.coalesce("scc", "node").alias("scc")))
    core = cut(core_satellite(inside, labels, policy))
    seed, per = feedback.solve(inside, labels, method)
    seed, per = cut(seed), cut(per)
    solved = not per.where("residual > 0").head(1) and seed.head(1)
    layer = layers(inside, k, seed) if solved else seed.limit(0).select("node", F.lit(0).alias("layer"))
    flags = all_nodes(edges).join(labels.join(core, "node"), "node", "left").join(seed.withColumn("s", F.lit(True)), "node", "left").join(layer, "node", "left")
    member = flags.select("node", F.col("scc").isNotNull().alias("is_kernel"), "scc", F.coalesce("is_core", F.lit(False)).alias("is_core"), (F.col("scc").isNotNull() & ~F.coalesce("is_core", F.lit(False))).alias("is_satellite"), F.coalesce("s", F.lit(False)).alias("is_seed"), "layer")
    return {"kernel": k, "edges": inside, "scc": labels, "core": core, "seed": seed, "per_scc": per, "layers": layer, "membership": member}


def reachable(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``src, dst``: every pair with a path of one edge or more (semi-naive; as large as its result)."""
    every = new = cut(edges.select("src", "dst").distinct())
    for _ in range(max_rounds):
        step = new.select("src", F.col("dst").alias("m")).join(edges.select(F.col("src").alias("m"), "dst").distinct(), "m").select("src", "dst").distinct()
        new = cut(step.join(every, ["src", "dst"], "left_anti"))
        if is_empty(new):
            break
        every = cut(every.union(new))
    return every


def reach_counts(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``src, n``: how many nodes a path of one edge or more leads to, without making the pairs (up to ``one_task_edges`` edges)."""
    e = cut(edges.select("src", "dst").distinct())
    if e.count() > one_task_edges:
        return reachable(e).groupBy("src").agg(F.count("*").alias("n"))
    ids, n = number(all_nodes(e))

    def solve(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        found = numbered.reach_counts(numbered.Graph(n, src, dst))
        some = np.flatnonzero(found)
        return [some.astype(np.int32), found[some]]

    return in_one_task(by_number(e, ids), solve, "id int, n long").join(ids, "id").select(F.col("node").alias("src"), "n")


def reverse_diagnostics(edges: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics of the kernel, of the same nodes with edges reversed, and of the reversed graph's own kernel."""
    k = cut(induced(edges, kernel(edges)))
    own = cut(induced(transpose(edges), kernel(transpose(edges))))
    return {name: diagnostics(e, cut(scc(e))) for name, e in (("kernel", k), ("reversed", transpose(k)), ("reversed-kernel", own))}
