"""Grounding: unfolding closures, the groundability fixpoint, status of senses, and what to report of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.operators.loops import cut, is_empty

BANDS = (50, 100, 200)
PRIMITIVE = ("primitive_candidate", "assembler_helper", "base_promotable_terminal_common")


def unfold(senses: DataFrame, edges: DataFrame, seed_ics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``closure(node, ic)`` and ``seed_closure(node, ic)`` of ``senses(node, ic, layer)``, layer by layer.

    A sense of a seed class is its own end. Any other unfolds to the classes of its
    defining senses outside its own class, and to theirs.
    """
    s = cut(senses.join(seed_ics.select("ic", F.lit(True).alias("is_seed")), "ic", "left").fillna(False, ["is_seed"]))
    ends = s.where("is_seed").select("node", "ic")
    src = s.select(F.col("node").alias("src"), F.col("ic").alias("src_ic"), F.col("layer").alias("src_layer"))
    dst = s.where("not is_seed").select(F.col("node").alias("dst"), F.col("ic").alias("own"), "layer")
    direct = cut(edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").where("src_ic <> own and src_layer is not null"))
    ends = cut(ends)
    every, seeds = [ends], [ends]  # parts at rest: a sense's closure is written once, with its layer
    for n in sorted(r["layer"] for r in direct.select("layer").distinct().collect() if r["layer"] is not None):
        # a definer in the same layer or above has no closure yet: only its class counts
        mine = direct.where(F.col("layer") == n)
        at = mine.select("src", "dst")
        through = lambda parts: at.join(_union(parts).withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "ic")
        new = cut(mine.select(F.col("dst").alias("node"), F.col("src_ic").alias("ic")).union(through(every)).distinct())
        more = cut(through(seeds).distinct())
        every.append(new)
        seeds.append(more)
    return _union(every), _union(seeds)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def index_rows(senses: DataFrame, closure: DataFrame, seed_closure: DataFrame, max_ids: int = 500) -> DataFrame:
    """One row a sense: sizes, and the first ``max_ids`` ids of either closure by name."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        r = df.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("ic")))
        return r.groupBy("node").agg(F.count("*").alias(f"{name}_size"), F.array_sort(F.collect_list(F.when(F.col("r") <= max_ids, F.col("ic")))).alias(f"{name}_ids"))

    out = senses.join(packed(closure, "closure"), "node", "left").join(packed(seed_closure, "seed"), "node", "left").fillna(0, ["closure_size", "seed_size"])
    for name in ("closure", "seed"):
        out = out.withColumn(f"{name}_ids", F.coalesce(f"{name}_ids", F.array().cast("array<string>"))).withColumn(f"{name}_truncated", F.col(f"{name}_size") > max_ids)
    return out


def size_summary(rows: DataFrame, column: str = "closure_size", share: float = 0.9) -> DataFrame:
    """Median, the value at the rounded (half to even) place of ``share``, and the maximum."""
    counts = rows.groupBy(column).agg(F.count("*").alias("k")).withColumn("below", F.sum("k").over(W.orderBy(column)) - F.col("k"))
    total = rows.agg(F.count("*").alias("n"), F.percentile(column, F.lit(0.5)).alias("median"), F.max(column).alias("largest"))
    at = F.bround((F.col("n") - 1) * share)
    pick = F.max(F.when((F.col("below") <= at) & (F.col("below") + F.col("k") > at), F.col(column)))
    return counts.crossJoin(F.broadcast(total)).groupBy("median", "largest").agg(pick.alias("p90"))


def groundable(base: DataFrame, senses: DataFrame, definers: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``ic``: in the base, or with some sense, not truncated, all of whose definers are groundable (none: at once).

    ``senses(node, ic, truncated)``, ``definers(node, ic)``.
    """
    known = cut(base.select("ic").distinct())
    live = cut(senses.where("not truncated").select("node", "ic"))
    needs = cut(definers.select("node", F.col("ic").alias("need")).distinct())
    for _ in range(max_rounds):
        unmet = needs.join(known.withColumnRenamed("ic", "need"), "need", "left_anti").select("node").distinct()
        new = cut(live.join(unmet, "node", "left_anti").select("ic").distinct().join(known, "ic", "left_anti"))
        if is_empty(new):
            return known
        known = cut(known.union(new))
    raise RuntimeError("groundability did not settle")


def status(senses: DataFrame, closure: DataFrame, grounded: DataFrame, pressure: DataFrame) -> DataFrame:
    """``node, ic, closure_size, status, trivial, missing`` of ``senses(node, ic, closure_size, truncated)``.

    graph_data (truncated), closed, else by what is missing: artifact before
    circular before external before background.
    """
    lost = closure.join(grounded, "ic", "left_anti").join(pressure.select("ic", "pressure_bucket"), "ic", "left")
    has = lambda b: F.max(F.coalesce((F.col("pressure_bucket") == b).cast("int"), F.lit(0)))
    per = lost.groupBy("node").agg(F.count("*").alias("missing"), has("resource_artifact").alias("a"), has("circular_dependency").alias("c"), has("external_substrate").alias("e"))
    self_only = closure.groupBy("node").agg(F.max("ic").alias("hi"), F.min("ic").alias("lo"))
    s = senses.join(per, "node", "left").join(self_only, "node", "left")
    v = F.when(F.col("truncated"), "graph_data").when(F.col("missing").isNull(), "closed").when(F.col("a") == 1, "artifact").when(F.col("c") == 1, "circular").when(F.col("e") == 1, "external").otherwise("background")
    s = s.withColumn("status", v)
    return s.select("node", "ic", "closure_size", "status", ((F.col("status") == "closed") & F.coalesce((F.col("hi") == F.col("ic")) & (F.col("lo") == F.col("ic")), F.lit(False))).alias("trivial"), F.when(F.col("status") == "graph_data", 0).otherwise(F.coalesce("missing", F.lit(0))).cast("long").alias("missing"))


def bands(rows: DataFrame, limits: tuple[int, ...] = BANDS) -> DataFrame:
    """``band, status, n``: overlapping bands by closure size, and all."""
    names = F.filter(F.array(*[F.when(F.col("closure_size") <= b, f"closure_size_le_{b}") for b in limits], F.lit("all_targets")), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("band"), "status").groupBy("band", "status").agg(F.count("*").alias("n"))


def rates(counts: DataFrame) -> DataFrame:
    """``band, closed, total, rate``; graph_data does not count."""
    t = counts.groupBy("band").agg(F.coalesce(F.sum(F.when(F.col("status") == "closed", F.col("n"))), F.lit(0)).alias("closed"), F.coalesce(F.sum(F.when(F.col("status") != "graph_data", F.col("n"))), F.lit(0)).alias("total"))
    return t.withColumn("rate", F.when(F.col("total") > 0, F.col("closed") / F.col("total")).otherwise(0.0))


def usage(rows: DataFrame, closure: DataFrame, base: DataFrame) -> DataFrame:
    """``ic, n``: in how many closed closures each base class stands."""
    return closure.join(rows.where("status = 'closed'").select("node"), "node", "left_semi").join(base, "ic", "left_semi").groupBy("ic").agg(F.count("*").alias("n"))


def blockers(rows: DataFrame, closure: DataFrame, grounded: DataFrame) -> DataFrame:
    """``ic, n``: how many senses miss it."""
    return closure.join(grounded, "ic", "left_anti").join(rows.where("status <> 'graph_data'").select("node"), "node", "left_semi").groupBy("ic").agg(F.count("*").alias("n"))


def bases(pressure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L0 alone, and with the primitive buckets."""
    first = pressure.where("l0_candidate").select("ic").distinct()
    return first, pressure.where(F.col("l0_candidate") | F.col("pressure_bucket").isin(*PRIMITIVE)).select("ic").distinct()


def yield_of(before: DataFrame, after: DataFrame, base: DataFrame, augmented: DataFrame) -> DataFrame:
    """One row: closed before and after, classes added, closed senses won per class added."""
    closed = lambda df, n: df.agg(F.coalesce(F.sum((F.col("status") == "closed").cast("long")), F.lit(0)).alias(n))
    added = augmented.join(base, "ic", "left_anti").agg(F.count("*").alias("added"))
    r = closed(before, "closed_before").crossJoin(closed(after, "closed_after")).crossJoin(added)
    return r.withColumn("mgy", F.when(F.col("added") > 0, (F.col("closed_after") - F.col("closed_before")) / F.col("added")).otherwise(0.0))


def coarsen(column: Column, mapping: dict[str, str]) -> Column:
    """Mapped; what is not, to the ``*`` entry if there is one, else itself."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, column), F.lit(mapping["*"]) if "*" in mapping else column)


def entropy(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Shannon bits of a histogram, its ceiling log2 K, total bits and saturation."""
    total = F.sum(n).over(W.partitionBy(*(by or [F.lit(1)])))
    p = counts.withColumn("__p", F.col(n) / total)
    h = F.coalesce(-F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.log2("__p"))), F.lit(0.0))
    e = p.groupBy(*(by or [])).agg(F.abs(h).alias("h"), F.sum(n).alias("rows"), F.count("*").alias("k"))
    e = e.withColumn("ceiling", F.when(F.col("k") > 1, F.log2("k")).otherwise(0.0))
    return e.withColumn("bits", F.col("h") * F.col("rows")).withColumn("saturation", F.when(F.col("ceiling") > 0, F.col("h") / F.col("ceiling")).otherwise(0.0))


def falsified(rate: Column, artifact_share: Column, mgy: Column, least_rate: float, most_artifact: float, least_mgy: float) -> Column:
    """The names of the thresholds that are missed."""
    return F.filter(F.array(F.when(rate < least_rate, "closure_rate"), F.when(artifact_share > most_artifact, "artifact_share"), F.when(mgy < least_mgy, "mgy")), lambda x: x.isNotNull())


def containment(closure: DataFrame, rows: DataFrame, pressure: DataFrame) -> DataFrame:
    """``pressure_bucket, ics, contained``: classes of each bucket, and in how many closures of ``rows`` they stand, summed."""
    n = closure.join(rows.select("node"), "node", "left_semi").groupBy("ic").agg(F.count("*").alias("n"))
    return pressure.select("ic", "pressure_bucket").join(n, "ic", "left").groupBy("pressure_bucket").agg(F.count("*").alias("ics"), F.coalesce(F.sum("n"), F.lit(0)).alias("contained"))


def migration(before: DataFrame, after: DataFrame, key: str = "ic", column: str = "pressure_bucket") -> DataFrame:
    """``before, after, n`` of those in both whose bucket has changed."""
    j = before.select(key, F.col(column).alias("before")).join(after.select(key, F.col(column).alias("after")), key)
    return j.where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Senses that were closed and are not any more."""
    return before.where("status = 'closed'").select("node").join(after.where("status <> 'closed'").select("node", "status"), "node")
