"""Exported rows, coverage, overlaps and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.functions import text as T
from glossweave.operators.structure import degrees

MARKERS = ("genus", "family", "taxonomic", "city", "province")


def component(is_seed: Column, is_core: Column, is_kernel: Column) -> Column:
    return F.when(is_core, "core").when(is_kernel, "satellite").when(is_seed, "seed").otherwise("rest")


def membership_from_layers(layers: DataFrame, core: DataFrame) -> DataFrame:
    """``node, layer, is_seed, is_core, is_satellite`` of nodes that have a layer."""
    c = core.where("is_core").select("node").withColumn("is_core", F.lit(True))
    m = layers.join(c, "node", "left").fillna(False, ["is_core"])
    return m.select("node", "layer", (F.col("layer") == 0).alias("is_seed"), "is_core", (~F.col("is_core")).alias("is_satellite"))


def kernel_rows(member: DataFrame, nodes: DataFrame, edges: DataFrame, norms: DataFrame, method: str = "bounded-scc", source: str = "lexicon") -> DataFrame:
    """The 17 columns of an exported node. ``nodes(node, gloss)``, ``norms(word, frequency, age_of_acquisition, concreteness)``."""
    d = degrees(edges)
    r = member.join(nodes.select("node", "gloss"), "node", "left").join(d, "node", "left").withColumn("k", T.split_node(F.col("node"))).withColumn("word", F.col("k.lemma"))
    r = r.join(norms, "word", "left")
    return r.select(
        F.col("node").alias("node_id"), F.col("word").alias("lemma"), F.col("k.pos").alias("pos"), F.replace("word", F.lit("_"), F.lit(" ")).alias("surface_word"), "gloss",
        F.when(F.col("is_core"), "core").otherwise("satellite").alias("component"), "is_seed", F.lit(method).alias("seed_method"), F.when(F.col("is_seed"), F.col("node")).alias("candidate_seed_id"), "layer",
        F.coalesce("degree", F.lit(0)).alias("degree_score"), F.coalesce("outdeg", F.lit(0)).alias("outdegree"), F.coalesce("indeg", F.lit(0)).alias("indegree"), "frequency", "age_of_acquisition", "concreteness", F.lit(source).alias("source_label"),
    )


def rank_columns() -> list[Column]:
    """By layer, frequency (high first, null last), age (low first; 0 counts as unknown; null last), degree, id."""
    aoa = F.when(F.coalesce("age_of_acquisition", F.lit(0.0)) == 0, 999.0).otherwise(F.col("age_of_acquisition"))
    return [F.asc("layer"), F.desc_nulls_last("frequency"), F.col("age_of_acquisition").isNull().asc(), aoa.asc(), F.desc("degree_score"), F.asc("node_id")]


def top_per_layer(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy("layer").orderBy(*rank_columns()[1:]))).where(F.col("position") <= n)


def seed_surfaces(rows: DataFrame) -> DataFrame:
    """Seed rows by lemma: the nine columns."""
    return rows.where("is_seed").groupBy("lemma").agg(
        F.min("surface_word").alias("surface_word"), F.count("*").alias("seed_node_count"), F.array_join(F.array_sort(F.collect_set("node_id")), ";").alias("source_node_ids"), F.array_join(F.array_sort(F.collect_set("pos")), ";").alias("parts_of_speech"),
        F.max("degree_score").alias("max_degree_score"), F.max("frequency").alias("best_frequency"), F.min("age_of_acquisition").alias("earliest_age_of_acquisition"), F.avg("concreteness").alias("mean_concreteness"),
    )


def suspicion(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``reasons``, most first when ordered by ``-size(reasons)``."""
    loops = edges.where("src = dst").select(F.col("src").alias("node_id"), F.lit(True).alias("__loop")).distinct()
    gloss = F.lower(F.coalesce("gloss", F.lit("")))
    missing = lambda c: F.when(F.col(c).isNull(), f"missing_{c}")
    reasons = F.array(F.when(F.col("lemma").contains("_"), "multiword"), missing("frequency"), missing("age_of_acquisition"), missing("concreteness"), F.when(F.col("__loop"), "self_loop"), F.when(gloss.rlike("|".join(MARKERS)), "domain_or_named_entity_like"))
    return rows.join(loops, "node_id", "left").withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).drop("__loop")


def coverage(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """``field, covered, total, fraction`` of ``annotations(key, field, value)`` over the nodes' lemmas."""
    n = nodes.select(T.lemma_of(F.col("node")).alias("key"))
    total = n.agg(F.count("*").alias("total"))
    hit = n.join(annotations.where("value is not null").select("key", "field").distinct(), "key").groupBy("field").agg(F.count("*").alias("covered"))
    fields = annotations.select("field").distinct()
    return fields.join(hit, "field", "left").crossJoin(F.broadcast(total)).select("field", F.coalesce("covered", F.lit(0)).alias("covered"), "total", F.when(F.col("total") > 0, F.coalesce("covered", F.lit(0)) / F.col("total")).otherwise(0.0).alias("fraction"))


def component_summary(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """``component, field, n, mean`` of ``members(component, node)``, where a node may be in several; mean 0 without values."""
    m = members.select("component", T.lemma_of(F.col("node")).alias("key"))
    grid = members.select("component").distinct().crossJoin(F.broadcast(annotations.select("field").distinct()))
    got = m.join(annotations.where("value is not null"), "key").groupBy("component", "field").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grid.join(got, ["component", "field"], "left").select("component", "field", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def overlap(a: DataFrame, b: DataFrame, column: str = "node", examples: int = 25) -> DataFrame:
    """One row: sizes, what is common, shares of either, Jaccard (1 if both are empty) and the first common ones."""
    j = a.select(column).distinct().withColumn("x", F.lit(1)).join(b.select(column).distinct().withColumn("y", F.lit(1)), column, "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    few = j.where(both).orderBy(column).limit(examples).agg(F.array_sort(F.collect_list(column)).alias("examples"))
    s = j.agg(F.count("x").alias("left_n"), F.count("y").alias("right_n"), F.count(F.when(both, 1)).alias("common"), F.count("*").alias("n")).crossJoin(few)
    ratio = lambda n, d, empty: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(empty)
    return s.select("left_n", "right_n", "common", ratio("common", "left_n", 0.0).alias("left_share"), ratio("common", "right_n", 0.0).alias("right_share"), ratio("common", "n", 1.0).alias("jaccard"), "examples")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """``metric, left_value, right_value, difference`` of two ``(metric, value)`` tables."""
    j = left.select("metric", F.col("value").alias("left_value")).join(right.select("metric", F.col("value").alias("right_value")), "metric", "full")
    return j.withColumn("difference", F.col("right_value") - F.col("left_value"))


def resolver_verdict(kernel_size: Column, reference_size: Column) -> Column:
    """(i) a fifth smaller and more, (ii) within a fifth, (iii) larger."""
    rel = F.abs(kernel_size - reference_size) / reference_size
    return F.when((kernel_size < reference_size) & (rel >= 0.2), "(i)").when(rel < 0.2, "(ii)").otherwise("(iii)")
