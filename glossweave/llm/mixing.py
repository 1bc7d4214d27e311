"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Efraimidis and Spirakis, "Weighted random sampling with a reservoir" (2006):
a document of quality weight w gets the exponential key -ln(u) / w; ascending
keys are a weighted sample without replacement of any length. A source whose
target exceeds its size is taken whole as often as it fits (complete epochs),
and the rest of the budget goes along the keys.

The order within a source is a two-level prefix sum: keys fall into
equal-probability bins, bins are summed per source, and only a bin is sorted in
one task. So a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, doc_key, documents

WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of the quality weights; bins differ in expected rows by at most HIGH / LOW.
LOW, HIGH = 0.5, 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in [LOW, HIGH]: higher for texts whose words have the usual mean length and few digits or symbols."""
    chars = F.length(text)
    odd = chars - F.length(F.translate(text, "0123456789#$%&*{}[]<>|\\^~=_+@", ""))
    per_word = chars / F.greatest(size, F.lit(1))
    shape = F.when((per_word >= 3) & (per_word <= 12), 1.0).otherwise(0.5)
    clean = F.greatest(F.lit(0.0), 1.0 - 4.0 * odd / F.greatest(chars, F.lit(1)))
    return F.coalesce(F.greatest(F.lit(LOW), F.lit(HIGH) * shape * clean), F.lit(LOW))


def targets(sources: DataFrame, share: float = 1.0, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``sources(source, source_size, n)``.

    Sources by code point (null last) weigh 1..``cycle`` repeating. Targets share
    ``share`` of all words by weight and stop at ``cap`` times the source's size;
    the excess is reshared by weight until none is above. That is water filling:
    with sources by ascending cap / weight, the first k stop at their caps for the
    smallest k at which the next, at the common level, stays below its own.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = sources.withColumn("weight", (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(cycle)) + 1).cast("double"))
    w = w.withColumn("most", F.lit(cap) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("all", F.lit(share) * F.sum("source_size").over(everything))
    w = w.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    w = w.withColumn("below", F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level")))
    w = w.withColumn("common", F.first("below", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return w.select("source", "n", "source_size", F.coalesce(F.least(F.col("most"), F.col("common") * F.col("weight")), F.col("most")).alias("target"))


def plan(docs: DataFrame, scratch: Scratch, seed: int = 42, bin_rows: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs(doc_id, text, source)``: ``size, source_size, target, copies``.

    ``copies`` is how often the mix takes the document: the source's complete
    epochs, and one more for those along the keys whose middle lies within the
    rest of the budget, which leaves the sum within half a document of the target.
    Null or empty texts have size 0 and take part (copies as for any other). A null
    source is a source of its own, sorted last. Repeated rows are drawn one by one.
    The draw depends on seed, doc_id and text alone, so reruns agree.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "source", *keep, n_words(text).alias("size"), text.alias("__text"))
    rows = rows.withColumn("weight", quality(F.col("__text"), F.col("size")))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "__text", F.lit(seed))).drop("__text")
    u = (F.pmod(F.xxhash64("tie", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = scratch.table(rows.withColumn("key", -F.log(u) / F.col("weight")), "rows")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    per_source = scratch.table(per_source.withColumn("bins", F.ceil(F.col("n") / bin_rows)).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "sources")
    same = rows.source.eqNullSafe(per_source.source)
    binned = rows.join(per_source, same, "left").drop(per_source.source)
    binned = binned.withColumn("bin", F.least(F.col("bins") - 1, F.floor((1 - F.exp(-F.col("key") * LOW)) * F.col("bins"))))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bin")) - F.col("words")).select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    out = binned.withColumn("within", F.sum("size").over(W.partitionBy("source", "bin").orderBy("key", "tie", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    out = out.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = F.when(F.col("before") + F.col("within") + F.col("size") / 2.0 <= rest, 1).otherwise(0)
    return out.withColumn("copies", (F.col("epochs") + F.when(F.col("size") > 0, more).otherwise(0)).cast("int")).select("doc_id", "source", *keep, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all its columns, each as often as the plan takes it.

    Null and empty texts have size 0: they come as often as their source has
    complete epochs. A null source is a source of its own, a null doc_id an id like
    any other. Rows that agree in doc_id, source and text share the copies drawn for
    them, more for those with the smaller hash of the other columns (which must not
    be maps), so reruns agree. Other columns of any name pass unchanged; an empty
    table gives no rows. Texts travel once, to the rows of the plan.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = ["k1", "k2", "k3"]
    keyed = docs.select(*doc_key(), F.xxhash64(*others).alias("k3"), "doc_id", "text", "source", F.struct(*others).alias("rest"))
    planned = plan(keyed.select("doc_id", "text", "source", *key), scratch, seed, keep=tuple(key))
    same = W.partitionBy("k1", "k2", "source").orderBy("k3")
    all_ = W.partitionBy("k1", "k2", "source")
    taken = planned.select(*key, "source", "copies", F.row_number().over(same).alias("nth"), F.count("*").over(all_).alias("same"), F.sum("copies").over(all_).alias("all"))
    own = F.when(F.col("same") == 1, F.col("copies")).otherwise(F.floor(F.col("all") / F.col("same")) + F.when(F.col("nth") <= F.pmod("all", "same"), 1).otherwise(0))
    # of rows that agree in all columns, the first comes for all of them
    taken = scratch.table(taken.withColumn("n", own).groupBy(*key).agg(F.sum("n").cast("int").alias("n")).where("n > 0"), "taken")
    joined = keyed.select(*key, "text", "rest").join(taken.hint("merge"), key).withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*key))).where("nth = 1")
    rows = joined.select("text", "rest", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return rows.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of ``mix`` for all documents, one row each: words, its source's words and target, and the words the mix takes of it."""
    out = plan(documents(spark, sf_dir), Scratch(spark, "mixing"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
