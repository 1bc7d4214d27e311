"""Admission of identity clusters: facts of their senses, prioritised rules, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far each class of the lexicality rules is trusted.
PRECISION = {
    "lexical-word": 0.816, "phrase": 0.780, "symbol-code": 0.958, "chemical": 0.779, "proper-name": 0.386, "taxon": 0.818,
    "technical-term": 0.958, "abbreviation": 1.0, "idiom": 0.780, "construction": 0.780, "uncertain": 0.0,
}
LOW_PRECISION = LOW_CONFIDENCE = 0.50
BLOCKED = ("symbol-code", "abbreviation", "taxon", "chemical", "proper-name")
LEXICAL, PHRASE, CONSTRUCTION = ("lexical-word",), ("phrase", "idiom"), ("construction",)
# Rule, priority, decision, whether the strict policy has it.
RULES = (
    ("r_block_symbol_only", 100, "exclude", True),
    ("r_block_sense_mismatch", 100, "exclude", True),
    ("r_quarantine_low_conf", 50, "quarantine", True),
    ("r_admit_lexical", 10, "admit", True),
    ("r_admit_phrase_idiom", 10, "admit", False),
    ("r_admit_construction", 10, "admit", False),
)


def group(senses: DataFrame) -> DataFrame:
    """``ic_id, senses``: of ``(ic_id, sense_id, form, definition, lexicality, reasons ARRAY)``, sorted by sense."""
    s = F.struct("sense_id", "form", "definition", "lexicality", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
    return senses.groupBy("ic_id").agg(F.array_sort(F.collect_list(s)).alias("senses"))


def _precision(tag: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRECISION.items() for x in kv]), tag), F.lit(0.5))


def _confidence(reasons: Column) -> Column:
    """The highest in the reasons: surface rules 1, fallbacks 0.5, else the probability they state."""
    each = F.transform(reasons, lambda r: F.when(r.startswith("surface."), 1.0).when(r.startswith("fallback."), 0.5).otherwise(F.regexp_extract(r, r"\.p([0-9]+(?:\.[0-9]+)?)\b", 1).try_cast("double")))
    return F.array_max(each)


def _worst(tag: Column, reasons: Column) -> Column:
    """The lowest precision among the tag and every class that a reason mentions."""
    names = lambda c: F.exists(reasons, lambda r: r.contains(c))
    mentioned = F.array(*[F.when(names(c), p) for c, p in PRECISION.items()])
    return F.least(_precision(tag), F.coalesce(F.array_min(mentioned), F.lit(1.0)))


def facts(grouped: DataFrame) -> DataFrame:
    """One row a cluster, with what the rules ask."""
    s = F.col("senses")
    of = lambda tags: F.filter(s, lambda x: x["lexicality"].isin(*tags))
    ids = lambda a: F.transform(a, lambda x: x["sense_id"])
    by_surface = lambda x: F.exists(x["reasons"], lambda r: r.startswith("surface."))
    shaky = lambda x: ~by_surface(x) & (_worst(x["lexicality"], x["reasons"]) < LOW_PRECISION)
    unsure = lambda x: ~by_surface(x) & (_worst(x["lexicality"], x["reasons"]) < LOW_PRECISION) & F.coalesce(_confidence(x["reasons"]) < LOW_CONFIDENCE, F.lit(False))
    f = grouped.select("ic_id", "senses", of(LEXICAL).alias("lexical"), of(PHRASE).alias("phrase"), of(CONSTRUCTION).alias("construction"), of(BLOCKED).alias("blocked"))
    admitting = F.concat("lexical", "phrase", "construction")
    gaps = F.filter(
        F.array(
            F.when(F.size("senses") == 0, "no source senses"),
            F.when(F.exists("senses", lambda x: F.trim(F.coalesce(x["definition"], F.lit(""))) == ""), "gloss"),
            F.when(F.exists("senses", lambda x: F.coalesce(x["lexicality"], F.lit("")) == ""), "tag"),
            F.when(F.exists("senses", lambda x: F.size(x["reasons"]) == 0), "rationale"),
        ),
        lambda g: g.isNotNull(),
    )
    weight = lambda x: F.struct((_precision(x["lexicality"]) * F.coalesce(_confidence(x["reasons"]), F.lit(1.0))).alias("w"), x["sense_id"].alias("sense_id"), x["lexicality"].alias("tag"))
    f = f.withColumn("admitting", admitting).withColumn("gaps", gaps)
    f = f.withColumn("best", F.aggregate(F.transform("admitting", weight), F.lit(None).cast("struct<w: double, sense_id: string, tag: string>"), lambda a, x: F.when(a.isNull() | (x["w"] > a["w"]), x).otherwise(a)))
    solid = F.exists("lexical", lambda x: ~shaky(x))
    return f.select(
        "ic_id", "senses", F.size("senses").cast("long").alias("sense_count"),
        F.array_sort(F.array_distinct(F.transform("senses", lambda x: x["form"]))).alias("forms"),
        F.transform("senses", lambda x: x["lexicality"]).alias("tags"),
        ids(F.col("lexical")).alias("lexical_ids"), ids(F.col("phrase")).alias("phrase_ids"), ids(F.col("construction")).alias("construction_ids"), ids(F.col("blocked")).alias("blocked_ids"),
        ((F.size("senses") > 0) & (F.size("admitting") == 0) & ~F.exists("senses", lambda x: x["lexicality"] == "uncertain")).alias("every_blocked"),
        (F.size("gaps") == 0).alias("explicit"), "gaps",
        ((F.size("lexical") > 0) & ~solid).alias("sense_mismatch"),
        ((F.size("lexical") > 0) & ~solid & F.exists("lexical", unsure)).alias("low_confidence"),
        F.col("best.sense_id").alias("best_sense"), F.col("best.tag").alias("best_tag"),
    )


def evaluate(table: DataFrame, expanded: bool = False) -> DataFrame:
    """``ic_id, decision, fired, defeated, aliases, excluded``: the top priority decides; a conflict there, or no rule, is uncertain."""
    lexical = F.size("lexical_ids") > 0
    when = {
        "r_block_symbol_only": F.col("every_blocked"),
        "r_block_sense_mismatch": F.col("sense_mismatch"),
        "r_quarantine_low_conf": (lexical & ~F.col("explicit")) | F.col("low_confidence"),
        "r_admit_lexical": lexical & F.col("explicit"),
        "r_admit_phrase_idiom": (F.size("phrase_ids") > 0) & F.col("explicit"),
        "r_admit_construction": (F.size("construction_ids") > 0) & F.col("explicit"),
    }
    fired = F.filter(F.array(*[F.when(when[r], F.struct(F.lit(p).alias("priority"), F.lit(r).alias("rule"), F.lit(d).alias("decision"))) for r, p, d, strict in RULES if strict or expanded]), lambda x: x.isNotNull())
    v = table.withColumn("all", fired).withColumn("high", F.array_max(F.transform("all", lambda x: x["priority"])))
    v = v.withColumn("top", F.filter("all", lambda x: x["priority"] == F.col("high"))).withColumn("choices", F.array_distinct(F.transform("top", lambda x: x["decision"])))
    tie = F.size("choices") > 1
    v = v.withColumn("decision", F.when(F.size("all") == 0, "uncertain").when(tie, "uncertain").otherwise(F.get("choices", F.lit(0))))
    names = lambda a: F.transform(a, lambda x: x["rule"])
    none = F.array().cast("array<string>")
    ruled = F.when((F.size("all") == 0) | tie, F.array(F.lit("r_uncertain"))).otherwise(names("top"))
    lost = F.when(tie, names("all")).otherwise(names(F.filter("all", lambda x: x["priority"] < F.col("high"))))
    v = v.withColumn("fired", ruled).withColumn("defeated", F.coalesce(lost, none))
    taken = F.concat("lexical_ids", F.when(F.array_contains("fired", "r_admit_phrase_idiom"), F.col("phrase_ids")).otherwise(none), F.when(F.array_contains("fired", "r_admit_construction"), F.col("construction_ids")).otherwise(none))
    v = v.withColumn("taken", F.when(F.col("decision") == "admit", taken).otherwise(none))
    aliases = F.array_sort(F.array_distinct(F.transform(F.filter("senses", lambda x: F.array_contains("taken", x["sense_id"])), lambda x: x["form"])))
    return v.select("ic_id", "decision", "fired", "defeated", aliases.alias("aliases"), F.array_except(F.transform("senses", lambda x: x["sense_id"]), "taken").alias("excluded"))


def decision_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("decision").agg(F.count("*").alias("n"))


def rule_histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.array_join(F.array_sort("fired"), ",").alias("rules")).agg(F.count("*").alias("n"))


def delta(verdicts: DataFrame, legacy: DataFrame) -> DataFrame:
    """Against a plain tag filter ``legacy(ic_id)``: admitted by both, by one only."""
    a = verdicts.where("decision = 'admit'").select("ic_id", F.lit(1).alias("a"))
    j = a.join(legacy.select("ic_id", F.lit(1).alias("b")), "ic_id", "full")
    return j.groupBy(F.when(F.col("b").isNull(), "policy_only").when(F.col("a").isNull(), "legacy_only").otherwise("both").alias("side")).agg(F.count("*").alias("n"))
