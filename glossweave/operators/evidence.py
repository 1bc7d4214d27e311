"""Vocabulary evidence of admitted clusters, the L0 gates, typed buckets and the pressure table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import text as T

# Thresholds and markers.
HIGH_FREQUENCY, EARLY_AOA, HIGH_CONCRETENESS = 5.0, 6.0, 4.0
ARTIFACT_TAGS = ("proper-name", "taxon", "chemical", "symbol-code", "abbreviation")
UNCLEAN = ("numeric_form", "multiword", "artifact_reading_present", "technical_only")
TECHNICAL = """acid algebra alkaline amide amine anatomy anemia application calculus carbonate cell chemical chemistry chromate cortex disease geometry
gland hydroxide mathematics metal mineral muscle myosin oxide reactance series substance sulfate temperature theory vein""".split()
REGISTER = "archaic dialect obsolete slang vulgar".split()
NAMES = "abraham abelard aeneas agrippina athena bacchus balder barrymore beatrice boleyn bolivar christian god jesus mythology odin thor zeus".split()
ARTIFACT_BUCKETS = ("abbreviation_or_code", "proper_name", "taxon", "technical_term", "morphology_register_artifact")
STEMS = {"ing": 5, "ed": 4, "ness": 6, "ly": 4, "tion": 6, "ment": 6}


def candidates(admitted: DataFrame, norms: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Evidence of ``admitted(ic_id, aliases, tags)``.

    ``norms(word, frequency, age_of_acquisition, concreteness)``; ``lists`` holds
    ``strict`` (surfaces), ``typed`` (ic_id), ``longman`` and ``ogden`` (word).
    The best norm over the aliases counts: highest, but for age the lowest.
    """
    a = admitted.where(F.size("aliases") > 0)
    primary = F.array_min(F.transform("aliases", lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]
    a = a.withColumn("primary_alias", primary)
    keys = a.select("ic_id", F.explode("aliases").alias("x")).select("ic_id", T.normalize_lemma(F.col("x")).alias("word")).distinct()
    best = keys.join(norms, "word").groupBy("ic_id").agg(F.max("frequency").alias("frequency"), F.min("age_of_acquisition").alias("age_of_acquisition"), F.max("concreteness").alias("concreteness"))
    out = a.join(best, "ic_id", "left")
    for name, column in (("strict", "strict_lemma_seed"), ("longman", "longman"), ("ogden", "ogden")):
        hit = keys.join(lists[name].select("word").distinct(), "word", "left_semi").select("ic_id").distinct().withColumn(column, F.lit(True))
        out = out.join(hit, "ic_id", "left")
    out = out.join(lists["typed"].select("ic_id").distinct().withColumn("typed_sense_seed", F.lit(True)), "ic_id", "left")
    out = out.fillna(False, ["strict_lemma_seed", "longman", "ogden", "typed_sense_seed"])
    name = T.normalize_lemma(F.col("primary_alias"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    flags = F.array(
        F.when(name.rlike("^[0-9]+(st|nd|rd|th)?$"), "numeric_form"),
        F.when(name.contains("_") | F.exists("aliases", lambda x: x.contains(" ")), "multiword"),
        F.when(blank("frequency"), "missing_frequency"), F.when(blank("age_of_acquisition"), "missing_aoa"), F.when(blank("concreteness"), "missing_concreteness"),
        F.when(F.forall("tags", lambda t: t == "technical-term"), "technical_only"),
        F.when(F.exists("tags", lambda t: t.isin(*ARTIFACT_TAGS)), "artifact_reading_present"),
    )
    out = out.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))
    out = out.withColumn("high_frequency", F.coalesce(F.col("frequency") >= HIGH_FREQUENCY, F.lit(False)))
    out = out.withColumn("early_aoa", F.coalesce((F.col("age_of_acquisition") != 0) & (F.col("age_of_acquisition") <= EARLY_AOA), F.lit(False)))
    out = out.withColumn("high_concreteness", F.coalesce(F.col("concreteness") >= HIGH_CONCRETENESS, F.lit(False)))
    out = out.withColumn("admitted_clean", ~F.arrays_overlap("flags", F.array(*map(F.lit, UNCLEAN))))
    out = out.withColumn("clean_candidate", F.col("admitted_clean") & (F.col("longman") | F.col("ogden")))
    channels = ("admitted_clean", "strict_lemma_seed", "typed_sense_seed", "longman", "ogden", "high_frequency", "early_aoa", "high_concreteness")
    return out.withColumn("evidence_count", sum((F.col(c).cast("int") for c in channels), F.lit(0)))


def order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("clean_candidate"), F.desc("evidence_count"), F.desc("longman"), F.desc("ogden"), "primary_alias")


def l0(table: DataFrame) -> DataFrame:
    """The four gates, how many are open, and whether all are."""
    n = lambda *c: sum((F.col(x).cast("int") for x in c), F.lit(0))
    t = table.withColumn("structural_channels", n("strict_lemma_seed", "typed_sense_seed")).withColumn("cross_list_channels", n("strict_lemma_seed", "longman", "ogden")).withColumn("grounding_proxy_channels", n("early_aoa", "high_concreteness"))
    t = t.withColumn("strict_admission", F.col("admitted_clean")).withColumn("structural", F.col("structural_channels") >= 1).withColumn("cross_list", F.col("cross_list_channels") >= 2).withColumn("grounding_proxy", F.col("grounding_proxy_channels") >= 1)
    t = t.withColumn("channels", n("strict_admission", "structural", "cross_list", "grounding_proxy"))
    return t.withColumn("l0_candidate", F.col("channels") == 4).withColumn("near_miss", F.col("channels") == 3)


def typed_bucket(rows: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Adds ``bucket`` to ``rows(ic_id, known, flags, tags, evidence_count, in_p2, lexicality)``; the first test that holds decides.

    ``known``: there is a candidate row. ``surfaces(surface)`` are all known ones,
    where stems are looked up.
    """
    s = T.surface_of_ic(F.col("ic_id"))
    r = rows.withColumn("surface", s).withColumn("tokens", F.filter(F.split(s, "_"), lambda t: t != ""))
    s, lex = F.col("surface"), F.coalesce("lexicality", F.lit(""))
    tag = lambda t: F.exists("tags", lambda x: x.contains(t))
    flag = lambda f: F.array_contains("flags", f)
    token_in = lambda words: F.exists("tokens", lambda t: t.isin(*words))
    ends = lambda c, some: c.rlike("(" + "|".join(some) + ")$")
    stems = F.array_distinct(F.filter(F.array(*[F.when(s.endswith(x) & (F.length(s) > n), F.left(s, F.length(s) - len(x))) for x, n in STEMS.items()]), lambda x: x.isNotNull()))
    found = r.select("ic_id", F.explode(stems).alias("surface")).join(surfaces.select("surface").distinct(), "surface", "left_semi").select("ic_id").distinct().withColumn("stemmed", F.lit(True))
    r = r.join(found, "ic_id", "left")
    alone = ~F.col("known") & ~F.col("in_p2")
    bucket = (
        F.when(lex.isin("symbol-code", "abbreviation") | tag("symbol-code") | tag("abbreviation") | flag("numeric_form") | s.rlike("[0-9]") | ends(s, ["_abbr", "_abbrev"]) | ((F.length(F.replace(s, F.lit("_"), F.lit(""))) <= 2) & alone), "abbreviation_or_code")
        .when((lex == "proper-name") | tag("proper-name") | token_in(NAMES) | ends(s, ["_legend", "_myth", "_mythology"]), "proper_name")
        .when((lex == "taxon") | tag("taxon") | ends(s, ["aceae", "idae", "inae", "ales", "phyta", "mycota", "opsida"]) | F.exists("tokens", lambda t: ends(t, ["aceae", "idae", "inae", "ales", "phyta"])), "taxon")
        .when(flag("technical_only") | tag("technical-term") | token_in(TECHNICAL) | F.exists("tokens", lambda t: ends(t, ["ectomy", "emia", "itis", "ose", "ide", "ate"])), "technical_term")
        .when(alone, "resource_specific_tail")
        .when((F.coalesce("evidence_count", F.lit(0)) <= 1) & ~F.col("in_p2"), "resource_specific_tail")
        .when(token_in(REGISTER) | (ends(s, STEMS) & F.coalesce("stemmed", F.lit(False))), "morphology_register_artifact")
        .otherwise("plausible_missing_primitive")
    )
    return r.withColumn("bucket", bucket).drop("stemmed", "tokens")


def pressure_bucket() -> Column:
    """The first test that holds, over a row of the pressure table."""
    t, flags = F.coalesce("typed_bucket", F.lit("")), F.coalesce("flags", F.array().cast("array<string>"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(t.isin(*[b for b in ARTIFACT_BUCKETS if b != "taxon"]) & yes("high_frequency"), "common_vocabulary")
        .when(t.isin(*ARTIFACT_BUCKETS) | F.arrays_overlap(flags, F.array(*map(F.lit, ("numeric_form", "multiword", "technical_only")))), "resource_artifact")
        .when(yes("obstruction_core") & (yes("l0_candidate") | yes("clean_candidate")), "primitive_candidate")
        .when(yes("obstruction_core") & yes("high_frequency"), "assembler_helper")
        .when(yes("obstruction_core"), "circular_dependency")
        .when((t == "resource_specific_tail") | (yes("staged_seed") & ~yes("p2_seed")), "external_substrate")
        .when(yes("p2_seed") & yes("high_frequency") & yes("early_aoa"), "base_promotable_terminal_common")
        .otherwise("candidate_background")
    )


def pressure_table(sources: dict[str, DataFrame], candidate_rows: DataFrame, typed: DataFrame, norms: DataFrame) -> DataFrame:
    """One row a cluster in any of the sources ``{flag column: DataFrame(ic_id)}``, the candidates or the typed buckets."""
    ids = candidate_rows.select("ic_id").union(typed.select("ic_id"))
    for df in sources.values():
        ids = ids.union(df.select("ic_id"))
    t = ids.distinct().join(candidate_rows.select("ic_id", "primary_alias", "clean_candidate", F.col("admitted_clean").alias("strict_admission"), "evidence_count", "flags"), "ic_id", "left").join(typed.select("ic_id", F.col("bucket").alias("typed_bucket")), "ic_id", "left")
    for name, df in sources.items():
        t = t.join(df.select("ic_id").distinct().withColumn(name, F.lit(True)), "ic_id", "left")
    t = t.withColumn("primary_alias", F.coalesce("primary_alias", T.surface_of_ic(F.col("ic_id")))).withColumn("word", T.normalize_lemma(F.col("primary_alias"))).join(norms, "word", "left")
    for name, hit in (("high_frequency", F.col("frequency") >= HIGH_FREQUENCY), ("early_aoa", F.col("age_of_acquisition") <= EARLY_AOA), ("high_concreteness", F.col("concreteness") >= HIGH_CONCRETENESS)):
        t = t.withColumn(name, F.coalesce(hit, F.lit(False)))
    return t.fillna(False, [*sources, "clean_candidate", "strict_admission"]).withColumn("pressure_bucket", pressure_bucket()).drop("word")
