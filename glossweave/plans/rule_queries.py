"""Queries over rules, evidence, grounding, exports, statistics and logic."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.functions import text as T
from glossweave.operators import admission, evidence, export, ground, lexicality, logic, stats, structure
from glossweave.operators.loops import cut
from glossweave.plans import fixtures as X
from glossweave.plans.graph_queries import DEG, SEED, _layers_sql
from glossweave.plans.text_queries import tagged

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


_RULES = [
    (f"regexp_matches(gloss, '{lexicality.ABBREVIATION}')", "abbreviation", "surface.abbreviation"),
    (f"regexp_full_match(form, '{lexicality.FORMULA}')", "chemical", "surface.chemical_formula"),
    ("k <= 3 AND c = 'lower' AND lemma IN (" + ", ".join(f"'{w}'" for w in lexicality.SHORT_WORDS) + ")", "lexical-word", "surface.short_token_whitelist"),
    ("k = 1", "symbol-code", "surface.single_character"),
    ("k <= 3 AND c NOT IN ('lower', 'uncased')", "symbol-code", "surface.short_token_case_rejected"),
    ("c IN ('upper', 'mixed') AND k <= 5", "symbol-code", "surface.code_case"),
    ("k <= 3", "symbol-code", "surface.short_token_unlisted"),
    (f"regexp_matches(gloss, '{lexicality.TECHNICAL}')", "technical-term", "surface.technical_domain"),
    (f"regexp_matches(gloss, '{lexicality.IDIOM}')", "idiom", "surface.idiom"),
    (f"regexp_matches(lower(gloss), '{'|'.join(lexicality.CHEMICAL_WORDS)}') OR regexp_matches(d, '{lexicality.FORMULA}')", "chemical", "fallback.chemical_keyword"),
    (f"regexp_matches(lower(gloss), '{'|'.join(lexicality.TAXON_WORDS)}')", "taxon", "fallback.taxon_keyword"),
    (f"regexp_matches(lower(gloss), '{'|'.join(lexicality.TECHNICAL_WORDS)}')", "technical-term", "fallback.technical_keyword"),
    ("p IN ('a', 'n', 'r', 's', 'v')", "lexical-word", "fallback.pos_default"),
    ("true", "uncertain", "fallback.uncertain"),
]
LEX = f""",
lx AS MATERIALIZED (SELECT ord, lemma, form, d, CASE {" ".join(f"WHEN {w} THEN '{t}'" for w, t, _ in _RULES)} END AS tag, CASE {" ".join(f"WHEN {w} THEN '{r}'" for w, _, r in _RULES)} END AS reason FROM
 (SELECT ord, lemma, form, definition AS d, trim(definition) AS gloss, CASE pos WHEN 'en' THEN 'n' WHEN 'de' THEN 'v' WHEN 'fr' THEN 'a' ELSE 'x' END AS p, length(lemma) AS k,
  CASE WHEN s = lower(s) THEN 'lower' WHEN s = upper(s) THEN 'upper' WHEN substr(s, 2) = lower(substr(s, 2)) THEN 'title' ELSE 'mixed' END AS c FROM (SELECT *, regexp_replace(form, '[^A-Za-z]', '', 'g') AS s FROM e))),
ic AS MATERIALIZED (SELECT 'ic:' || lemma AS ic_id, lemma, count(*) AS n, count(*) FILTER (tag = 'lexical-word') AS lexical, count(*) FILTER (tag = 'idiom') AS phrase, count(*) FILTER (tag IN ('symbol-code', 'abbreviation', 'taxon', 'chemical', 'proper-name')) AS blocked,
  count(*) FILTER (tag = 'uncertain') AS unsure, count(*) FILTER (trim(d) = '') AS blank, list_sort(list(DISTINCT form)) AS forms, list_distinct(list(tag)) AS tags, list_sort(list(DISTINCT form) FILTER (tag = 'lexical-word')) AS lexforms FROM lx GROUP BY lemma),
dec AS MATERIALIZED (SELECT *, CASE WHEN lexical + phrase = 0 AND unsure = 0 THEN 'exclude' WHEN lexical > 0 AND blank > 0 THEN 'quarantine' WHEN lexical > 0 THEN 'admit' ELSE 'uncertain' END AS decision FROM ic)"""


def clusters_of(spark, d):
    t = tagged(spark, d)
    # the rules ask of a gloss only whether it is blank, and all senses of a lemma stand in one row
    blank_or_not = F.left(F.trim("definition"), F.lit(1))
    s = t.select(F.concat(F.lit("ic:"), F.col("word")).alias("ic_id"), F.format_string("s%020d", "sense_id").alias("sense_id"), F.col("lemma").alias("form"), blank_or_not.alias("definition"), "lexicality", F.array("reason").alias("reasons"))
    return admission.facts(admission.group(s))


@query("admission_facts", X.sql("SELECT ic_id, n AS sense_count, lexical, blocked, lexical + phrase = 0 AND unsure = 0 AS every_blocked, blank = 0 AS explicit, array_to_string(forms, ',') AS forms FROM ic", LEX))
def admission_facts(spark, d):
    n = lambda c: F.size(c).cast("long")
    return clusters_of(spark, d).select("ic_id", "sense_count", n("lexical_ids").alias("lexical"), n("blocked_ids").alias("blocked"), "every_blocked", "explicit", F.array_join("forms", ",").alias("forms"))


@query("admission_decisions", X.sql("SELECT ic_id, decision, CASE WHEN decision = 'admit' THEN array_to_string(lexforms, ',') ELSE '' END AS aliases FROM dec", LEX))
def admission_decisions(spark, d):
    return admission.evaluate(clusters_of(spark, d)).select("ic_id", "decision", F.array_join("aliases", ",").alias("aliases"))


@query("admission_counts", X.sql("SELECT decision, count(*) AS n FROM dec GROUP BY decision", LEX))
def admission_counts(spark, d):
    return admission.decision_counts(admission.evaluate(clusters_of(spark, d)))


@query("admission_rule_histogram", X.sql("SELECT CASE decision WHEN 'exclude' THEN 'r_block_symbol_only' WHEN 'quarantine' THEN 'r_quarantine_low_conf' WHEN 'admit' THEN 'r_admit_lexical' ELSE 'r_uncertain' END AS rules, count(*) AS n FROM dec GROUP BY 1", LEX))
def rule_histogram(spark, d):
    return admission.rule_histogram(admission.evaluate(clusters_of(spark, d)))


@query("admission_delta", X.sql("SELECT CASE WHEN decision <> 'admit' THEN 'legacy_only' WHEN lexical = n THEN 'both' ELSE 'policy_only' END AS side, count(*) AS n FROM dec WHERE decision = 'admit' OR lexical = n GROUP BY 1", LEX))
def admission_delta(spark, d):
    f = cut(clusters_of(spark, d))
    return admission.delta(admission.evaluate(f), f.where(F.size("lexical_ids") == F.col("sense_count")))


EVID = LEX + X.NORMS + """,
strict AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS word FROM benchmark),
hd AS (SELECT lemma, count(*) AS k, max((pos = 'en')::INT) AS en FROM e GROUP BY lemma),
cand AS MATERIALIZED (SELECT dec.ic_id, dec.lemma, tags, frequency, age_of_acquisition, concreteness, (SELECT min((length(x), x)) FROM (SELECT unnest(lexforms) AS x)) AS pa,
  dec.lemma IN (SELECT word FROM strict) AS strict_lemma_seed, en = 1 AS typed_sense_seed, hd.k > 1 AS longman, length(dec.lemma) <= 6 AS ogden,
  coalesce(frequency >= 5, false) AS high_frequency, coalesce(age_of_acquisition <= 6, false) AS early_aoa, coalesce(concreteness >= 4, false) AS high_concreteness,
  NOT list_has_any(tags, ['proper-name', 'taxon', 'chemical', 'symbol-code', 'abbreviation']) AS admitted_clean
  FROM dec JOIN hd USING (lemma) LEFT JOIN norms ON word = dec.lemma WHERE decision = 'admit'),
lz AS MATERIALIZED (SELECT *, admitted_clean AND (longman OR ogden) AS clean_candidate, admitted_clean::INT + strict_lemma_seed::INT + typed_sense_seed::INT + longman::INT + ogden::INT + high_frequency::INT + early_aoa::INT + high_concreteness::INT AS evidence_count,
  admitted_clean::INT + (strict_lemma_seed OR typed_sense_seed)::INT + (strict_lemma_seed::INT + longman::INT + ogden::INT >= 2)::INT + (early_aoa OR high_concreteness)::INT AS channels FROM cand)"""


def candidates(spark, d):
    f = cut(clusters_of(spark, d))
    v = admission.evaluate(f).where("decision = 'admit'").select("ic_id", "aliases").join(f.select("ic_id", F.array_distinct("tags").alias("tags")), "ic_id")
    e = X.entries(spark, d)
    heads = cut(e.groupBy(F.col("lemma").alias("word")).agg(F.count("*").alias("k"), F.max((F.col("pos") == "en").cast("int")).alias("en")))
    lists = {
        "strict": X.table(spark, d, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.lower(x))).alias("word")),
        "typed": heads.where("en = 1").select(F.concat(F.lit("ic:"), "word").alias("ic_id")),
        "longman": heads.where("k > 1"),
        "ogden": heads.where("length(word) <= 6"),
    }
    return cut(evidence.l0(evidence.candidates(v, X.norms(spark, d), lists)))


@query("evidence_channels", X.sql("SELECT ic_id, clean_candidate, strict_lemma_seed, typed_sense_seed, longman, ogden, high_frequency, early_aoa, high_concreteness, evidence_count FROM lz", EVID))
def evidence_channels(spark, d):
    return candidates(spark, d).select("ic_id", "clean_candidate", "strict_lemma_seed", "typed_sense_seed", "longman", "ogden", "high_frequency", "early_aoa", "high_concreteness", "evidence_count")


@query("l0_gate", X.sql("SELECT ic_id, channels, channels = 4 AS l0_candidate, channels = 3 AS near_miss FROM lz", EVID))
def l0_gate(spark, d):
    return candidates(spark, d).select("ic_id", "channels", "l0_candidate", "near_miss")


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TYPED = EVID + f""",
ty AS MATERIALIZED (SELECT dec.ic_id, dec.lemma AS s, lz.ic_id IS NOT NULL AS known, hd.k > 2 AS in_p2, CASE WHEN lz.ic_id IS NULL THEN [] ELSE dec.tags END AS tg, coalesce(lz.evidence_count, 0) AS ev, first_.tag AS lex
  FROM dec JOIN hd USING (lemma) LEFT JOIN lz USING (ic_id) JOIN (SELECT lemma, arg_min(tag, ord) AS tag FROM lx GROUP BY lemma) first_ USING (lemma)),
bk AS MATERIALIZED (SELECT *, CASE
 WHEN (in_p2 AND lex IN ('symbol-code', 'abbreviation')) OR list_has_any(tg, ['symbol-code', 'abbreviation']) OR regexp_matches(s, '[0-9]') OR (length(s) <= 2 AND NOT known AND NOT in_p2) THEN 'abbreviation_or_code'
 WHEN (in_p2 AND lex = 'proper-name') OR list_contains(tg, 'proper-name') OR s IN {_list(evidence.NAMES)} THEN 'proper_name'
 WHEN (in_p2 AND lex = 'taxon') OR list_contains(tg, 'taxon') OR regexp_matches(s, '(aceae|idae|inae|ales|phyta|mycota|opsida)$') THEN 'taxon'
 WHEN list_contains(tg, 'technical-term') OR s IN {_list(evidence.TECHNICAL)} OR regexp_matches(s, '(ectomy|emia|itis|ose|ide|ate)$') THEN 'technical_term'
 WHEN NOT known AND NOT in_p2 THEN 'resource_specific_tail'
 WHEN ev <= 1 AND NOT in_p2 THEN 'resource_specific_tail'
 WHEN s IN {_list(evidence.REGISTER)} OR {" OR ".join(f"(s LIKE '%{x}' AND length(s) > {n} AND left(s, length(s) - {len(x)}) IN (SELECT lemma FROM dec))" for x, n in evidence.STEMS.items())} THEN 'morphology_register_artifact'
 ELSE 'plausible_missing_primitive' END AS bucket FROM ty)"""


def typed(spark, d):
    c = candidates(spark, d)
    f = cut(clusters_of(spark, d))
    e = X.entries(spark, d)
    p2 = e.groupBy("lemma").count().where("count > 2").select(F.concat(F.lit("ic:"), "lemma").alias("ic_id"), F.lit(True).alias("in_p2"))
    rows = f.select("ic_id", F.get("tags", F.lit(0)).alias("first"), F.array_distinct("tags").alias("t")).join(c.select("ic_id", "flags", "evidence_count", F.lit(True).alias("known")), "ic_id", "left").join(p2, "ic_id", "left").fillna(False, ["known", "in_p2"])
    none = F.array().cast("array<string>")
    rows = rows.select("ic_id", "known", "in_p2", F.coalesce("flags", none).alias("flags"), F.when(F.col("known"), F.col("t")).otherwise(none).alias("tags"), "evidence_count", F.when(F.col("in_p2"), F.col("first")).alias("lexicality"))
    return c, cut(evidence.typed_bucket(rows, f.select(T.surface_of_ic(F.col("ic_id")).alias("surface"))))


@query("typed_bucket", X.sql("SELECT ic_id, bucket FROM bk", TYPED))
def typed_bucket(spark, d):
    return typed(spark, d)[1].select("ic_id", "bucket")


PRESS = TYPED + """,
pr AS MATERIALIZED (SELECT bk.ic_id, bk.s, coalesce(lz.channels = 4, false) AS l0_candidate, CASE
 WHEN bucket IN ('abbreviation_or_code', 'proper_name', 'technical_term', 'morphology_register_artifact') AND hf THEN 'common_vocabulary'
 WHEN bucket IN ('abbreviation_or_code', 'proper_name', 'taxon', 'technical_term', 'morphology_register_artifact') THEN 'resource_artifact'
 WHEN core AND (coalesce(lz.channels = 4, false) OR coalesce(clean_candidate, false)) THEN 'primitive_candidate'
 WHEN core AND hf THEN 'assembler_helper' WHEN core THEN 'circular_dependency'
 WHEN bucket = 'resource_specific_tail' OR (staged AND NOT in_p2) THEN 'external_substrate'
 WHEN in_p2 AND hf AND ea THEN 'base_promotable_terminal_common' ELSE 'candidate_background' END AS pressure_bucket
 FROM (SELECT bk.*, s IN (SELECT lemma FROM g JOIN f ON f.node = g.src WHERE g.src = g.dst) AS core, s IN (SELECT lemma FROM e WHERE pos = 'de') AS staged, coalesce(no.frequency >= 5, false) AS hf, coalesce(no.age_of_acquisition <= 6, false) AS ea FROM bk LEFT JOIN norms no ON no.word = bk.s) bk LEFT JOIN lz USING (ic_id))"""


def pressure(spark, d):
    c, b = typed(spark, d)
    e = X.entries(spark, d)
    ic = lambda c: F.concat(F.lit("ic:"), c).alias("ic_id")
    loops = X.edges(spark, d).where("src = dst").select(ic(T.lemma_of(F.col("src"))))
    sources = {"l0_candidate": c.where("l0_candidate").select("ic_id"), "p2_seed": b.where("in_p2").select("ic_id"), "staged_seed": e.where("pos = 'de'").select(ic(F.col("lemma"))).distinct(), "obstruction_core": loops}
    return cut(evidence.pressure_table(sources, c, b, X.norms(spark, d)))


@query("pressure_table", X.sql("SELECT ic_id, l0_candidate, pressure_bucket FROM pr", PRESS))
def pressure_table(spark, d):
    return pressure(spark, d).select("ic_id", "l0_candidate", "pressure_bucket")


#: A sense with more classes in its closure is marked truncated, as by the operator's default.
ROUNDS, MAX_IDS = 16, 500
GROUND = PRESS + DEG + SEED + _layers_sql(ROUNDS) + f""",
sn AS MATERIALIZED (SELECT l.node, lemma AS ic, layer FROM l{ROUNDS} l JOIN f USING (node)),
sic AS MATERIALIZED (SELECT DISTINCT ic FROM sn WHERE layer = 0),
de AS MATERIALIZED (SELECT a.node AS src, a.ic AS sic, b.node AS dst FROM g JOIN sn a ON a.node = g.src JOIN sn b ON b.node = g.dst WHERE a.ic <> b.ic AND b.ic NOT IN (SELECT ic FROM sic)),
cl AS MATERIALIZED (WITH RECURSIVE q AS (SELECT node, ic FROM (SELECT node, ic FROM sn WHERE ic IN (SELECT ic FROM sic) UNION SELECT dst, sic FROM de) UNION SELECT de.dst, q.ic FROM q JOIN de ON de.src = q.node) SELECT * FROM q),
sz AS MATERIALIZED (SELECT sn.node, sn.ic, layer, coalesce(k, 0) AS closure_size, coalesce(k, 0) > {MAX_IDS} AS truncated FROM sn LEFT JOIN (SELECT node, count(*) AS k FROM cl GROUP BY node) USING (node)),
gb AS MATERIALIZED (SELECT s AS ic FROM pr WHERE l0_candidate), gr0 AS (SELECT ic FROM gb)""" + "".join(f""",
gr{k} AS MATERIALIZED (SELECT ic FROM gr{k - 1} UNION SELECT ic FROM sz WHERE NOT truncated AND node NOT IN (SELECT dst FROM de WHERE sic NOT IN (SELECT ic FROM gr{k - 1})))""" for k in range(1, ROUNDS + 1)) + f""",
gd AS MATERIALIZED (SELECT ic FROM gr{ROUNDS}),
st AS MATERIALIZED (SELECT sz.*, CASE WHEN truncated THEN 'graph_data' WHEN m IS NULL THEN 'closed' WHEN a THEN 'artifact' WHEN c THEN 'circular' WHEN x THEN 'external' ELSE 'background' END AS status, CASE WHEN truncated THEN 0 ELSE coalesce(m, 0) END AS missing
 FROM sz LEFT JOIN (SELECT node, count(*) AS m, bool_or(pressure_bucket = 'resource_artifact') AS a, bool_or(pressure_bucket = 'circular_dependency') AS c, bool_or(pressure_bucket = 'external_substrate') AS x FROM cl LEFT JOIN pr ON pr.s = cl.ic WHERE cl.ic NOT IN (SELECT ic FROM gd) GROUP BY node) USING (node)),
bd AS MATERIALIZED (SELECT band, status, count(*) AS n FROM (SELECT status, unnest(list_filter([CASE WHEN closure_size <= 50 THEN 'closure_size_le_50' END, CASE WHEN closure_size <= 100 THEN 'closure_size_le_100' END, CASE WHEN closure_size <= 200 THEN 'closure_size_le_200' END, 'all_targets'], lambda z: z IS NOT NULL)) AS band FROM st) GROUP BY ALL)"""


class Grounding:
    """What the grounding queries share, each part made once a call."""

    def __init__(self, spark, d):
        g = cut(X.edges(spark, d))
        deg = cut(structure.degrees(g))
        n = deg.count()
        seed = deg.withColumn("rk", F.row_number().over(W.orderBy(F.desc("degree"), "node"))).where(F.col("rk") <= n // 2).select("node")
        layer = structure.layers(g, structure.all_nodes(g), seed)
        self.senses = cut(layer.join(X.first_entries(spark, d).select("node", F.col("lemma").alias("ic")), "node"))
        seed_ics = cut(self.senses.where("layer = 0").select("ic").distinct())
        self.closure, self.seed_closure = ground.unfold(self.senses, g, seed_ics)
        self.rows = cut(ground.index_rows(self.senses, self.closure, self.seed_closure, MAX_IDS))
        a, b = self.senses.select(F.col("node").alias("src"), F.col("ic").alias("ic")), self.senses.select(F.col("node"), F.col("ic").alias("own"))
        inner = g.join(a, "src").join(b.withColumnRenamed("node", "dst"), "dst").where("ic <> own").join(seed_ics.withColumnRenamed("ic", "own"), "own", "left_anti")
        self.definers = cut(inner.select(F.col("dst").alias("node"), "ic"))

    def judge(self, press):
        press = press.withColumn("ic", T.surface_of_ic(F.col("ic_id")))
        base, more = ground.bases(press)
        s = self.rows.select("node", "ic", "closure_size", F.col("closure_truncated").alias("truncated"))
        known = cut(ground.groundable(base, s, self.definers))
        return press, base, more, s, known, cut(ground.status(s, self.closure, known, press))


@query("unfold_closure_sizes", X.sql("SELECT node, closure_size FROM sz", GROUND))
def unfold(spark, d):
    return Grounding(spark, d).rows.select("node", "closure_size")


@query("unfold_size_summary", X.sql("SELECT median(closure_size) AS median, max(closure_size) AS largest, max(closure_size) FILTER (r = round_even((c - 1) * 0.9, 0)) AS p90 FROM (SELECT closure_size, row_number() OVER (ORDER BY closure_size) - 1 AS r, count(*) OVER () AS c FROM sz)", GROUND))
def unfold_summary(spark, d):
    return ground.size_summary(Grounding(spark, d).rows)


@query("groundable_fixpoint", X.sql("SELECT ic FROM gd", GROUND))
def groundable(spark, d):
    return Grounding(spark, d).judge(pressure(spark, d))[4]


@query("sense_status", X.sql("SELECT node, ic, closure_size, status, missing FROM st", GROUND))
def sense_status(spark, d):
    return Grounding(spark, d).judge(pressure(spark, d))[5].drop("trivial")


@query("sense_status_bands", X.sql("SELECT * FROM bd", GROUND))
def status_bands(spark, d):
    return ground.bands(Grounding(spark, d).judge(pressure(spark, d))[5])


@query("closure_rates", X.sql("SELECT band, coalesce(sum(n) FILTER (status = 'closed'), 0) AS closed, coalesce(sum(n) FILTER (status <> 'graph_data'), 0) AS total, round(coalesce(sum(n) FILTER (status = 'closed') / sum(n) FILTER (status <> 'graph_data'), 0), 6) AS rate FROM bd GROUP BY band", GROUND))
def closure_rates(spark, d):
    return ground.rates(ground.bands(Grounding(spark, d).judge(pressure(spark, d))[5])).withColumn("rate", F.round("rate", 6))


@query("blocker_counts", X.sql("SELECT ic, count(*) AS n FROM cl JOIN (SELECT node FROM st WHERE status <> 'graph_data') USING (node) WHERE ic NOT IN (SELECT ic FROM gd) GROUP BY ic", GROUND))
def blocker_counts(spark, d):
    g = Grounding(spark, d)
    _, _, _, _, known, rows = g.judge(pressure(spark, d))
    return ground.blockers(rows, g.closure, known)


@query("base_usage", X.sql("SELECT ic, count(*) AS n FROM cl JOIN (SELECT node FROM st WHERE status = 'closed') USING (node) WHERE ic IN (SELECT ic FROM gb) GROUP BY ic", GROUND))
def base_usage(spark, d):
    g = Grounding(spark, d)
    _, base, _, _, _, rows = g.judge(pressure(spark, d))
    return ground.usage(rows, g.closure, base)


@query("status_entropy", X.sql("SELECT band, round(entropy(status), 6) AS h, count(*) AS rows, count(DISTINCT status) AS k FROM (SELECT band, status, unnest(range(0, n)) FROM bd) GROUP BY band", GROUND))
def status_entropy(spark, d):
    e = ground.entropy(ground.bands(Grounding(spark, d).judge(pressure(spark, d))[5]), by=["band"])
    return e.select("band", F.round("h", 6).alias("h"), "rows", "k")


@query("containment_audit", X.sql("SELECT pressure_bucket, count(*) AS ics, coalesce(sum(k), 0) AS contained FROM pr LEFT JOIN (SELECT ic, count(*) AS k FROM cl GROUP BY ic) c ON c.ic = pr.s GROUP BY pressure_bucket", GROUND))
def containment(spark, d):
    g, p = Grounding(spark, d), pressure(spark, d).withColumn("ic", T.surface_of_ic(F.col("ic_id")))
    return ground.containment(g.closure, g.rows, p)


@query("bucket_migration", X.sql("SELECT bucket AS before, pressure_bucket AS after, count(*) AS n FROM bk JOIN pr USING (ic_id) GROUP BY ALL", PRESS))
def migration(spark, d):
    p = pressure(spark, d)
    return ground.migration(p.select("ic_id", F.col("typed_bucket").alias("b")), p.select("ic_id", F.col("pressure_bucket").alias("b")), "ic_id", "b")


@query("grounding_yield")
def grounding_yield(spark, d):
    g = Grounding(spark, d)
    press, base, more, s, _, before = g.judge(pressure(spark, d))
    after = ground.status(s, g.closure, cut(ground.groundable(more, s, g.definers)), press)
    return ground.yield_of(before, after, base, more)


KR = X.NORMS + X.REACH + DEG + """,
kr AS MATERIALIZED (SELECT deg.node AS node_id, lemma, pos, definition AS gloss, degree, frequency, age_of_acquisition, concreteness, CASE WHEN deg.node IN (SELECT node FROM kernel) THEN 0 ELSE 1 END AS layer FROM deg JOIN f USING (node) LEFT JOIN norms ON word = lemma)"""


def rows_of(spark, d):
    """Exported rows; kernel nodes count as layer 0 and seed, the others as layer 1."""
    g = cut(X.edges(spark, d))
    k = structure.kernel(g).withColumn("k", F.lit(True))
    m = structure.all_nodes(g).join(k, "node", "left").select("node", F.when(F.col("k"), 0).otherwise(1).alias("layer"), F.coalesce("k", F.lit(False)).alias("is_seed"), F.coalesce("k", F.lit(False)).alias("is_core"))
    nodes = X.first_entries(spark, d).select("node", F.col("definition").alias("gloss"))
    return g, cut(export.kernel_rows(m, nodes, g, X.norms(spark, d)))


@query("kernel_rows_ranked", X.sql("SELECT node_id, layer, row_number() OVER (PARTITION BY layer ORDER BY frequency DESC NULLS LAST, age_of_acquisition ASC NULLS LAST, degree DESC, node_id) AS position FROM kr", KR))
def kernel_rows_ranked(spark, d):
    return export.top_per_layer(rows_of(spark, d)[1], 1 << 30).select("node_id", "layer", "position")


@query("seed_surfaces", X.sql("SELECT lemma, count(*) AS seed_node_count, string_agg(node_id, ';' ORDER BY node_id) AS source_node_ids, string_agg(DISTINCT pos, ';' ORDER BY pos) AS parts_of_speech, max(degree) AS max_degree_score, max(frequency) AS best_frequency, min(age_of_acquisition) AS earliest_age_of_acquisition, avg(concreteness) AS mean_concreteness FROM kr WHERE layer = 0 GROUP BY lemma", KR))
def seed_surfaces(spark, d):
    return export.seed_surfaces(rows_of(spark, d)[1]).drop("surface_word")


@query("suspicion_reasons", X.sql("SELECT node_id, array_to_string(list_filter([CASE WHEN frequency IS NULL THEN 'missing_frequency' END, CASE WHEN age_of_acquisition IS NULL THEN 'missing_age_of_acquisition' END, CASE WHEN concreteness IS NULL THEN 'missing_concreteness' END, CASE WHEN node_id IN (SELECT src FROM g WHERE src = dst) THEN 'self_loop' END, CASE WHEN regexp_matches(lower(gloss), 'genus|family|taxonomic|city|province') THEN 'domain_or_named_entity_like' END], lambda z: z IS NOT NULL), ';') AS reasons FROM kr", KR))
def suspicion(spark, d):
    g, r = rows_of(spark, d)
    return export.suspicion(r, g).select("node_id", F.array_join("reasons", ";").alias("reasons"))


LONG = X.NORMS + ", an AS (SELECT word AS key, unnest(['frequency', 'age_of_acquisition', 'concreteness']) AS field, unnest([frequency, age_of_acquisition, concreteness]) AS value FROM norms)"


def annotations(spark, d):
    return X.norms(spark, d).select(F.col("word").alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("frequency", "age_of_acquisition", "concreteness")])).alias("x")).select("key", "x.*")


@query("annotation_coverage", X.sql("SELECT field, count(value) AS covered, count(*) AS total, round(count(value) / count(*), 6) AS fraction FROM n JOIN f USING (node) JOIN an ON an.key = f.lemma GROUP BY field", LONG))
def coverage(spark, d):
    return export.coverage(structure.all_nodes(X.edges(spark, d)), annotations(spark, d)).withColumn("fraction", F.round("fraction", 6))


@query("component_annotation_summary", X.sql("SELECT pos AS component, field, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM f JOIN an ON an.key = f.lemma GROUP BY ALL", LONG))
def component_summary(spark, d):
    m = X.first_entries(spark, d).select(F.col("pos").alias("component"), "node")
    return export.component_summary(m, annotations(spark, d)).withColumn("mean", F.round("mean", 6))


@query("set_overlap", """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT (SELECT count(*) FROM a) AS left_n, (SELECT count(*) FROM b) AS right_n, count(*) AS common, round(count(*) / (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)), 6) AS jaccard FROM a JOIN b USING (w)""")
def set_overlap(spark, d):
    w = lambda t: X.table(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return export.overlap(w("benchmark"), w("documents"), "w").select("left_n", "right_n", "common", F.round("jaccard", 6).alias("jaccard"))


@query("summary_comparison", X.sql("SELECT metric, l AS left_value, r AS right_value, r - l AS difference FROM (SELECT unnest(['nodes', 'edges', 'loops']) AS metric, unnest([(SELECT count(*) FROM n), (SELECT count(*) FROM g), (SELECT count(*) FROM g WHERE src = dst)]) AS l, unnest([(SELECT count(*) FROM kernel), (SELECT count(*) FROM ke), (SELECT count(*) FROM ke WHERE src = dst)]) AS r)", X.REACH))
def summary_comparison(spark, d):
    from glossweave.operators import build

    g = cut(X.edges(spark, d))
    k = cut(structure.kernel(g))

    def table(e, n):
        a = n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops")))
        return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("nodes", "edges", "loops")])).alias("x")).select("x.*")

    return export.compare(table(g, structure.all_nodes(g)), table(build.induced(g, k), k))


@query("resolver_verdict", X.sql("SELECT CASE WHEN k < c AND abs(k - c) / c >= 0.2 THEN '(i)' WHEN abs(k - c) / c < 0.2 THEN '(ii)' ELSE '(iii)' END AS verdict FROM (SELECT (SELECT count(*) FROM kernel) AS k, (SELECT count(*) FROM n) AS c)", X.REACH))
def verdict(spark, d):
    g = cut(X.edges(spark, d))
    r = structure.kernel(g).agg(F.count("*").alias("k")).crossJoin(structure.all_nodes(g).agg(F.count("*").alias("c")))
    return r.select(export.resolver_verdict(F.col("k"), F.col("c")).alias("verdict"))


@query("prf_by_class", "SELECT q AS label, round(coalesce(tp / nullif(pn, 0), 0), 6) AS precision, round(tp / gn, 6) AS recall, gn AS support FROM (SELECT quality AS q, count(*) AS gn, count(*) FILTER (quality = 1 - toxic) AS tp, (SELECT count(*) FROM labels b WHERE 1 - b.toxic = a.quality) AS pn FROM labels a GROUP BY quality)")
def prf(spark, d):
    r = X.table(spark, d, "labels").select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("pred"))
    return lexicality.prf(r).select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("confusion_pivot", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%') AS first, count(*) FILTER (o_orderpriority LIKE '2%') AS second FROM orders GROUP BY o_orderstatus")
def confusion(spark, d):
    r = X.table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "first").when(F.col("o_orderpriority").startswith("2"), "second").alias("p"))
    return lexicality.confusion(r, "o_orderstatus", "p", ["first", "second"])


@query("stratified_sample", "SELECT lang, least(count(*), 20) AS n FROM documents GROUP BY lang")
def stratified(spark, d):
    r = X.table(spark, d, "documents").select("doc_id", "lang")
    return lexicality.stratified(r, "lang", {"en": 20, "de": 20, "fr": 20, "es": 20}, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("fold_sizes", "SELECT lang, f AS fold, count(*) AS n FROM (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS f FROM documents) GROUP BY ALL")
def fold_sizes(spark, d):
    return lexicality.folds(X.table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang", "fold").agg(F.count("*").alias("n"))


@query("zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def zscore(spark, d):
    return stats.zscore(X.table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


@query("distribution", "SELECT count(*) AS n, count(*) FILTER (p_size = 0) AS zeros, max(p_size) AS largest, avg(p_size) AS mean, median(p_size) AS median, max(p_size) FILTER (r = floor(c * 0.25)) AS q25, max(p_size) FILTER (r = floor(c * 0.9)) AS q90 FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS r, count(*) OVER () AS c FROM part)")
def distribution(spark, d):
    return stats.distribution(X.table(spark, d, "part"), "p_size", (0.25, 0.9))


@query("low_degree_counts", X.sql("SELECT degree, count(*) AS n FROM deg WHERE degree BETWEEN 0 AND 15 GROUP BY degree", DEG))
def low_degrees(spark, d):
    return stats.low_counts(structure.degrees(X.edges(spark, d)), "degree")


@query("ols_r2_single", "SELECT count(*) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def ols_single(spark, d):
    m = stats.ols(X.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(m["n"], round(m["r2"], 6), round(m["coefficients"]["l_quantity"], 4))], "n long, r2 double, slope double")


@query("ols_r2_multi")
def ols_multi(spark, d):
    m = stats.ols(X.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(m["n"], round(m["r2"], 6))], "n long, r2 double")


@query("one_hot_counts", "SELECT count(*) FILTER (lang = 'en') AS lang_en, count(*) FILTER (lang = 'es') AS lang_es, count(*) FILTER (lang = 'fr') AS lang_fr FROM documents")
def one_hot(spark, d):
    t = stats.one_hot(X.table(spark, d, "documents"), "lang", ["de", "en", "es", "fr"])
    return t.agg(*[F.sum(f"lang_{x}").alias(f"lang_{x}") for x in ("en", "es", "fr")])


@query("logit_auc")
def logit(spark, d):
    t = X.table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    m = stats.logit(t, "y", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(m["auc"], 4), round(m["mcfadden_r2"], 6))], "auc double, r2 double")


@query("poisson_pseudo_r2")
def poisson(spark, d):
    return spark.createDataFrame([(round(stats.poisson_r2(X.table(spark, d, "lineitem"), "l_quantity", ["l_extendedprice"]), 6),)], "r2 double")


@query("degree_mixture_bic")
def mixture(spark, d):
    return spark.createDataFrame([(k, round(b, 2)) for k, b in stats.gaussian_mixture_bic(structure.degrees(X.edges(spark, d)), "degree")], "k int, bic double")


@query("gloss_model_accuracy")
def gloss_model(spark, d):
    """Held-in accuracy of the gloss model telling the languages of benchmark passages by their first letter."""
    rows = X.table(spark, d, "benchmark").select(F.col("text").alias("gloss"), F.when(F.lower(F.left("text", F.lit(1))) < "m", "low").otherwise("high").alias("label"))
    m = lexicality.gloss_model(rows)
    p = m.transform(lexicality.with_grams(rows))
    return p.agg((F.avg((F.col("prediction") == F.col("__y")).cast("double")) > 0.5).alias("better_than_chance"))


@query("kleene_truth_table", """WITH v AS (SELECT unnest([true, false, NULL]) AS a), w AS (SELECT unnest([true, false, NULL]) AS b)
SELECT coalesce(a::VARCHAR, 'unknown') AS a, coalesce(b::VARCHAR, 'unknown') AS b, coalesce((a AND b)::VARCHAR, 'unknown') AS both, coalesce((a OR b)::VARCHAR, 'unknown') AS either, coalesce((NOT a)::VARCHAR, 'unknown') AS negated FROM v, w""")
def kleene(spark, d):
    binds = {"is": lambda x, k: F.get(x, F.lit(k))}
    three = F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    t = spark.range(1).select(F.explode(three).alias("a")).crossJoin(spark.range(1).select(F.explode(three).alias("b")))
    v, a, b = F.array("a", "b"), logic.Predicate("is", 0), logic.Predicate("is", 1)
    show = lambda e: F.coalesce(logic.compile_to_column(e, {}, v, binds).cast("string"), F.lit("unknown"))
    return t.select(show(a).alias("a"), show(b).alias("b"), show(logic.And(a, b)).alias("both"), show(logic.Or(a, b)).alias("either"), show(logic.Not(a)).alias("negated"))


@query("kleene_over_columns", "SELECT l_orderkey, l_linenumber, NOT (l_linenumber % 2 = 0) AS odd, (l_linenumber > 0 OR l_linenumber = 0) AS nonnegative FROM lineitem")
def kleene_columns(spark, d):
    v = F.col("l_linenumber")
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[logic.compile_to_column(logic.Reference(s), logic.NUMERIC, v).alias(s) for s in ("odd", "nonnegative")])


@query("numeric_experiment", "SELECT 'typed' AS arm, 'held_out' AS split, 9900 AS n, 0 AS errors, 0 AS unknown UNION ALL SELECT 'wrong_binding', 'held_out', 9900, 5940, 990 UNION ALL SELECT 'erased', 'held_out', 9900, 2970, 0")
def numeric_experiment(spark, d):
    return logic.experiment(spark).where("split = 'held_out'")


@query("horn_grounding", X.sql("SELECT ic AS atom FROM gd", GROUND))
def horn_grounding(spark, d):
    """Groundability again, as Horn rules: a sense is a rule whose head is its class and whose body are its definers."""
    from glossweave.operators import argument

    g = Grounding(spark, d)
    _, base, _, s, _, _ = g.judge(pressure(spark, d))
    body = g.definers.groupBy("node").agg(F.collect_set("ic").alias("body"))
    rules = s.where("not truncated").join(body, "node", "left").select(F.col("node").alias("rule_id"), F.col("ic").alias("head"), F.coalesce("body", F.array().cast("array<string>")).alias("body"))
    return argument.horn(rules, base.select(F.col("ic").alias("atom")))


@query("event_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from glossweave.streaming import ingest

    return ingest.event_rates(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
