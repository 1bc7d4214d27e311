"""Lexicality: ordered surface rules, the keyword fallback, a gloss model, and how to judge them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossweave.functions import text as T

# What the rules look for.
SHORT_WORDS = "a i s am an as at ax axe be by do go he if in is it me my no of on or ox so to up us we".split()
ABBREVIATION = r"(?i)\b(abbreviation|abbreviated|acronym|initialism|short for|stands for)\b"
FORMULA = r"[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*)+"
IDIOM = r"(?i)\b(idiomatic|idiomatically|an idiom\b|a colloquial expression|a fixed expression|used to express|an exclamation|an interjection)\b"
DISCIPLINES = (
    "computer science", "mathematics", "mathematical", "mathematician", "physics", "linguistics", "linguistic", "logic", "medicine",
    "medicinal", "law", "music", "musical", "musician", "grammar", "geology", "geological", "economics",
    "economic", "astronomy", "astronomical", "heraldry", "computing", "programming", "programmer", "technical", "taxonomic",
    "trigonometry", "stratigraphy", "biological", "theological", "psychological", "histological", "chemical",
)
DOMAIN_TAGS = (
    "math", "mathematics", "physics", "chemistry", "biology", "astronomy", "geology", "music", "economics", "linguistics",
    "law", "medicine", "computing", "grammar", "statistics", "logic", "trademark", "architecture", "heraldry", "theology",
)
TECHNICAL = rf"(?i)(?:\b(?:{'|'.join(DISCIPLINES)})\b|\((?:{'|'.join(DOMAIN_TAGS)})\))"
CHEMICAL_WORDS = ("chemical element", "chemical symbol", "atomic number", "metallic element", "radioactive metallic element", "nonmetallic element", "noble gas", "element of the", "nobelium", "sulfur", "sulphur")
TAXON_WORDS = ("taxonomic group", "taxonomic category", "genus of", "family of", "order of", "class of", "phylum of", "species of", "subspecies of", "type genus")
TECHNICAL_WORDS = ("computer science", "in mathematics", "in physics", "in linguistics", "in logic", "in medicine", "in law", "in music", "in grammar")
POS_WITH_WORDS = ("a", "n", "r", "s", "v")
CONFIDENT = 0.40


def surface(lemma: Column, form: Column, gloss: Column) -> Column:
    """``(tag, reason)`` of the first rule that fires, or null. ``lemma`` is normalised, ``form`` as written."""
    n, case = F.length(F.replace(lemma, F.lit("_"), F.lit(""))), T.case_pattern(form)
    rules = [
        (gloss.rlike(ABBREVIATION), "abbreviation", "surface.abbreviation"),
        (F.trim(form).rlike(f"^(?:{FORMULA})$"), "chemical", "surface.chemical_formula"),
        ((n <= 3) & (case == "lower") & lemma.isin(*SHORT_WORDS), "lexical-word", "surface.short_token_whitelist"),
        (n == 1, "symbol-code", "surface.single_character"),
        ((n <= 3) & ~case.isin("lower", "uncased"), "symbol-code", "surface.short_token_case_rejected"),
        (case.isin("upper", "mixed") & (n <= 5), "symbol-code", "surface.code_case"),
        (n <= 3, "symbol-code", "surface.short_token_unlisted"),
        (gloss.rlike(TECHNICAL), "technical-term", "surface.technical_domain"),
        (gloss.rlike(IDIOM) & lemma.contains("_"), "construction", "surface.construction_idiomatic"),
        (gloss.rlike(IDIOM), "idiom", "surface.idiom"),
    ]
    return _first(rules)


def fallback(pos: Column, gloss: Column, definition: Column) -> Column:
    """``(tag, reason)`` by keywords, where there is no model."""
    has = lambda words: F.lower(gloss).rlike("|".join(words))
    return _first([
        (has(CHEMICAL_WORDS) | definition.rlike(FORMULA), "chemical", "fallback.chemical_keyword"),
        (has(TAXON_WORDS), "taxon", "fallback.taxon_keyword"),
        (has(TECHNICAL_WORDS), "technical-term", "fallback.technical_keyword"),
        (pos.isin(*POS_WITH_WORDS), "lexical-word", "fallback.pos_default"),
        (F.lit(True), "uncertain", "fallback.uncertain"),
    ])


def _first(rules: list[tuple[Column, str, str]]) -> Column:
    out = None
    for when, tag, reason in rules:
        value = F.struct(F.lit(tag).alias("tag"), F.lit(reason).alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def classify(senses: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``lexicality, reason`` to ``senses(lemma, pos, definition)``; ``model`` names a column (class, probability) where one was scored."""
    lemma, d = T.normalize_lemma(F.col("lemma")), F.coalesce("definition", F.lit(""))
    gloss = F.trim(F.concat_ws(" ", d, F.array_join("examples", " "))) if "examples" in senses.columns else F.trim(d)
    other = fallback(F.col("pos"), gloss, d)
    if model:
        c, p = F.col(f"{model}.class"), F.col(f"{model}.probability")
        shown = F.format_string("%.2f", p)
        low = F.when(lemma.contains("_"), F.struct(F.lit("phrase").alias("tag"), F.concat(F.lit("trained.lowconf.p"), shown, F.lit(".multiword")).alias("reason"))).otherwise(F.struct(F.lit("uncertain").alias("tag"), F.concat(F.lit("trained.lowconf.p"), shown).alias("reason")))
        sure = F.struct(c.alias("tag"), F.concat(F.lit("trained."), c, F.lit(".p"), shown).alias("reason"))
        other = F.when(p.isNull(), other).when(p >= CONFIDENT, sure).otherwise(low)
    v = senses.withColumn("__v", F.coalesce(surface(lemma, F.col("lemma"), gloss), other))
    return v.select(*senses.columns, F.col("__v.tag").alias("lexicality"), F.col("__v.reason").alias("reason"))


def sublinear(counts: Column) -> Column:
    return F.when(counts > 0, 1 + F.log(counts)).otherwise(0.0)


def tfidf(docs: DataFrame, key: str, terms: Column, min_df: int = 1) -> DataFrame:
    """``key, term, w``: L2-normalised TF-IDF with idf = ln((1 + n) / (1 + df)) + 1, as a long table."""
    tf = docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.select(key).distinct().agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("l")).alias("w"))


def cosine_pairs(weights: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``a, b, cosine`` of the pairs asked for."""
    x, y = weights.select(F.col(key).alias("a"), "term", F.col("w").alias("wa")), weights.select(F.col(key).alias("b"), "term", F.col("w").alias("wb"))
    dots = pairs.select("a", "b").join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.select("a", "b").join(dots, ["a", "b"], "left").fillna(0.0, ["cosine"])


def gloss_model(rows: DataFrame, label: str = "label", c: float = 4.0, features: int = 1 << 15):
    """A fitted pipeline over ``rows(gloss, label)``: word 1-2-grams and character 3-5-grams, hashed, idf-weighted; balanced multinomial logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler

    n = rows.count()
    ready = with_grams(rows)
    balance = W.partitionBy(label)
    kinds = max(1, rows.select(label).distinct().count())
    ready = ready.withColumn("__w", F.lit(n / kinds) / F.count("*").over(balance))
    stages = [StringIndexer(inputCol=label, outputCol="__y")]
    for name in ("words", "chars"):
        stages += [HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=features), IDF(inputCol=f"{name}_tf", outputCol=f"{name}_x", minDocFreq=2)]
    stages += [VectorAssembler(inputCols=["words_x", "chars_x"], outputCol="features"), LogisticRegression(labelCol="__y", weightCol="__w", regParam=1.0 / (c * max(n, 1)), maxIter=50)]
    return Pipeline(stages=stages).fit(ready)


def with_grams(rows: DataFrame) -> DataFrame:
    w = T.basic_tokens(F.col("gloss"))
    two = F.transform(F.filter(F.sequence(F.lit(0), F.size("__t")), lambda i: i < F.size("__t") - 1), lambda i: F.concat_ws(" ", F.get("__t", i), F.get("__t", i + 1)))

    def pieces(t: Column, k: int) -> Column:
        """A word's k-grams, with a blank before and after it."""
        at = F.filter(F.sequence(F.lit(1), F.length(t) + 2), lambda i: i + k <= F.length(t) + 3)
        return F.transform(at, lambda i: F.substring(F.concat(F.lit(" "), t, F.lit(" ")), i, F.lit(k)))

    char = F.flatten(F.transform("__t", lambda t: F.flatten(F.array(*[pieces(t, k) for k in (3, 4, 5)]))))
    return rows.withColumn("__t", w).withColumn("words", F.concat("__t", two)).withColumn("chars", char).drop("__t")


def stratified(rows: DataFrame, stratum: str, targets: dict[str, int], key: str, seed: int = 0) -> DataFrame:
    """Up to the target of each stratum, in the order of a seeded hash of the key."""
    t = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    r = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return rows.withColumn("__r", r).where(F.col("__r") <= F.coalesce(F.try_element_at(t, F.col(stratum)), F.lit(0))).drop("__r")


def folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Adds ``fold``, even within each label."""
    return rows.withColumn("fold", (F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(F.col(key)), key)) - 1) % k)


def prf(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``label, precision, recall, f1, support`` for every label in either column."""
    g, p = rows.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.sum((F.col(gold) == F.col(pred)).cast("long")).alias("tp")), rows.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    j = g.join(p, "label", "full").fillna(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    j = j.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return j.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def averages(table: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 over labels with support, and micro F1, which is accuracy."""
    s = F.col("support") > 0
    return table.agg(*[F.avg(F.when(s, F.col(c))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("micro_f1"))


def confusion(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    return rows.groupBy(gold).pivot(pred, labels).count().fillna(0)


