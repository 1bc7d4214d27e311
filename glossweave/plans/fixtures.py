"""Definition graphs out of the driver's tables, and the same as SQL.

A document is an entry: its first token is the lemma, its language the part of
speech, the rest of its text the gloss, its id the order. The first entry of a
lemma and language stands for the node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text as T
from glossweave.functions.words import STOPWORDS, TOKEN

REST = rf"(?s)^[^A-Za-z]*{TOKEN}(.*)$"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """``ord, lemma, pos, form, definition, gloss, source, n_chars``."""
    # the first token by itself, so that who needs no gloss does not have every text cut into tokens
    t = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("pos"), "text", "source", "n_chars", F.regexp_extract("text", TOKEN, 0).alias("form")).where("form <> ''")
    w = F.transform(T.raw_tokens(F.col("text")), T.plain_token)
    return t.select("ord", T.plain_token(F.col("form")).alias("lemma"), "pos", "form", F.regexp_extract("text", REST, 1).alias("definition"), F.slice(w, F.lit(2), F.size(w)).alias("gloss"), "source", "n_chars")


def first_entries(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    f = e.groupBy("lemma", "pos").agg(F.min_by(F.struct("ord", "gloss", "definition"), "ord").alias("f"))
    return f.select("lemma", "pos", T.node_key(F.col("lemma"), F.col("pos")).alias("node"), "f.ord", "f.gloss", "f.definition")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A token of a gloss that is itself a lemma of the language defines the entry."""
    f = first_entries(spark, d)
    uses = f.select(F.col("node").alias("dst"), "pos", F.explode(F.array_distinct("gloss")).alias("lemma"))
    return uses.join(f.select("lemma", "pos", F.col("node").alias("src")), ["lemma", "pos"]).select("src", "dst").distinct()


def senses(spark: SparkSession, d: str) -> DataFrame:
    """Every entry as a sense: ``node, lemma, pos, rank, definition``."""
    return entries(spark, d).select(F.concat(F.lit("s"), F.col("ord").cast("string")).alias("node"), "lemma", "pos", F.col("ord").alias("rank"), "definition")


def norms(spark: SparkSession, d: str) -> DataFrame:
    """Per lemma: a frequency, an age and a concreteness out of counts (fixed rules, so that SQL can state them)."""
    n = entries(spark, d).groupBy(F.col("lemma").alias("word")).agg(F.count("*").alias("k"), F.sum("n_chars").alias("c"))
    return n.select("word", F.when(F.col("c") % 5 != 0, 1.0 + F.col("k")).alias("frequency"), F.when(F.col("c") % 7 != 0, (3 + F.col("c") % 9).cast("double")).alias("age_of_acquisition"), F.when(F.col("c") % 3 != 0, (1 + F.col("c") % 5).cast("double")).alias("concreteness"))


def user_attacks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Small frameworks, one a user: event types attack the type that follows them."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    name = lambda c: F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col(c))
    return e.select(name("event_type").alias("node")).distinct(), e.where("next is not null").select(name("event_type").alias("src"), name("next").alias("dst")).distinct()


_T = TOKEN.replace("'", "''")
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
BASE = f"""
t AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, text, regexp_extract_all(text, '{_T}') AS raw FROM documents),
e AS MATERIALIZED (SELECT doc_id AS ord, lang AS pos, source, n_chars, raw[1] AS form, replace(lower(raw[1]), '''', '') AS lemma,
  list_transform(raw[2:], lambda x: replace(lower(x), '''', '')) AS gloss, text,
  regexp_extract(text, '{REST.replace("'", "''")}', 1) AS definition FROM t WHERE len(raw) > 0),
k AS (SELECT lemma, pos, min(ord) AS ord FROM e GROUP BY ALL),
f AS MATERIALIZED (SELECT k.lemma, k.pos, k.lemma || '::' || k.pos AS node, k.ord, e.gloss, e.definition FROM k JOIN e USING (ord, lemma, pos)),
u AS (SELECT node, pos, unnest(list_distinct(gloss)) AS tok FROM f),
g AS MATERIALIZED (SELECT DISTINCT s.node AS src, u.node AS dst FROM u JOIN f s ON s.lemma = u.tok AND s.pos = u.pos),
n AS MATERIALIZED (SELECT src AS node FROM g UNION SELECT dst FROM g)"""
REACH = """,
r AS MATERIALIZED (WITH RECURSIVE p AS (SELECT src, dst FROM g UNION SELECT p.src, g.dst FROM p JOIN g ON p.dst = g.src) SELECT * FROM p),
kernel AS MATERIALIZED (SELECT DISTINCT src AS node FROM r WHERE dst IN (SELECT src FROM r WHERE src = dst)),
ke AS MATERIALIZED (SELECT g.* FROM g JOIN kernel a ON a.node = g.src JOIN kernel b ON b.node = g.dst),
scc AS MATERIALIZED (SELECT n.node, least(n.node, coalesce(min(m.low), n.node)) AS scc FROM n LEFT JOIN
  (SELECT a.src AS node, a.dst AS low FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) m USING (node) GROUP BY n.node),
se AS MATERIALIZED (SELECT g.*, a.scc AS s, b.scc AS d FROM g JOIN scc a ON a.node = g.src JOIN scc b ON b.node = g.dst)"""
NORMS = """,
norms AS (SELECT lemma AS word, CASE WHEN c % 5 <> 0 THEN 1.0 + k END AS frequency, CASE WHEN c % 7 <> 0 THEN (3 + c % 9)::DOUBLE END AS age_of_acquisition,
  CASE WHEN c % 3 <> 0 THEN (1 + c % 5)::DOUBLE END AS concreteness FROM (SELECT lemma, count(*) AS k, sum(n_chars)::BIGINT AS c FROM e GROUP BY lemma))"""


def sql(tail: str, more: str = "") -> str:
    return f"WITH {BASE}{more}\n{tail}"
