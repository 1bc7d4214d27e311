"""Text functions as columns: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import STOPWORDS, TOKEN


def normalize_lemma(c: Column) -> Column:
    """Trimmed (any white space), lower case, blanks and hyphens as underscores, no apostrophes."""
    return F.translate(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "- '", "__")


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def plain_token(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("'"), F.lit(""))


def basic_tokens(c: Column) -> Column:
    return F.transform(raw_tokens(c), plain_token)


def is_stopword(c: Column) -> Column:
    return c.isin(*STOPWORDS)


def content_tokens(c: Column) -> Column:
    return F.filter(basic_tokens(c), lambda t: ~is_stopword(t))


def is_titlecase(raw: Column) -> Column:
    """A non-empty array of tokens that all start with a capital."""
    return (F.size(raw) > 0) & F.forall(raw, lambda t: t.rlike("^[A-Z]"))


def wiktextract_pos(c: Column) -> Column:
    p = F.lower(F.trim(c))
    return F.when(p.isin("noun", "name", "proper-noun", "proper noun", "pronoun"), "n").when(p == "verb", "v").when(p.isin("adj", "adjective", "det", "determiner"), "a").when(p.isin("adv", "adverb"), "r").otherwise("x")


def truncate_text(c: Column, limit: int = 72) -> Column:
    """White space collapsed; longer texts end in three dots at the limit."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.left(s, F.lit(limit - 3))), F.lit("..."))).otherwise(s)


def node_key(lemma: Column, pos: Column) -> Column:
    return F.concat_ws("::", lemma, pos)


def split_node(node: Column) -> Column:
    """lemma and pos, at the last ``::``; an error without one."""
    good = F.instr(node, "::") > 0
    pos = F.substring_index(node, "::", -1)
    lemma = F.substring(node, F.lit(1), F.length(node) - F.length(pos) - 2)
    return F.when(good, F.struct(lemma.alias("lemma"), pos.alias("pos"))).otherwise(F.raise_error(F.concat(F.lit("no '::' in "), node)))


def lemma_of(node: Column) -> Column:
    """Up to the first ``::``."""
    return F.substring_index(node, "::", 1)


def ic_of_node(node: Column) -> Column:
    return F.concat(F.lit("ic:"), F.lower(lemma_of(node)))


def surface_of_ic(ic: Column) -> Column:
    return F.regexp_replace(ic, "^ic:", "")


def case_pattern(c: Column) -> Column:
    """Of the letters only: uncased, lower, upper (also one capital), title or mixed."""
    s = F.regexp_replace(c, r"[^\p{L}]", "")
    return F.when(s == "", "uncased").when((s == F.lower(s)) & (s != F.upper(s)), "lower").when((s == F.upper(s)) & (s != F.lower(s)), "upper").when((F.left(s, F.lit(1)) == F.upper(F.left(s, F.lit(1)))) & (F.substring(s, 2, 1 << 30) == F.lower(F.substring(s, 2, 1 << 30))), "title").otherwise("mixed")


def levenshtein_capped(a: Column, b: Column, cap: int) -> Column:
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def gloss_tokens(c: Column, stop: list[str] = STOPWORDS) -> Column:
    return F.array_distinct(F.filter(basic_tokens(c), lambda t: ~t.isin(*stop) & (F.length(t) > 1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def boolish(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def code_like(c: Column) -> Column:
    """Roman numerals, binary units and words without a vowel."""
    return c.rlike("^[ivxlcdm]{2,}$") | c.rlike("^[a-z]i(bit|byte)$") | c.rlike("^[^aeiouy]+$")
