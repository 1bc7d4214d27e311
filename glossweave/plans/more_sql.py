"""SQL for queries whose results need more than a few joins: resolution of senses, spelling variants, small frameworks, regressions."""

from __future__ import annotations

from glossweave.operators import cluster
from glossweave.plans import fixtures as X
from glossweave.plans.graph_queries import SETS, USERS
from glossweave.plans.rule_queries import GROUND, ROUNDS
from glossweave.plans.text_queries import PLAIN, match_sql

SQL: dict[str, str] = {}

SQL["lemma_graph_edges"] = X.sql(
    "SELECT DISTINCT o.c AS src, dl.dst FROM o JOIN dl USING (node)",
    ", dl AS MATERIALIZED (SELECT lemma || '|' || definition AS node, lemma AS dst, definition FROM (SELECT DISTINCT lemma, definition FROM e WHERE definition <> ''))" + match_sql("dl"),
)


def sense_sql(fallback: bool = False, own_lemma: bool = True, node: str = "'s' || ord", edges: bool = False) -> str:
    """Counters (or edges) of the sense graph: a candidate's senses by pos, then by overlap, then (with ``fallback``) by rank."""
    words = PLAIN.replace("text", "definition")
    sig = f"list_distinct(list_concat(list_filter({words}, lambda x: x NOT IN ({X.STOP})), {'[lemma]' if own_lemma else '[]::VARCHAR[]'}))"
    more = f""",
ss AS MATERIALIZED (SELECT {node} AS node, lemma, pos, ord AS rank, definition, {sig} AS sig FROM e WHERE definition <> ''){match_sql("ss", "ss")},
hk AS MATERIALIZED (SELECT node AS target, c AS cand, count(*)::BIGINT AS k FROM o GROUP BY ALL),
ow AS (SELECT hk.target, hk.cand, s.node, s.rank, s.sig, t.sig AS ctx, (s.pos = t.pos)::INT AS same FROM hk JOIN ss s ON s.lemma = hk.cand JOIN ss t ON t.node = hk.target WHERE s.node <> hk.target),
lv AS (SELECT *, max(same) OVER (PARTITION BY target, cand) AS level FROM ow),
ch AS MATERIALIZED (SELECT target, cand, node, rank, level, count(*) OVER (PARTITION BY target, cand) AS n, CASE WHEN count(*) OVER (PARTITION BY target, cand) > 1 THEN len(list_filter(list_intersect(ctx, sig), lambda x: NOT list_contains(string_split(cand, '_'), x))) END AS ov FROM lv WHERE same = level),
rk AS (SELECT *, row_number() OVER (PARTITION BY target, cand ORDER BY ov DESC, node) AS rn, row_number() OVER (PARTITION BY target, cand ORDER BY rank, node) AS lo FROM ch),
pk AS MATERIALIZED (SELECT target, cand, max(n) AS n, max(level) AS level, max(node) FILTER (rn = 1) AS best, max(node) FILTER (lo = 1) AS low, max(ov) FILTER (rn = 1) AS o1, max(ov) FILTER (rn = 2) AS o2 FROM rk GROUP BY ALL),
dc AS (SELECT *, CASE WHEN n = 1 THEN 'unique' WHEN o1 > 0 AND o1 > o2 THEN 'overlap' {"WHEN true THEN 'fallback'" if fallback else ""} END AS how FROM pk)"""
    if edges:
        return X.sql("SELECT DISTINCT CASE WHEN how = 'fallback' THEN low ELSE best END AS src, target AS dst FROM dc WHERE how IS NOT NULL", more)
    return X.sql("SELECT CASE WHEN how IS NOT NULL THEN CASE level WHEN 1 THEN 'same_pos_' ELSE 'any_pos_' END || how WHEN n > 1 THEN 'ambiguous' ELSE 'self_only' END AS resolution, sum(k)::BIGINT AS n FROM hk LEFT JOIN (SELECT target, cand, n, level, how FROM dc) USING (target, cand) GROUP BY 1", more).replace("sum(k)::BIGINT AS n FROM hk", "sum(k)::BIGINT AS n FROM (SELECT target, cand, k FROM hk) hk")


SQL["sense_graph_counters"] = sense_sql()
SQL["sense_fallback_counters"] = sense_sql(fallback=True)
SQL["sense_graph_edges"] = sense_sql(edges=True)
SQL["synset_graph_edges"] = sense_sql(own_lemma=False, node="'s' || ord", edges=True)

CODE = "(regexp_matches(lemma, '^[ivxlcdm]{2,}$') OR regexp_matches(lemma, '^[a-z]i(bit|byte)$') OR regexp_matches(lemma, '^[^aeiouy]+$'))"


def variants_sql(words: str) -> str:
    """``vr(lemma, rule_id, variant)``: the rules over ``wd(lemma)``, out of ``words``."""
    rules = []
    for rule, pairs in cluster.SUFFIXES.items():
        for a, b in [q for p in pairs for q in (p, p[::-1])]:
            rules.append(f"SELECT lemma, '{rule}' AS rule_id, left(lemma, length(lemma) - {len(a)}) || '{b}' AS variant FROM wd WHERE lemma LIKE '%_{a}'")
    for rule, pairs in cluster.INFIXES.items():
        for a, b in [q for p in pairs for q in (p, p[::-1])]:
            rules.append(f"SELECT lemma, '{rule}', left(lemma, i - 1) || '{b}' || substr(lemma, i + {len(a)}) FROM (SELECT lemma, unnest(range(1, length(lemma) + 1)) AS i FROM wd) WHERE substr(lemma, i, {len(a)}) = '{a}'")
    d = cluster.DOUBLED
    rules.append(f"SELECT lemma, 'spelling.doubled_consonant', left(lemma, i - 1) || substr(lemma, i + 1) FROM (SELECT lemma, unnest(range(1, length(lemma))) AS i FROM wd) WHERE substr(lemma, i, 1) = substr(lemma, i + 1, 1) AND contains('{d}', substr(lemma, i, 1)) AND (i - length(rtrim(left(lemma, i), substr(lemma, i, 1)))) % 2 = 1")
    for x in cluster.DOUBLED_BEFORE:
        rules.append(f"SELECT lemma, 'spelling.doubled_consonant', stem || right(stem, 1) || '{x}' FROM (SELECT lemma, left(lemma, length(lemma) - {len(x)}) AS stem FROM wd WHERE lemma LIKE '%_{x}') WHERE regexp_matches(stem, '(^|[aeiou])[{d}]$')")
    for x in cluster.DROPPED_E_BEFORE:
        rules.append(f"SELECT lemma, 'spelling.dropped_e', CASE WHEN stem LIKE '%e' THEN left(stem, length(stem) - 1) || '{x}' ELSE stem || 'e{x}' END FROM (SELECT lemma, left(lemma, length(lemma) - {len(x)}) AS stem FROM wd WHERE lemma LIKE '%_{x}')")
    both = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in cluster.IRREGULAR)
    rules.append(f"SELECT lemma, 'spelling.lexical_pairs', y FROM wd JOIN (VALUES {both}) p(x, y) ON x = lemma")
    return f""",
wd AS MATERIALIZED (SELECT DISTINCT lemma FROM ({words}) WHERE regexp_full_match(lemma, '\\p{{L}}{{2,}}') AND NOT {CODE}),
vr AS MATERIALIZED (SELECT DISTINCT * FROM ({" UNION ALL ".join(rules)}) WHERE trim(variant) <> '' AND variant <> lemma)"""


def candidates_sql(words: str) -> str:
    """``cp(a, b, rules)``: pairs by rule, else by edit distance, with the caps of the definition."""
    meet = lambda keys, cap: f"(SELECT x.lemma AS a, y.lemma AS b FROM (SELECT * FROM {keys} WHERE key IN (SELECT key FROM {keys} GROUP BY key HAVING count(*) BETWEEN 2 AND {cap})) x JOIN {keys} y ON x.key = y.key AND x.lemma < y.lemma)"
    return variants_sql(words) + f""",
lw AS (SELECT lemma FROM wd WHERE length(lemma) >= 5),
co AS MATERIALIZED (SELECT lemma, i, left(lemma, i - 1) || substr(lemma, i + 1) AS rest FROM (SELECT lemma, unnest(range(1, length(lemma) + 1)) AS i FROM lw)),
k1 AS MATERIALIZED (SELECT DISTINCT lemma, length(lemma) || '|' || i || '|' || rest AS key FROM co),
k2 AS MATERIALIZED (SELECT lemma, rest AS key FROM co WHERE length(rest) >= 4 UNION SELECT lemma, lemma FROM lw),
k3 AS MATERIALIZED (SELECT lemma, array_to_string(list_sort(string_split(lemma, '')), '') AS key FROM lw),
ed AS MATERIALIZED (SELECT * FROM {meet("k1", cluster.BUCKET_CAP)} UNION SELECT * FROM {meet("k2", cluster.BUCKET_CAP)} WHERE levenshtein(a, b) <= 1 UNION SELECT * FROM {meet("k3", cluster.ANAGRAM_CAP)} WHERE levenshtein(a, b) <= 2),
ru AS MATERIALIZED (SELECT least(lemma, variant) AS a, greatest(lemma, variant) AS b, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM vr WHERE variant IN (SELECT lemma FROM wd) GROUP BY ALL),
cp AS MATERIALIZED (SELECT * FROM ru UNION ALL SELECT a, b, 'edit-distance' FROM ed WHERE (a, b) NOT IN (SELECT (a, b) FROM ru))"""


SQL["orthographic_variants"] = X.sql("SELECT * FROM vr", variants_sql("SELECT lemma FROM e"))
SQL["variant_candidates"] = X.sql("SELECT a, b, rules FROM cp", candidates_sql(f"SELECT unnest({PLAIN}) AS lemma FROM documents"))
SQL["variant_clusters"] = X.sql(
    "SELECT 'ic:' || low AS ic_id, string_agg(node, ',' ORDER BY node) AS forms FROM cc GROUP BY low",
    candidates_sql("SELECT lemma FROM e") + f""",
sg AS MATERIALIZED (SELECT lemma, pos, list_distinct(list_filter(gloss, lambda x: x NOT IN ({X.STOP}) AND length(x) > 1)) AS w FROM e),
ok AS MATERIALIZED (SELECT a, b FROM cp JOIN sg x ON x.lemma = a JOIN sg y ON y.lemma = b AND y.pos = x.pos GROUP BY a, b HAVING max(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END) >= 0.05),
ue AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
cc AS (SELECT node, min(other) AS low FROM (WITH RECURSIVE p AS (SELECT a AS node, a AS other FROM ue UNION SELECT p.node, ue.b FROM p JOIN ue ON ue.a = p.other) SELECT * FROM p) GROUP BY node)""",
)

SQL["acceptance_stable"] = f"""{SETS}, z AS (SELECT count(*) AS none FROM (SELECT DISTINCT part FROM m) WHERE part NOT IN (SELECT part FROM st)),
v AS (SELECT m.node, count(st.s) AS all_, count(st.s) FILTER ((s >> b) & 1 = 1) AS with_ FROM m LEFT JOIN st USING (part) GROUP BY m.node)
SELECT none = 0 AND with_ > 0 AS credulous, none = 0 AND with_ = all_ AS skeptical, count(*) AS n FROM v, z GROUP BY ALL"""

#: Least seeds of the strongly connected components of graphs of at most five nodes, by trying all subsets.
SQL["fvs_small_frameworks"] = f"""{USERS}, re AS MATERIALIZED (WITH RECURSIVE p AS (SELECT src, dst FROM x UNION SELECT p.src, x.dst FROM p JOIN x ON p.dst = x.src) SELECT * FROM p),
cy AS MATERIALIZED (SELECT node, min(dst) AS scc FROM (SELECT p.src AS node, p.dst FROM re p JOIN re q ON p.src = q.dst AND p.dst = q.src) GROUP BY node),
cm AS MATERIALIZED (SELECT scc, node, row_number() OVER (PARTITION BY scc ORDER BY node) - 1 AS b, count(*) OVER (PARTITION BY scc) AS k FROM cy),
ie AS MATERIALIZED (SELECT p.scc, p.b AS f, q.b AS t FROM x JOIN cm p ON p.node = x.src JOIN cm q ON q.node = x.dst AND q.scc = p.scc),
su AS MATERIALIZED (SELECT scc, k, unnest(range(0, 1 << k::INT)) AS s FROM (SELECT DISTINCT scc, k FROM cm)),
pa AS MATERIALIZED (WITH RECURSIVE p AS (SELECT su.scc, s, f, t FROM su JOIN ie USING (scc) WHERE (s >> f) & 1 = 0 AND (s >> t) & 1 = 0 UNION SELECT p.scc, p.s, p.f, ie.t FROM p JOIN ie ON ie.scc = p.scc AND ie.f = p.t WHERE (p.s >> ie.t) & 1 = 0) SELECT * FROM p),
le AS (SELECT scc, k AS size, min(bit_count(s)) AS seeds FROM su WHERE (scc, s) NOT IN (SELECT (scc, s) FROM pa WHERE f = t) GROUP BY ALL)
SELECT size, seeds::BIGINT AS seeds, count(*) AS n FROM le GROUP BY ALL"""

_COV = {f"c{i}{j}": (a, b) for i, a in enumerate("uvw") for j, b in enumerate("uvw") if i <= j}
SQL["ols_r2_multi"] = (
    "WITH t AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS u, l_discount::DOUBLE AS v, l_tax::DOUBLE AS w FROM lineitem), c AS (SELECT count(*) AS n, var_pop(y) AS yy, covar_pop(u, y) AS y0, covar_pop(v, y) AS y1, covar_pop(w, y) AS y2, "
    + ", ".join(f"covar_pop({a}, {b}) AS {k}" for k, (a, b) in _COV.items())
    + """ FROM t), d AS (SELECT *, c11 * c22 - c12 * c12 AS m00, c02 * c12 - c01 * c22 AS m01, c01 * c12 - c02 * c11 AS m02, c00 * c22 - c02 * c02 AS m11, c01 * c02 - c00 * c12 AS m12, c00 * c11 - c01 * c01 AS m22 FROM c)
SELECT n, round((y0 * (m00 * y0 + m01 * y1 + m02 * y2) + y1 * (m01 * y0 + m11 * y1 + m12 * y2) + y2 * (m02 * y0 + m12 * y1 + m22 * y2)) / (c00 * m00 + c01 * m01 + c02 * m02) / yy, 6) AS r2 FROM d"""
)


def _wl(rounds: int = 3) -> str:
    cte = ", w0 AS MATERIALIZED (SELECT node, CASE WHEN node IN (SELECT src FROM x WHERE src = dst) THEN '1' ELSE '0' END AS colour FROM a)"
    for k in range(1, rounds + 1):
        side = lambda own, other: f"(SELECT {own} AS node, string_agg(colour, ',' ORDER BY colour) AS l FROM x JOIN w{k - 1} w ON w.node = x.{other} GROUP BY 1)"
        cte += f", w{k} AS MATERIALIZED (SELECT w.node, md5(w.colour || '|' || coalesce(i.l, '') || '|' || coalesce(o.l, '')) AS colour FROM w{k - 1} w LEFT JOIN {side('dst', 'src')} i ON i.node = w.node LEFT JOIN {side('src', 'dst')} o ON o.node = w.node)"
    return cte


SQL["wl_colours"] = f"{USERS}{_wl()} SELECT colour, count(*) AS n FROM w3 GROUP BY colour"
SQL["framework_fingerprint"] = X.sql("SELECT sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint, sum(k)::BIGINT AS n FROM (SELECT sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS k FROM (SELECT sha256(node) AS h FROM n) GROUP BY left(h, 2))")

_MORE = ", ga AS MATERIALIZED (SELECT s AS ic FROM pr WHERE l0_candidate OR pressure_bucket IN ({primitive})), ha0 AS (SELECT ic FROM ga)" + "".join(
    f", ha{k} AS MATERIALIZED (SELECT ic FROM ha{k - 1} UNION SELECT ic FROM sz WHERE NOT truncated AND node NOT IN (SELECT dst FROM de WHERE sic NOT IN (SELECT ic FROM ha{k - 1})))" for k in range(1, ROUNDS + 1)
)


def _yield() -> str:
    from glossweave.operators.ground import PRIMITIVE

    more = _MORE.format(primitive=", ".join(f"'{b}'" for b in PRIMITIVE))
    after = f"(SELECT count(*) FROM sz WHERE NOT truncated AND node NOT IN (SELECT node FROM cl WHERE ic NOT IN (SELECT ic FROM ha{ROUNDS})))"
    return X.sql(f"SELECT before AS closed_before, after AS closed_after, added, CASE WHEN added > 0 THEN (after - before) / added ELSE 0 END AS mgy FROM (SELECT (SELECT count(*) FROM st WHERE status = 'closed') AS before, {after} AS after, (SELECT count(DISTINCT ic) FROM ga WHERE ic NOT IN (SELECT ic FROM gb)) AS added)", GROUND + more)


SQL["grounding_yield"] = _yield()
