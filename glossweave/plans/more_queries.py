"""Queries over probes, reports, preferred acceptance, bipolar ranking and what only whole runs compose."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import build, cluster, feedback, ground, probe, stats, structure
from glossweave.operators.loops import cut
from glossweave.plans import fixtures as X
from glossweave.plans.graph_queries import SETS, USERS, _grounded_sql
from glossweave.plans.more_sql import SQL as MORE
from glossweave.plans.source_queries import SMALL

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


#: Subsets of each component of small frameworks, and which of them are stable within it.
COMPONENT = f"""{SMALL},
cm AS MATERIALIZED (SELECT scc, node, row_number() OVER (PARTITION BY scc ORDER BY node) - 1 AS b, count(*) OVER (PARTITION BY scc) AS k FROM sc),
ie AS MATERIALIZED (SELECT p.scc, p.b AS f, q.b AS t FROM x JOIN cm p ON p.node = x.src JOIN cm q ON q.node = x.dst AND q.scc = p.scc),
su AS MATERIALIZED (SELECT scc, k, unnest(range(0, 1 << k::INT)) AS s FROM (SELECT DISTINCT scc, k FROM cm)),
sb AS MATERIALIZED (SELECT scc, s FROM su WHERE NOT EXISTS (SELECT 1 FROM ie WHERE ie.scc = su.scc AND (s >> f) & 1 = 1 AND (s >> t) & 1 = 1)
 AND NOT EXISTS (SELECT 1 FROM cm WHERE cm.scc = su.scc AND (s >> b) & 1 = 0 AND NOT EXISTS (SELECT 1 FROM ie WHERE ie.scc = su.scc AND ie.t = cm.b AND (s >> f) & 1 = 1)))"""


@query("component_probe", f"{COMPONENT} SELECT k AS size, CASE WHEN k > 1 THEN 'component' WHEN scc IN (SELECT scc FROM ie) THEN 'self-loop' ELSE 'single' END AS kind, CASE WHEN scc IN (SELECT scc FROM sb) THEN 'sat' ELSE 'unsat' END AS status, count(*) AS n FROM (SELECT DISTINCT scc, k FROM cm) GROUP BY ALL")
def component_probe(spark, d):
    return probe.component_probe(X.user_attacks(spark, d)[1]).groupBy("size", "kind", "status").agg(F.count("*").alias("n"))


@query("largest_scc_probe", f"{COMPONENT}, lg AS (SELECT scc FROM cm GROUP BY scc ORDER BY count(*) DESC, scc LIMIT 1) SELECT (SELECT count(*) FROM cm WHERE scc IN (SELECT scc FROM lg)) AS arguments, (SELECT count(*) FROM ie WHERE scc IN (SELECT scc FROM lg)) AS attacks, 0 AS grounded_in, 0 AS grounded_out, (SELECT count(*) FROM sb WHERE scc IN (SELECT scc FROM lg)) > 0 AS stable")
def largest_probe(spark, d):
    """The largest component of the users' frameworks; each of its arguments is attacked, so the grounded extension is empty."""
    return probe.probe(*probe.largest_scc_framework(X.user_attacks(spark, d)[1])).drop("fingerprint")


@query("grounded_timeboxed", X.sql("SELECT true AS finished, count(*) AS n, count(*) FILTER (node IN (SELECT node FROM in8)) AS ins, false AS finished_in_no_time FROM a", ", a AS (SELECT node FROM n), x AS (SELECT src, dst FROM g)" + _grounded_sql(8)))
def timeboxed(spark, d):
    """Within ten minutes, and within none."""
    g = cut(X.edges(spark, d))
    args = cut(structure.all_nodes(g))
    labels, how = probe.grounded_within(args, g, 600)
    none, short = probe.grounded_within(args, g, -1)
    return labels.agg(F.lit(how["finished"]).alias("finished"), F.count("*").alias("n"), F.sum((F.col("label") == "in").cast("long")).alias("ins"), F.lit(short["finished"]).alias("finished_in_no_time"))


@query("framework_kinds", X.sql("SELECT * FROM (SELECT 'dung' AS framework, (SELECT count(*) FROM n) AS arguments, 0 AS supports, (SELECT count(*) FROM g) AS attacks UNION ALL SELECT 'support', (SELECT count(*) FROM n), (SELECT count(*) FROM g), 0 UNION ALL SELECT 'both', (SELECT count(*) FROM (SELECT node FROM n UNION SELECT src FROM rv)), (SELECT count(*) FROM g), (SELECT count(*) FROM rv) UNION ALL SELECT 'kernel', (SELECT count(*) FROM kernel), 0, (SELECT count(*) FROM ke))", ", rv AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM f a JOIN f b ON a.lemma = b.lemma AND a.node <> b.node)" + X.REACH))
def framework_kinds(spark, d):
    g = cut(X.edges(spark, d))
    rivals = cut(build.rival_attacks(X.first_entries(spark, d))[0])
    all_ = probe.frameworks(g, rivals)
    nodes, inside = probe.kernel_framework(g)
    all_["kernel"] = (nodes, build.two_kinds(inside.limit(0), inside))
    count = lambda name, a, e: a.agg(F.lit(name).alias("framework"), F.count("*").alias("arguments")).crossJoin(e.agg(*[F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(f"{k}s") for k in ("support", "attack")]))
    rows = [count(name, *f) for name, f in all_.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_ADMISSIBLE = f"""{SETS}, xe AS MATERIALIZED (SELECT p.part, p.b AS f, q.b AS t FROM x JOIN m p ON p.node = x.src JOIN m q ON q.node = x.dst),
ad AS MATERIALIZED (SELECT part, s FROM sub WHERE NOT EXISTS (SELECT 1 FROM xe WHERE xe.part = sub.part AND (s >> f) & 1 = 1 AND (s >> t) & 1 = 1)
 AND NOT EXISTS (SELECT 1 FROM xe u WHERE u.part = sub.part AND (s >> u.t) & 1 = 1 AND NOT EXISTS (SELECT 1 FROM xe w WHERE w.part = sub.part AND w.t = u.f AND (s >> w.f) & 1 = 1))),
pf AS (SELECT part, s FROM ad WHERE NOT EXISTS (SELECT 1 FROM ad o WHERE o.part = ad.part AND o.s <> ad.s AND (o.s & ad.s) = ad.s))"""


@query("preferred_counts_small", f"{_ADMISSIBLE} SELECT part, count(*) AS n_extensions FROM pf GROUP BY part")
def preferred_counts(spark, d):
    parts = probe.preferred_parts(*X.user_attacks(spark, d))
    return parts.groupBy(F.substring_index("part", ":", 1).alias("part")).agg(F.product("n_extensions").cast("long").alias("n_extensions"))


def _rho(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"(SELECT round(corr(ra, rb), 6) FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM bt))"


def _scores(name: str, edges: str, k: int) -> str:
    cte = f", {name}0 AS (SELECT node, 1.0::DOUBLE AS score FROM bn)"
    for i in range(1, k + 1):
        cte += f", {name}{i} AS MATERIALIZED (SELECT bn.node, 1 / (1 + least(1, coalesce(x.v, 0))) AS score FROM bn LEFT JOIN (SELECT e.dst AS node, sum(s.score) AS v FROM {edges} e JOIN {name}{i - 1} s ON s.node = e.src GROUP BY 1) x USING (node))"
    return cte


@query("bipolar_ranking", X.sql(f"SELECT 'support-attackers' AS pair, (SELECT count(*) FROM bt) AS n, {_rho('support', 'fewer')} AS rho UNION ALL SELECT 'both-attackers', (SELECT count(*) FROM bt), {_rho('\"both\"', 'fewer')} UNION ALL SELECT 'support-both', (SELECT count(*) FROM bt), {_rho('support', '\"both\"')}", ", rv AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM f a JOIN f b ON a.lemma = b.lemma AND a.node <> b.node), bo AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT src, dst FROM rv), bn AS MATERIALIZED (SELECT src AS node FROM bo UNION SELECT dst FROM bo)" + _scores("sa", "g", 8) + _scores("sb", "bo", 8) + ", bt AS MATERIALIZED (SELECT bn.node, round(sa8.score, 6) AS support, round(sb8.score, 6) AS \"both\", -coalesce(k, 0) AS fewer FROM bn JOIN sa8 USING (node) JOIN sb8 USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS k FROM bo GROUP BY 1) USING (node))"))
def bipolar(spark, d):
    rivals = build.rival_attacks(X.first_entries(spark, d))[0]
    return probe.bipolar_ranking(X.edges(spark, d), rivals, rounds=8, digits=6)[1].withColumn("rho", F.round("rho", 6))


@query("condensation_levels", X.sql("SELECT node, max(k) AS layer FROM (WITH RECURSIVE p AS (SELECT DISTINCT scc AS node, 1 AS k FROM scc UNION SELECT e.d, p.k + 1 FROM p JOIN (SELECT DISTINCT s, d FROM se WHERE s <> d) e ON e.s = p.node) SELECT * FROM p) GROUP BY node", X.REACH))
def condensation_levels(spark, d):
    g = cut(X.edges(spark, d))
    return structure.condensation(g, cut(structure.scc(g)))[1]


@query("loop_report", X.sql("""SELECT unnest(['components', 'cyclic', 'nodes_in_cyclic', 'largest', 'self_loops', 'two_cycles', 'three_cycles']) AS metric, unnest([(SELECT count(*) FROM zs), (SELECT count(*) FROM zs WHERE c), (SELECT coalesce(sum(size), 0)::BIGINT FROM zs WHERE c), (SELECT max(size) FROM zs),
 (SELECT count(*) FROM g WHERE src = dst), (SELECT count(*) FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
 (SELECT count(*) FROM (SELECT DISTINCT a.src, least(a.dst, b.dst), greatest(a.dst, b.dst) FROM g a JOIN g b ON a.dst = b.src JOIN g c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst))]) AS value""", X.REACH + ", zs AS MATERIALIZED (SELECT scc, count(*) AS size, count(*) > 1 OR bool_or(node IN (SELECT src FROM g WHERE src = dst)) AS c FROM scc GROUP BY scc)"))
def loop_report(spark, d):
    return structure.loop_report(X.edges(spark, d))["totals"]


def _diagnostics_sql(name: str, edges: str) -> str:
    """One row of diagnostics over a table of edges."""
    return f""", {name}r AS MATERIALIZED (WITH RECURSIVE p AS (SELECT src, dst FROM {edges} UNION SELECT p.src, e.dst FROM p JOIN {edges} e ON p.dst = e.src) SELECT * FROM p),
{name}n AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}),
{name}c AS MATERIALIZED (SELECT n.node, least(n.node, coalesce(min(m.dst), n.node)) AS scc FROM {name}n n LEFT JOIN (SELECT p.src AS node, p.dst FROM {name}r p JOIN {name}r q ON p.src = q.dst AND p.dst = q.src) m USING (node) GROUP BY n.node),
{name}e AS (SELECT a.scc AS s, b.scc AS d FROM {edges} e JOIN {name}c a ON a.node = e.src JOIN {name}c b ON b.node = e.dst WHERE a.scc <> b.scc),
{name}z AS (SELECT count(*) AS sccs, count(*) FILTER (scc NOT IN (SELECT d FROM {name}e)) AS sources, count(*) FILTER (scc NOT IN (SELECT s FROM {name}e)) AS sinks, max(size) AS largest FROM (SELECT scc, count(*) AS size FROM {name}c GROUP BY scc))"""


@query("reverse_diagnostics", f"{SMALL}, e1 AS MATERIALIZED (SELECT x.* FROM x JOIN kn a ON a.node = x.src JOIN kn b ON b.node = x.dst), e2 AS MATERIALIZED (SELECT dst AS src, src AS dst FROM e1), kb AS MATERIALIZED (SELECT DISTINCT dst AS node FROM re WHERE src IN (SELECT src FROM re WHERE src = dst)), e3 AS MATERIALIZED (SELECT x.dst AS src, x.src AS dst FROM x JOIN kb a ON a.node = x.src JOIN kb b ON b.node = x.dst){_diagnostics_sql('u', 'e1')}{_diagnostics_sql('v', 'e2')}{_diagnostics_sql('w', 'e3')} SELECT 'kernel' AS graph, * FROM uz UNION ALL SELECT 'reversed', * FROM vz UNION ALL SELECT 'reversed-kernel', * FROM wz")
def reverse_diagnostics(spark, d):
    rows = [t.select(F.lit(name).alias("graph"), "sccs", "sources", "sinks", "largest") for name, t in structure.reverse_diagnostics(X.user_attacks(spark, d)[1]).items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("analysis_flags", X.sql("SELECT n.node, k.node IS NOT NULL AS is_kernel, CASE WHEN k.node IS NOT NULL THEN scc END AS scc, k.node IS NOT NULL AND scc NOT IN (SELECT d FROM se WHERE s <> d) AS is_core, k.node IS NOT NULL AND scc IN (SELECT d FROM se WHERE s <> d) AS is_satellite FROM n JOIN scc USING (node) LEFT JOIN kernel k USING (node)", X.REACH))
def analysis_flags(spark, d):
    """The whole analysis, without what depends on the choice of seeds."""
    return structure.analyze(X.edges(spark, d), "bounded-scc")["membership"].drop("is_seed", "layer")


def _checked(method):
    def run(spark, d):
        """What SQL can state of seeds that are chosen: none outside the kernel, and no cycle left without them."""
        g = cut(X.edges(spark, d))
        k = cut(structure.kernel(g))
        seed = cut(feedback.staged(g, hubs=40)[0].select("node").distinct()) if method == "staged" else cut(feedback.solve(g, cut(structure.scc(g)), method)[0])
        left = g.join(seed.withColumnRenamed("node", "src"), "src", "left_anti").join(seed.withColumnRenamed("node", "dst"), "dst", "left_anti")
        r = k.agg(F.count("*").alias("kernel")).crossJoin(structure.kernel(left).agg(F.count("*").alias("cyclic_left")))
        return r.crossJoin(seed.join(k, "node", "left_anti").agg(F.count("*").alias("outside")))

    return run


_NO_CYCLE = X.sql("SELECT (SELECT count(*) FROM kernel) AS kernel, 0 AS cyclic_left, 0 AS outside", X.REACH)
query("seeds_greedy_checked", _NO_CYCLE)(_checked("exact-small-greedy"))
query("seeds_staged_checked", _NO_CYCLE)(_checked("staged"))


@query("matching_checked", X.sql("SELECT 0 AS not_edges, 0 AS heads_twice, 0 AS tails_twice, 0 AS could_be_added", ""))
def matching_checked(spark, d):
    """What SQL can state of a maximum matching: edges only, each end once, and none can simply be added."""
    g = cut(X.edges(spark, d))
    m = cut(feedback.max_matching(g))
    pairs = m.select(F.col("tail").alias("src"), F.col("head").alias("dst"))
    twice = lambda c, n: pairs.groupBy(c).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias(n))
    free = g.join(pairs.select("src").distinct(), "src", "left_anti").join(pairs.select("dst").distinct(), "dst", "left_anti").agg(F.count("*").alias("could_be_added"))
    return pairs.join(g, ["src", "dst"], "left_anti").agg(F.count("*").alias("not_edges")).crossJoin(twice("src", "heads_twice")).crossJoin(twice("dst", "tails_twice")).crossJoin(free)


@query("matching_size_small", f"""{SETS}, xe AS MATERIALIZED (SELECT p.part, p.b AS f, q.b AS t FROM x JOIN m p ON p.node = x.src JOIN m q ON q.node = x.dst),
dp AS (WITH RECURSIVE r AS (SELECT DISTINCT part, 0 AS i, 0 AS used, 0 AS c FROM m UNION SELECT r.part, r.i + 1, r.used | coalesce(1 << e.t, 0), r.c + (e.t IS NOT NULL)::INT FROM r JOIN (SELECT part, f, t FROM xe UNION SELECT part, b, NULL FROM m) e ON e.part = r.part AND e.f = r.i WHERE e.t IS NULL OR (r.used >> e.t) & 1 = 0) SELECT * FROM r)
SELECT part, max(c)::BIGINT AS size FROM dp GROUP BY part""")
def matching_small(spark, d):
    """The maximum matching of each user's attacks, by size."""
    args, att = X.user_attacks(spark, d)
    m = feedback.max_matching(att).groupBy(F.substring_index("tail", ":", 1).alias("part")).agg(F.count("*").alias("size"))
    return args.select(F.substring_index("node", ":", 1).alias("part")).distinct().join(m, "part", "left").fillna(0, ["size"])


@query("driver_nodes_small", f"""{SETS}, xe AS MATERIALIZED (SELECT p.part, p.b AS f, q.b AS t FROM x JOIN m p ON p.node = x.src JOIN m q ON q.node = x.dst),
dp AS (WITH RECURSIVE r AS (SELECT DISTINCT part, 0 AS i, 0 AS used, 0 AS c FROM m UNION SELECT r.part, r.i + 1, r.used | coalesce(1 << e.t, 0), r.c + (e.t IS NOT NULL)::INT FROM r JOIN (SELECT part, f, t FROM xe UNION SELECT part, b, NULL FROM m) e ON e.part = r.part AND e.f = r.i WHERE e.t IS NULL OR (r.used >> e.t) & 1 = 0) SELECT * FROM r)
SELECT part, n - c AS drivers FROM (SELECT part, max(c)::BIGINT AS c FROM dp GROUP BY part) JOIN (SELECT part, count(*) AS n FROM m GROUP BY part) USING (part)""")
def drivers_small(spark, d):
    args, att = X.user_attacks(spark, d)
    left = feedback.drivers(att, feedback.max_matching(att), args).groupBy(F.substring_index("node", ":", 1).alias("part")).agg(F.count("*").alias("drivers"))
    return args.select(F.substring_index("node", ":", 1).alias("part")).distinct().join(left, "part", "left").fillna(0, ["drivers"])


_INDEX = MORE["variant_clusters"].partition("\nSELECT 'ic:'")[0] + """,
os AS MATERIALIZED (SELECT a, b, rules, max(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END) AS score FROM cp JOIN ok USING (a, b) JOIN sg x ON x.lemma = a JOIN sg y ON y.lemma = b AND y.pos = x.pos GROUP BY ALL)
SELECT node AS form, 'ic:' || low AS ic_id, string_agg(DISTINCT r, ',' ORDER BY r) AS rationale, round(max(score), 6) AS evidence FROM cc JOIN (SELECT a, b, unnest(string_split(rules, ',')) AS r, score FROM os) z ON node = z.a OR node = z.b GROUP BY ALL"""


@query("variant_index", _INDEX)
def variant_index(spark, d):
    s = X.senses(spark, d).withColumnRenamed("node", "sense_id")
    t = cluster.index(cut(cluster.gate_scores(cluster.candidate_pairs(s.select("lemma")), s, 0.05)))
    return t.select("form", "ic_id", F.array_join("rationale", ",").alias("rationale"), F.round("evidence", 6).alias("evidence"))


_MULTI = MORE["ols_r2_multi"]


@query("nested_models", "SELECT 'l_extendedprice' AS target, 'size' AS upto, 1 AS columns, (SELECT round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem) AS r2 UNION ALL SELECT 'l_extendedprice', 'rates', 3, (SELECT r2 FROM (" + _MULTI + "))")
def nested_models(spark, d):
    rows = stats.nested_models(X.table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")]), ["l_extendedprice"], {"size": ["l_quantity"], "rates": ["l_discount", "l_tax"]})
    return spark.createDataFrame([(r["target"], r["upto"], r["columns"], round(r["r2"], 6)) for r in rows], "target string, upto string, columns int, r2 double")


@query("status_regressions", "SELECT o_orderkey AS node, CASE WHEN o_orderkey % 4 = 0 THEN 'closed' WHEN o_orderkey % 4 = 1 THEN 'circular' ELSE 'external' END AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0")
def regressions(spark, d):
    """Orders as senses: closed before where fulfilled, and after by their key."""
    o = X.table(spark, d, "orders")
    before = o.select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("external").alias("status"))
    after = o.select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 4 == 0, "closed").when(F.col("o_orderkey") % 4 == 1, "circular").otherwise("external").alias("status"))
    return ground.regressions(before, after)
