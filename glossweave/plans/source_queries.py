"""Queries over readers and sinks: tables are written as the files in question and read back."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from glossweave.functions import text as T
from glossweave.operators import structure
from glossweave.operators.loops import shared_folder
from glossweave.plans import fixtures as X
from glossweave.plans.graph_queries import SQL as GRAPH_SQL, USERS, layers
from glossweave.sources import readers, writers

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def put(spark, name: str, data: bytes) -> str:
    """The bytes as a file in the folder that all share."""
    path = f"{shared_folder(spark)}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    return path


def norm(column: str) -> str:
    return f"replace(translate(lower(trim({column})), '- ', '__'), '''', '')"


ENTRY = f"ord long, {readers.ENTRY}"


def entry_lines(spark, d):
    """Parts as dictionary entries, a JSON object a line: every third in another language, with blank and missing glosses."""
    pos = F.element_at(F.array(*map(F.lit, ("noun", "verb", "adj", "adv", "prefix"))), (F.col("p_size") % 5 + 1).cast("int"))
    sense = F.array(F.struct(F.array(F.concat(F.lit(" "), "p_type"), F.lit("  ")).alias("glosses")), F.struct(F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("glosses")))
    part = X.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("word"), pos.alias("pos"), F.when(F.col("p_partkey") % 3 == 0, "de").otherwise("en").alias("lang_code"), sense.alias("senses"))


def written(spark, d, **options) -> str:
    path = shared_folder(spark)
    entry_lines(spark, d).write.options(**options).json(path)
    return path


POS = "CASE p_size % 5 {0} END"
RAW_POS = POS.format("WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' WHEN 2 THEN 'adj' WHEN 3 THEN 'adv' ELSE 'prefix'")
WIK_POS = POS.format("WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'a' WHEN 3 THEN 'r' ELSE 'x'")
LINES = f"SELECT p_partkey AS ord, p_name AS word, {RAW_POS} AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'de' ELSE 'en' END AS lang_code, 2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS glosses FROM part"


def _listed(rows):
    count = F.aggregate("senses", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["glosses"]), F.lit(0)))
    return rows.select("ord", "word", "pos", "lang_code", count.alias("glosses"))


@query("scan_jsonl", LINES)
def scan_jsonl(spark, d):
    return _listed(readers.jsonl(spark, written(spark, d), ENTRY))


@query("scan_jsonl_url", LINES + " WHERE p_partkey <= 400")
def scan_jsonl_url(spark, d):
    """A gzipped file behind a URL (here of the shared folder)."""
    path = shared_folder(spark)
    entry_lines(spark, d).where("ord <= 400").coalesce(1).write.option("compression", "gzip").json(path)
    url = spark.read.format("binaryFile").load(f"{path}/*.gz").select("path").first()["path"]
    return _listed(readers.jsonl_url(spark, url, ENTRY))


@query("scan_wiktextract", f"SELECT p_partkey AS ord, {norm('p_name')} AS lemma, {WIK_POS} AS pos, trim(p_type) || CASE WHEN p_size % 2 = 0 THEN ' ; ' || trim(p_brand) ELSE '' END AS definition FROM part WHERE p_partkey % 3 <> 0")
def scan_wiktextract(spark, d):
    return readers.wiktextract_entries(readers.jsonl(spark, written(spark, d), ENTRY))


@query("pos_wiktextract", "SELECT p_type, CASE p_size % 7 WHEN 0 THEN 'n' WHEN 1 THEN 'n' WHEN 2 THEN 'v' WHEN 3 THEN 'a' WHEN 4 THEN 'r' WHEN 5 THEN 'a' ELSE 'x' END AS pos, count(*) AS n FROM part GROUP BY ALL")
def pos_wiktextract(spark, d):
    raw = F.element_at(F.array(*map(F.lit, (" Noun", "proper name", "VERB", "adjective ", "adverb", "determiner", "phrase"))), (F.col("p_size") % 7 + 1).cast("int"))
    raw = F.when(F.col("p_size") % 7 == 1, "Proper Noun").otherwise(raw)
    return X.table(spark, d, "part").select("p_type", T.wiktextract_pos(raw).alias("pos")).groupBy("p_type", "pos").agg(F.count("*").alias("n"))


@query("boolish_values", "SELECT o_orderpriority, count(*) FILTER (o_orderkey % 3 = 0) AS yes, count(*) AS n FROM orders GROUP BY 1")
def boolish_values(spark, d):
    said = F.when(F.col("o_orderkey") % 3 == 0, " TRUE ").when(F.col("o_orderkey") % 3 == 1, "yes")
    t = X.table(spark, d, "orders").withColumn("b", T.boolish(said))
    return t.groupBy("o_orderpriority").agg(F.sum(F.col("b").cast("long")).alias("yes"), F.count("*").alias("n"))


def _csv(spark, rows, **options) -> str:
    """One file, in the order of the rows."""
    path = shared_folder(spark)
    rows.coalesce(1).write.option("header", True).options(**options).csv(path)
    return path


@query("scan_annotation_csv", f"""WITH c AS (SELECT {norm('c_name')} AS key, c_custkey AS k, c_acctbal AS b FROM customer), v AS (
SELECT key, 'frequency' AS field, k::DOUBLE AS value FROM c WHERE k % 7 <> 0 AND k % 5 <> 0 UNION ALL SELECT key, 'frequency', k + 0.5 FROM c WHERE k % 5 = 0
UNION ALL SELECT key, 'age_of_acquisition', CASE WHEN k % 2 = 0 THEN b::DOUBLE ELSE 2 * k END FROM c) SELECT * FROM v""")
def scan_annotation_csv(spark, d):
    """Two files under other headers: a later row and a later file win, what is no number is skipped, a missing file too."""
    c = X.table(spark, d, "customer")
    number = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    first = c.select(F.col("c_name").alias(" Word"), number.alias("Frequency"), (2 * F.col("c_custkey")).alias("AgeOfAcquisition"), F.lit(0).alias("turn"), F.col("c_custkey").alias("k"))
    again = c.where("c_custkey % 5 = 0").select(F.col("c_name"), (F.col("c_custkey") + 0.5).cast("string"), 2 * F.col("c_custkey"), F.lit(1), F.col("c_custkey"))
    a = _csv(spark, first.union(again).orderBy("turn", "k"), ignoreLeadingWhiteSpace="false")
    b = _csv(spark, c.where("c_custkey % 2 = 0").select(F.upper("c_name").alias("LEMMA"), F.col("c_acctbal").alias("age of acquisition")))
    return readers.annotations(spark, [a, f"{shared_folder(spark)}/none.csv", b])


def norm_rows(spark, d):
    """Suppliers as a norm file: the nation is the word, so that words repeat."""
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_name").alias("Term"), F.when(F.col("s_suppkey") % 10 == 3, "NaN").otherwise(F.col("s_acctbal").cast("string")).alias(" Concreteness "), "s_suppkey").orderBy("s_suppkey")


NORM = f"SELECT {norm('n_name')} AS word, 'concreteness' AS metric, {{0}}(s_acctbal::DOUBLE, s_suppkey) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 3 GROUP BY n_name"


@query("scan_norm_csv", NORM.format("arg_max"))
def scan_norm_csv(spark, d):
    return readers.norms(spark, _csv(spark, norm_rows(spark, d), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"))


@query("scan_norm_csv_first", NORM.format("arg_min"))
def scan_norm_first(spark, d):
    return readers.norms(spark, _csv(spark, norm_rows(spark, d), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"), first_wins=True)


@query("scan_norm_xlsx", f"SELECT {norm('n_name')} AS word, 'valence' AS metric, n_nationkey + 0.25::DOUBLE AS value FROM nation WHERE n_nationkey % 4 <> 1")
def scan_norm_xlsx(spark, d):
    """The nations as a workbook, each twice; the first value counts, and what is no number is skipped."""
    rows = [(r["n_name"], "x" if r["n_nationkey"] % 4 == 1 else r["n_nationkey"] + 0.25) for r in X.table(spark, d, "nation").orderBy("n_nationkey").collect()]
    rows += [(w, v if v == "x" else 99.0) for w, v in rows]
    names = [w for w, _ in rows]
    cell = lambda at, v: f'<c r="{at}" t="s"><v>{names.index(v)}</v></c>' if v in names else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    body = "".join(f'<row r="{k}">{cell(f"A{k}", a)}{cell(f"C{k}", b)}</row>' for k, (a, b) in enumerate([("Word", "Valence"), *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{escape(w)}</t></si>' for w in names)}</sst>")
    return readers.norms_xlsx(spark, put(spark, "norms.xlsx", out.getvalue()))


@query("scan_wordlist", f"SELECT word, row_number() OVER (ORDER BY k) - 1 AS ord FROM (SELECT {norm('p_type')} AS word, min(p_partkey) AS k FROM part GROUP BY 1)")
def scan_wordlist(spark, d):
    path = shared_folder(spark)
    lines = X.table(spark, d, "part").orderBy("p_partkey").select(F.concat(F.lit(" "), "p_type", F.lit("  ")).alias("value"))
    lines.coalesce(1).write.text(path)
    return readers.wordlist(spark, path)


def markup(word: str, pos: str, gloss: str) -> str:
    return f"\n<hw>{word[0]}\"{word[1:]}*</hw> <pos>{pos}</pos>\n<def>One <i>{gloss}</i>,\nor more.</def> and <def>another é</def>"


GCIDE = f"""SELECT {norm('n_name')} AS lemma, CASE n_regionkey WHEN 0 THEN 'r' WHEN 1 THEN 'a' WHEN 2 THEN 'n' WHEN 3 THEN 'v' ELSE 'x' END AS pos,
 'One ' || r_name || ' ,or more. ; another é; One again ,or more. ; another é' AS definition FROM nation JOIN region ON n_regionkey = r_regionkey""".replace(" ,or", " , or").replace("é; One", "é ; One")


@query("scan_gcide_archive", GCIDE)
def scan_gcide(spark, d):
    """The nations as dictionary markup in a compressed archive of two Latin-1 files; a headword's blocks are put together."""
    nations = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    pos = ("adv.", "a.", "n. pl.", "v. t.", "interj.")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:xz") as archive:
        for name, gloss in (("a.txt", None), ("b.txt", "again")):
            data = ("head" + "".join("<p>" + markup(r["n_name"], pos[r["n_regionkey"]], gloss or r["r_name"]) for r in nations)).encode("latin-1")
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return readers.gcide_entries(readers.gcide_archive(spark, put(spark, "gcide.tar.xz", out.getvalue()))).select("lemma", "pos", "definition")


@query("gcide_graph_edges", "SELECT DISTINCT lower(translate(r_name, '0123456789_ ', 'abcdefghijkk')) || '::n' AS src, lower(translate(n_name, '0123456789_ ', 'abcdefghijkk')) || '::n' AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def gcide_graph(spark, d):
    """Dictionary markup to graph: a region defines its nations, spelt in letters alone."""
    from glossweave.operators import build

    letters = lambda c: F.translate(F.col(c), "0123456789_ ", "abcdefghijkk")
    n = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    block = lambda head, gloss: F.concat(F.lit("<hw>"), head, F.lit("</hw><pos>n.</pos><def>the "), gloss, F.lit("</def>"))
    rows = n.select(F.col("n_nationkey").cast("long").alias("ord"), block(letters("n_name"), F.lower(letters("r_name"))).alias("value"))
    rows = rows.union(n.select((F.col("r_regionkey") + 100).cast("long"), block(letters("r_name"), F.lit("zzz"))).distinct())
    return build.merged_graph(readers.gcide(rows)).edges


@query("scan_json_artifact", "SELECT 'nation-table/v1' AS artifact_id, n_name AS name, n_nationkey AS key FROM nation")
def scan_artifact(spark, d):
    rows = [{"name": r["n_name"], "key": int(r["n_nationkey"])} for r in X.table(spark, d, "nation").collect()]
    path = put(spark, "artifact.json", json.dumps({"artifact_id": "nation-table/v1", "rows": rows}, indent=1).encode())
    t = readers.json_artifact(spark, path, "artifact_id string, rows array<struct<name: string, key: int>>", "nation-table/v1")
    return t.select("artifact_id", F.inline("rows"))


@query("scan_sense_records", "SELECT 's' || n_nationkey AS sense_id, 'y' || n_regionkey AS source_synset, n_name AS form, lower(n_name) AS lemma, 'n' AS pos, 'of region ' || n_regionkey AS definition FROM nation")
def scan_senses(spark, d):
    rows = [{"sense_id": f"s{r['n_nationkey']}", "source_synset": f"y{r['n_regionkey']}", "form": r["n_name"], "lemma": r["n_name"].lower(), "pos": "n", "definition": f"of region {r['n_regionkey']}"} for r in X.table(spark, d, "nation").collect()]
    return readers.sense_records(spark, put(spark, "senses.json", json.dumps({"senses": rows}, indent=1).encode()))


@query("scan_lexicon", "SELECT lower(c_name) AS lemma, lower(c_mktsegment) AS pos, 'c' || c_custkey AS sense_id, unnest(CASE WHEN n_nationkey % 5 = 0 THEN [''] ELSE [n_name, 'region ' || n_regionkey] END) AS definition FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 1")
def scan_lexicon(spark, d):
    """Customers as senses of entries, nations as synsets with two definitions or none."""
    folder, c, n = shared_folder(spark), X.table(spark, d, "customer"), X.table(spark, d, "nation")
    c.select(F.col("c_custkey").alias("entry_id"), F.lower("c_mktsegment").alias("pos"), (F.col("c_custkey") % 2).alias("lexicon_id")).write.parquet(f"{folder}/entry.parquet")
    c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("sense_id"), F.col("c_custkey").alias("entry_id"), F.col("c_nationkey").alias("synset_id")).write.parquet(f"{folder}/sense.parquet")
    n.select(F.col("n_nationkey").alias("synset_id"), F.when(F.col("n_nationkey") % 5 != 0, F.array("n_name", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))).alias("definitions")).write.parquet(f"{folder}/synset.parquet")
    t = readers.lexicon(spark, folder)
    forms = c.select(F.col("c_custkey").alias("entry_id"), F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lower("c_name").alias("form")), F.struct(F.lit(1).alias("rank"), F.col("c_mktsegment").alias("form")))).alias("x")).select("entry_id", "x.*")
    return readers.senses_of(t["entry"], t["sense"], t["synset"], forms, 1)


@query("sink_csv", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, lower(c_mktsegment) || ';' || c_nationkey AS parts FROM customer")
def sink_csv(spark, d):
    path = shared_folder(spark)
    c = X.table(spark, d, "customer")
    writers.write_csv(c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 2 == 0).alias("even"), F.array(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("parts")), path)
    return spark.read.option("header", True).csv(path).fillna("")


@query("sink_layers_json", GRAPH_SQL["layers_from_given_seed"])
def sink_layers(spark, d):
    path = shared_folder(spark)
    writers.write_layers(layers(spark, d), path)
    return spark.read.schema("node string, layer int").json(path)


@query("sink_markdown", "SELECT n - 1 AS line, text FROM (SELECT 1 AS n, '# Orders' AS text UNION ALL SELECT 2, '' UNION ALL SELECT 3, '## status' UNION ALL SELECT 4, '' UNION ALL SELECT 5, '| o_orderstatus | n |' UNION ALL SELECT 6, '|---|---|' UNION ALL SELECT 6 + row_number() OVER (ORDER BY o_orderstatus), '| ' || o_orderstatus || ' | ' || count(*) || ' |' FROM orders GROUP BY o_orderstatus)")
def sink_markdown(spark, d):
    t = X.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus")
    text = writers.report("Orders", {"status": t}).rstrip("\n")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


#: Kernel, components and least seeds of small attack graphs.
SMALL = f"""{USERS}, re AS MATERIALIZED (WITH RECURSIVE p AS (SELECT src, dst FROM x UNION SELECT p.src, x.dst FROM p JOIN x ON p.dst = x.src) SELECT * FROM p),
kn AS MATERIALIZED (SELECT DISTINCT src AS node FROM re WHERE dst IN (SELECT src FROM re WHERE src = dst)),
sc AS MATERIALIZED (SELECT kn.node, least(kn.node, coalesce(min(m.dst), kn.node)) AS scc FROM kn LEFT JOIN (SELECT p.src AS node, p.dst FROM re p JOIN re q ON p.src = q.dst AND p.dst = q.src) m USING (node) GROUP BY kn.node),
hit AS (SELECT DISTINCT b.scc FROM x JOIN sc a ON a.node = x.src JOIN sc b ON b.node = x.dst WHERE a.scc <> b.scc),
an AS MATERIALIZED (SELECT src AS node FROM x UNION SELECT dst FROM x)"""


@query("sink_json_summary", f"""{SMALL}, v AS (SELECT (SELECT count(*) FROM an) AS nodes, (SELECT count(*) FROM x) AS edges, (SELECT count(*) FROM kn) AS kernel, (SELECT count(*) FROM sc WHERE scc NOT IN (SELECT scc FROM hit)) AS core, (SELECT count(DISTINCT scc) FROM sc) AS kernel_sccs)
SELECT unnest(['nodes', 'edges', 'kernel', 'core', 'satellites', 'kernel_sccs', 'kernel_fraction', 'core_fraction']) AS metric, round(unnest([nodes, edges, kernel, core, kernel - core, kernel_sccs, kernel / nodes, core / greatest(kernel, 1)]), 9) AS value FROM v""")
def sink_summary(spark, d):
    path = shared_folder(spark)
    _, e = X.user_attacks(spark, d)
    writers.write_json(writers.summary(structure.analyze(e, "exact-small-greedy"), e), path)
    t = spark.read.schema("metric string, value double").json(path)
    return t.where(~F.col("metric").isin("seed", "seed_fraction", "deepest_layer")).select("metric", F.round("value", 9).alias("value"))


@query("sink_progress", f"{SMALL} SELECT 'kernel' AS step, count(*) AS rows FROM kn UNION ALL SELECT 'scc', count(*) FROM sc UNION ALL SELECT 'edges', count(*) FROM x JOIN kn a ON a.node = x.src JOIN kn b ON b.node = x.dst UNION ALL SELECT 'membership', count(*) FROM an")
def sink_progress(spark, d):
    _, e = X.user_attacks(spark, d)
    return writers.progress(structure.analyze(e, "exact-small-greedy")).where(F.col("step").isin("kernel", "scc", "edges", "membership"))


@query("cli_summary", f"""{SMALL}, v AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT lower(translate(r_name, '0123456789_ ', 'abcdefghijkk')) FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT lower(translate(n_name, '0123456789_ ', 'abcdefghijkk')) FROM nation)) AS nodes, (SELECT count(*) FROM nation) AS edges)
SELECT unnest(['nodes', 'edges', 'kernel', 'seed']) AS metric, unnest([nodes, edges, 0, 0])::DOUBLE AS value FROM v""")
def cli_summary(spark, d):
    """A run over a lexicon of nations that are defined by their regions: no cycle, so no kernel."""
    from glossweave import cli

    letters = lambda c: F.lower(F.translate(F.col(c), "0123456789_ ", "abcdefghijkk"))
    n = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_nationkey").cast("long").alias("ord"), letters("n_name").alias("lemma"), F.lit("n").alias("pos"), letters("r_name").alias("definition"))
    rows = rows.union(n.select((F.col("r_regionkey") + 100).cast("long"), letters("r_name"), F.lit("n"), F.lit("zzz")).distinct())
    folder = shared_folder(spark)
    rows.write.parquet(f"{folder}/entries")
    cli.Run(f"{folder}/entries", f"{folder}/out", keep=("summary",)).go(spark)
    return spark.read.schema("metric string, value double").json(f"{folder}/out/summary").where(F.col("metric").isin("nodes", "edges", "kernel", "seed"))
