"""Sources: lexicon tables, entry files, norms, word lists, markup, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as X

from glossweave.functions import text as T
from glossweave.operators.loops import shared_folder

ENTRY = "word string, pos string, lang_code string, senses array<struct<glosses: array<string>>>"
FIELDS = ("frequency", "age_of_acquisition", "concreteness")
KEYS = ("word", "lemma", "term", "node", "key")


def lexicon(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``entry, sense, synset`` as Parquet below the folder."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("entry", "sense", "synset")}


def senses_of(entry: DataFrame, sense: DataFrame, synset: DataFrame, forms: DataFrame, lexicon_id: int | None = None) -> DataFrame:
    """``lemma, pos, sense_id, definition``: senses with their entry's first form and each definition of their synset ('' without one).

    ``forms(entry_id, rank, form)``; ``synset(synset_id, definitions ARRAY)``. k definitions make k rows.
    """
    e = entry if lexicon_id is None else entry.where(F.col("lexicon_id") == lexicon_id)
    d = synset.select("synset_id", F.explode_outer("definitions").alias("definition"))
    first = forms.where("rank = 0").select("entry_id", F.col("form").alias("lemma"))
    return sense.join(e.select("entry_id", "pos"), "entry_id").join(first, "entry_id").join(d, "synset_id", "left").select("lemma", "pos", "sense_id", F.coalesce("definition", F.lit("")).alias("definition"))


def jsonl(spark: SparkSession, path: str, schema: str | X.StructType) -> DataFrame:
    """A line an object, plain or gzipped; blank lines are skipped, a malformed one is an error. A file from elsewhere is staged first."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stage(spark: SparkSession, url: str) -> str:
    """A copy of what a URL names in the folder that all executors share, streamed by the driver's JVM; its path keeps the file's name, so ``.gz`` is read as such."""
    path = f"{shared_folder(spark)}/{url.rstrip('/').rpartition('/')[2] or 'file'}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI(url).toURL().openStream(), target.getFileSystem(conf).create(target), conf, True)
    return path


def jsonl_url(spark: SparkSession, url: str, schema: str | X.StructType) -> DataFrame:
    """``jsonl`` of a file behind a URL, gzipped or not, staged first."""
    return jsonl(spark, stage(spark, url), schema)


def glosses(sense: F.Column) -> F.Column:
    """Non-blank glosses of one sense, trimmed; none where there is no list."""
    return F.coalesce(F.filter(F.transform(sense["glosses"], lambda g: F.trim(g)), lambda g: g.isNotNull() & (g != "")), F.array().cast("array<string>"))


def wiktextract_entries(rows: DataFrame, max_entries: int | None = None) -> DataFrame:
    """``ord, lemma, pos, definition``: English rows with a word, a pos and a gloss; all glosses of a row joined with `` ; ``.

    ``rows`` may bring the file order as ``ord``, without which it is the scan's.
    ``max_entries`` takes the first by it.
    """
    ordered = rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    g = F.flatten(F.transform("senses", glosses))
    kept = ordered.where((F.col("lang_code") == "en") & filled("word") & filled("pos")).withColumn("g", g).where(F.size("g") > 0)
    if max_entries is not None:
        kept = kept.orderBy("ord").limit(max_entries)
    return kept.select("ord", T.normalize_lemma(F.col("word")).alias("lemma"), T.wiktextract_pos(F.col("pos")).alias("pos"), F.array_join("g", " ; ").alias("definition"))


def _named(header: list[str], wanted: str) -> str | None:
    """The column that goes by the name: in any case, with underscores, blanks or neither."""
    plain = {h.strip().lower(): h for h in header}
    for name in (wanted, wanted.replace("_", ""), wanted.replace("_", " ")):
        if name in plain:
            return plain[name]
    return None


def _csv(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.option("header", True).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return df


def annotations(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, field, value`` from CSV files; missing files and values that are no number are skipped, later rows and files win."""
    parts = []
    for k, path in enumerate(paths):
        df = _csv(spark, path)
        if df is None:
            continue
        key = next((c for c in (_named(df.columns, n) for n in KEYS) if c), None)
        found = {f: c for f in fields if (c := _named(df.columns, f))}
        if not key or not found:
            continue
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{c}`").try_cast("double").alias("value")) for f, c in found.items()])
        rows = df.select(T.normalize_lemma(F.col(f"`{key}`")).alias("key"), F.explode(pairs).alias("p"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.where("p.value is not null and key <> ''").select("key", "p.field", "p.value", F.lit(k).alias("file"), "row"))
    if not parts:
        return spark.createDataFrame([], "key string, field string, value double")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("key", "field").agg(F.max_by("value", F.struct("file", "row")).alias("value"))


def norms(spark: SparkSession, path: str, first_wins: bool = False) -> DataFrame:
    """``word, metric, value``: the key column and the first other one. Of duplicates the last counts, or with ``first_wins`` the first (as sheets have it)."""
    df = _csv(spark, path)
    if df is None:
        return spark.createDataFrame([], "word string, metric string, value double")
    key = next((c for c in (_named(df.columns, n) for n in KEYS[:3]) if c), df.columns[0])
    metric = next(c for c in df.columns if c != key)
    rows = df.select(T.normalize_lemma(F.col(f"`{key}`")).alias("word"), F.col(f"`{metric}`").try_cast("double").alias("value"), F.monotonically_increasing_id().alias("row")).where("value is not null and not isnan(value) and abs(value) <> double('infinity')")
    pick = F.min_by if first_wins else F.max_by
    return rows.groupBy("word").agg(pick("value", "row").alias("value")).select("word", F.lit(metric.strip().lower()).alias("metric"), "value")


def norms_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """``word, metric, value`` from workbooks: the first row names the columns, of duplicates the first counts, values that are no finite number are skipped.

    A workbook is one archive of XML, so each file is one row's work.
    """

    def cells(data: bytes) -> list[list[str | None]]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        book = zipfile.ZipFile(io.BytesIO(data))
        tag = lambda e: e.tag.rpartition("}")[2]
        text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        rows = []
        for row in (e for e in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter() if tag(e) == "row"):
            out: dict[int, str] = {}
            for c in row:
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(out)
                value = next((v.text for v in c if tag(v) == "v"), None)
                out[at] = shared[int(value)] if c.get("t") == "s" else text(c) if c.get("t") == "inlineStr" else value
            rows.append([out.get(k) for k in range(max(out, default=-1) + 1)])
        return rows

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, data in zip(pdf.path, pdf.content):
                header, *body = cells(data) or [[]]
                plain = [(h or "").strip().lower() for h in header]
                key = next((plain.index(k) for k in KEYS[:3] if k in plain), 0)
                rest = [k for k in range(len(plain)) if k != key and plain[k]]
                rows += [(name, n, r[key], plain[k], r[k]) for n, r in enumerate(body) for k in rest[:1] if len(r) > max(k, key)]
            yield pd.DataFrame(rows, columns=["path", "n", "word", "metric", "value"])

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, n long, word string, metric string, value string")
    rows = read.select(T.normalize_lemma(F.col("word")).alias("word"), "metric", F.col("value").try_cast("double").alias("value"), F.struct("path", "n").alias("row")).where("word <> '' and value is not null and not isnan(value) and abs(value) <> double('infinity')")
    return rows.groupBy("word", "metric").agg(F.min_by("value", "row").alias("value"))


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """``word, ord``: normalised, each once, at its first line."""
    lines = spark.read.text(path).select(T.normalize_lemma(F.col("value")).alias("word"), F.monotonically_increasing_id().alias("row")).where("word <> ''")
    first = lines.groupBy("word").agg(F.min("row").alias("row"))
    return first.select("word", (F.row_number().over(W.orderBy("row")) - 1).alias("ord"))


def _tag(block: F.Column, tag: str) -> F.Column:
    """What is between the tag's first pair, without inner tags, white space collapsed."""
    inner = F.regexp_extract(block, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))


def gcide(blocks: DataFrame, column: str = "value") -> DataFrame:
    """``ord, lemma, pos, definition`` from blocks ``(ord, <column>)`` of dictionary markup with hw, pos and def tags; adverbs are told before adjectives."""
    b = F.col(column)
    pos = F.lower(_tag(b, "pos"))
    bucket = F.when(pos.startswith("adv"), "r").when(pos.startswith("a"), "a").when(pos.startswith("n"), "n").when(pos.startswith("v"), "v").otherwise("x")
    head = T.normalize_lemma(F.regexp_replace(_tag(b, "hw"), r"[\"*`|]", ""))
    defs = F.filter(F.transform(F.regexp_extract_all(b, F.lit(r"(?s)<def>(.*?)</def>"), F.lit(1)), lambda d: F.trim(F.regexp_replace(F.regexp_replace(d, r"<[^>]*>", " "), r"\s+", " "))), lambda d: d != "")
    return blocks.select("ord", head.alias("lemma"), bucket.alias("pos"), F.array_join(defs, " ; ").alias("definition")).where("lemma <> '' and definition <> ''")


def gcide_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "<p>").text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def gcide_archive(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value``: blocks of the files of ``.tar.xz`` archives in Latin-1, in the order of files and blocks; an archive is one row's work."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
                    for k, member in enumerate(sorted((m for m in archive if m.isfile()), key=lambda m: m.name)):
                        blocks = archive.extractfile(member).read().decode("latin-1").split("<p>")
                        yield pd.DataFrame({"path": name, "k": k, "n": range(len(blocks)), "value": blocks})

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, k long, n long, value string")
    return read.select(F.struct("path", "k", "n").alias("ord"), "value")


def gcide_entries(blocks: DataFrame, column: str = "value") -> DataFrame:
    """``ord, lemma, pos, definition``: one row a headword and pos, its blocks' definitions in order."""
    one = gcide(blocks, column)
    return one.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct("ord", "definition"))).alias("d")).select(F.get("d", F.lit(0))["ord"].alias("ord"), "lemma", "pos", F.array_join(F.transform("d", lambda x: x["definition"]), " ; ").alias("definition"))


def json_artifact(spark: SparkSession, path: str, schema: str, artifact_id: str) -> DataFrame:
    """One JSON object with a fixed schema; an error if it names another artifact."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("artifact_id") == artifact_id, F.col("artifact_id")).otherwise(F.raise_error(F.concat(F.lit(f"not a {artifact_id}: "), F.coalesce("artifact_id", F.lit("none")))))
    return df.withColumn("artifact_id", checked)


def sense_records(spark: SparkSession, path: str) -> DataFrame:
    """``sense_id, source_synset, form, lemma, pos, definition`` from an object with a list of senses."""
    s = "struct<sense_id: string, source_synset: string, form: string, lemma: string, pos: string, definition: string>"
    return spark.read.schema(f"senses array<{s}>").option("multiLine", True).json(path).select(F.inline("senses"))
