"""Text functions, rules, sources, sinks, logic, statistics and the stream, on small tables with known answers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from glossweave import cli
from glossweave.functions import text as T
from glossweave.operators import admission, build, cluster, ground, lexicality, logic, stats
from glossweave.sources import readers, writers
from glossweave.streaming import ingest


def values(spark, column, rows):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    return [r.v for r in df.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_text(spark):
    assert values(spark, T.normalize_lemma, [" Don't-Stop now ", "A"]) == ["dont_stop_now", "a"]
    assert values(spark, T.basic_tokens, ["It's a DOG-house 2x", ""]) == [["its", "a", "dog", "house", "x"], []]
    assert values(spark, T.case_pattern, ["123", "abc", "ABC", "Abc", "aBc", "I", "I'm"]) == ["uncased", "lower", "upper", "title", "mixed", "upper", "title"]
    assert values(spark, T.truncate_text, ["a  b\n c", "x" * 80]) == ["a b c", "x" * 69 + "..."]
    assert values(spark, T.boolish, [" TRUE ", "1", None]) == [True, False, False]
    assert values(spark, T.wiktextract_pos, ["Proper-Noun", "verb", "det", "adverb", "particle"]) == ["n", "v", "a", "r", "x"]
    assert [tuple(r) for r in values(spark, T.split_node, ["a::b::n"])] == [("a::b", "n")]
    d = spark.createDataFrame([("center", "centre"), ("kitten", "sitting"), ("abcdef", "uvwxyz")], "a string, b string")
    assert [r.d for r in d.select(T.levenshtein_capped(F.col("a"), F.col("b"), 3).alias("d")).collect()] == [2, 3, 4]
    with pytest.raises(Exception, match="no '::'"):
        values(spark, T.split_node, ["plain"])


def match(text, lemmas, n=3):
    """The rule, said plainly."""
    import re

    from glossweave.functions.words import STOPWORDS, TOKEN

    w = [(r, r.lower().replace("'", "")) for r in re.findall(TOKEN, text)]
    w = [p for p in w if p[1] not in STOPWORDS]
    i, out = 0, []
    while i < len(w):
        wide = next((k for k in range(n, 1, -1) if i + k <= len(w) and all(r[0].isupper() for r, _ in w[i : i + k])), 0)
        hit = next((k for k in range(n, 0, -1) if i + k <= len(w) and "_".join(t for _, t in w[i : i + k]) in lemmas), 0)
        if not wide and hit:
            out.append("_".join(t for _, t in w[i : i + hit]))
        i += wide or hit or 1
    return out


def test_longest_match(spark):
    lemmas = {"ice", "ice_cream", "cream", "cone", "ice_cream_cone", "new", "york", "ball_game", "don't".replace("'", "")}
    texts = ["ice of cream cone and ice", "New York ice Cream", "a ball in the game", "", "the of", "ice cream ice cream cone cone", "don't New ice", "New York City ice"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {k: [] for k in range(len(texts))}
    for r in build.longest_matches(t, spark.createDataFrame([(x,) for x in lemmas], "lemma string"), "k").orderBy("k", "occ").collect():
        got[r.k].append(r.candidate)
    assert got == {k: match(x, lemmas) for k, x in enumerate(texts)}


def test_sense_graph(spark):
    s = spark.createDataFrame([("s1", "bank", "n", 1, "money house"), ("s2", "bank", "n", 2, "river side"), ("s3", "loan", "n", 1, "money from bank"), ("s4", "bank", "v", 3, "bank money"), ("s5", "fish", "n", 1, "bank")], "node string, lemma string, pos string, rank int, definition string")
    plain, low = build.sense_graph(s), build.sense_graph(s, fallback=True)
    assert {(r.src, r.dst) for r in plain.edges.collect()} == {("s1", "s3"), ("s1", "s4")}
    assert {(r.src, r.dst) for r in low.edges.collect()} == {("s1", "s3"), ("s1", "s4"), ("s1", "s5")}
    assert {r.resolution: r.n for r in plain.counters.collect()} == {"same_pos_overlap": 1, "any_pos_overlap": 1, "ambiguous": 1}


def test_variants_and_clusters(spark):
    words = "color colour colon center centre theater travel traveled travelled judgment judgement organize organise gray grey anaemia anemia xvi kibit bcd focused focussed calibre caliber".split()
    df = spark.createDataFrame([(w,) for w in words], "lemma string")
    got = {(r.a, r.b): r.rules for r in cluster.candidate_pairs(df).collect()}
    assert got[("color", "colour")] == ["spelling.or_our"] and got[("colon", "color")] == ["edit-distance"]
    for pair, rule in [(("center", "centre"), "er_re"), (("traveled", "travelled"), "doubled_consonant"), (("judgement", "judgment"), "dropped_e"), (("organise", "organize"), "ize_ise"), (("gray", "grey"), "lexical_pairs"), (("anaemia", "anemia"), "ae_e"), (("focused", "focussed"), "doubled_consonant"), (("caliber", "calibre"), "er_re")]:
        assert f"spelling.{rule}" in got[pair], pair
    assert not any("xvi" in p or "kibit" in p for p in got)
    senses = spark.createDataFrame([("a1", "color", "n", "visual hue property"), ("b1", "colour", "n", "visual hue property light"), ("c1", "colon", "n", "punctuation mark")], "sense_id string, lemma string, pos string, definition string")
    gated = cluster.gloss_gate(cluster.candidate_pairs(senses.select("lemma")), senses)
    c = cluster.clusters(gated.where("accepted")).collect()
    assert [(r.ic_id, r.forms) for r in c] == [("ic:color", ["color", "colour"])]
    ics = cluster.ic_of(spark.createDataFrame([("Colour",), ("dog",)], "form string"), cluster.clusters(gated.where("accepted")))
    assert {r.form: r.ic_id for r in ics.collect()} == {"Colour": "ic:color", "dog": "ic:dog"}


def test_lexicality(spark):
    rows = [("H2O", "n", "water", "chemical"), ("a", "x", "article", "lexical-word"), ("No", "n", "an element", "symbol-code"), ("NATO", "n", "acronym for a treaty", "abbreviation"), ("q", "n", "letter", "symbol-code"), ("vector", "n", "in mathematics, a directed quantity", "technical-term"), ("bless_her_heart", "n", "idiomatic pity", "construction"), ("ouch", "n", "an exclamation of pain", "idiom"), ("lawful", "a", "conforming", "lexical-word"), ("rosa", "n", "genus of plants", "taxon"), ("thing", "x", "object", "uncertain")]
    df = spark.createDataFrame([r[:3] for r in rows], "lemma string, pos string, definition string")
    assert {r.lemma: r.lexicality for r in lexicality.classify(df).collect()} == {r[0]: r[3] for r in rows}
    m = df.withColumn("m", F.struct(F.lit("proper-name").alias("class"), F.lit(0.3).alias("probability")))
    assert {r.reason for r in lexicality.classify(m, "m").where("lemma = 'thing'").collect()} == {"trained.lowconf.p0.30"}


def test_admission(spark):
    rows = [
        ("ic:dog", "d1", "dog", "animal", "lexical-word", ["surface.short_token_whitelist"]),
        ("ic:no", "n1", "no", "element", "lexical-word", ["trained.proper-name.p0.41"]),
        ("ic:xx", "x1", "xx", "code", "symbol-code", ["surface.code_case"]),
        ("ic:gap", "g1", "gap", "", "lexical-word", ["fallback.pos_default"]),
        ("ic:uh", "u1", "uh", "noise", "uncertain", ["trained.lowconf.p0.20"]),
        ("ic:hot", "h1", "hot dog", "food", "phrase", ["trained.phrase.p0.90"]),
    ]
    f = admission.facts(admission.group(spark.createDataFrame(rows, "ic_id string, sense_id string, form string, definition string, lexicality string, reasons array<string>")))
    v = {r.ic_id: r for r in admission.evaluate(f).collect()}
    assert {k: r.decision for k, r in v.items()} == {"ic:dog": "admit", "ic:no": "exclude", "ic:xx": "exclude", "ic:gap": "quarantine", "ic:uh": "uncertain", "ic:hot": "uncertain"}
    assert v["ic:no"].defeated == ["r_quarantine_low_conf", "r_admit_lexical"] and v["ic:dog"].aliases == ["dog"] and v["ic:uh"].fired == ["r_uncertain"]
    wide = {r.ic_id: r.decision for r in admission.evaluate(f, expanded=True).collect()}
    assert wide["ic:hot"] == "admit"


def test_grounding(spark):
    senses = spark.createDataFrame([("a", "A", 0), ("b", "B", 1), ("c", "C", 2), ("c2", "C", 2), ("d", "D", 2)], "node string, ic string, layer int")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c2"), ("b", "d"), ("a", "d")], "src string, dst string")
    every, seeds = ground.unfold(senses, e, spark.createDataFrame([("A",)], "ic string"))
    got = {}
    for r in every.collect():
        got.setdefault(r.node, set()).add(r.ic)
    assert got == {"a": {"A"}, "b": {"A"}, "c": {"A", "B"}, "d": {"A", "B"}}
    need = spark.createDataFrame([("b", "A"), ("c", "B"), ("d", "X")], "node string, ic string")
    s = senses.select("node", "ic", F.lit(False).alias("truncated"))
    assert {r.ic for r in ground.groundable(spark.createDataFrame([("A",)], "ic string"), s, need).collect()} == {"A", "B", "C"}
    h = ground.entropy(spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "s string, n long")).first()
    assert abs(h.h - 1.5) < 1e-9 and h.rows == 4
    assert values(spark, lambda c: ground.coarsen(c, {"closed": "closed", "*": "open"}), ["closed", "artifact"]) == ["closed", "open"]


def test_logic(spark):
    df = spark.createDataFrame([(4,), (3,), (None,)], "v int")
    run = lambda e, senses=logic.NUMERIC: [r.x for r in df.select(logic.compile_to_column(e, senses, F.col("v")).alias("x")).collect()]
    assert run(logic.Reference("odd")) == [False, True, None]
    assert run(logic.Predicate("nothing", 1)) == [None] * 3 and run(logic.Reference("a"), {"a": logic.Not(logic.Reference("a"))}) == [None] * 3
    assert run(logic.Predicate("divisible_by", 0)) == [None] * 3
    assert logic.erase_operators(logic.Not(logic.Or(logic.Predicate("x", 1), logic.Not(logic.Predicate("y", 2))))) == logic.And(logic.Predicate("x", 1), logic.Predicate("y", 2))


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, float(x % 3)) for x in range(20)], "x double, y double, z double")
    m = stats.ols(df, "y", ["x", "z"])
    assert abs(m["r2"] - 1) < 1e-9 and abs(m["coefficients"]["x"] - 2) < 1e-9
    z = [r.x_z for r in stats.zscore(df, ["x"]).collect()]
    assert abs(sum(z)) < 1e-9 and abs(sum(v * v for v in z) / 20 - 1) < 1e-9
    one, two = spark.createDataFrame([(k, 5 - abs(k - 5)) for k in range(1, 10)], "x int, n int"), spark.createDataFrame([(0, 50), (1, 1), (9, 1), (10, 50)], "x int, n int")
    assert stats.dip(one, "x") < stats.dip(two, "x")


def test_sources_and_sinks(spark, tmp_path):
    lines = [{"word": "Dog", "pos": "noun", "lang_code": "en", "senses": [{"glosses": [" animal ", ""]}, {"glosses": ["pet"]}]}, {"word": "x", "pos": "noun", "lang_code": "fr", "senses": [{"glosses": ["y"]}]}, {"word": "Run", "pos": "verb", "lang_code": "en", "senses": [{}]}, {"word": "cat", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["feline"]}]}]
    path = tmp_path / "w.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n\n".join(map(json.dumps, lines)))
    rows = readers.jsonl(spark, str(path), readers.ENTRY)
    assert [(r.lemma, r.pos, r.definition) for r in readers.wiktextract_entries(rows).orderBy("ord").collect()] == [("dog", "n", "animal ; pet"), ("cat", "n", "feline")]
    assert readers.wiktextract_entries(rows, 1).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"word": 1,')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), readers.ENTRY).collect()
    (tmp_path / "a.csv").write_text("Word,Frequency,AgeOfAcquisition\nDog,1,2\ndog,x,3\ncat,5,\n")
    (tmp_path / "b.csv").write_text("lemma,concreteness\ndog,4.5\n")
    got = {(r.key, r.field): r.value for r in readers.annotations(spark, [str(tmp_path / n) for n in ("a.csv", "none.csv", "b.csv")]).collect()}
    assert got == {("dog", "frequency"): 1.0, ("dog", "age_of_acquisition"): 3.0, ("cat", "frequency"): 5.0, ("dog", "concreteness"): 4.5}
    (tmp_path / "n.csv").write_text("term,score\na,1\na,2\n")
    assert readers.norms(spark, str(tmp_path / "n.csv")).first().value == 2 and readers.norms(spark, str(tmp_path / "n.csv"), first_wins=True).first().value == 1
    (tmp_path / "words.txt").write_text("The\n\ndog\nthe\n")
    assert [(r.word, r.ord) for r in readers.wordlist(spark, str(tmp_path / "words.txt")).orderBy("ord").collect()] == [("the", 0), ("dog", 1)]
    (tmp_path / "g.txt").write_text("<p><hw>A*base\"</hw> <pos>v. t.</pos> <def>To <i>lower</i>.</def> <def>Cast down.</def><p><hw>Fast</hw><pos>adv.</pos><def>Quickly</def>")
    got = readers.gcide(readers.gcide_blocks(spark, str(tmp_path / "g.txt"))).orderBy("ord").collect()
    assert [(r.lemma, r.pos, r.definition) for r in got] == [("abase", "v", "To lower . ; Cast down."), ("fast", "r", "Quickly")]
    (tmp_path / "s.json").write_text(json.dumps({"artifact_id": "x", "senses": [{"sense_id": "e", "form": "even"}]}))
    assert readers.sense_records(spark, str(tmp_path / "s.json")).first().form == "even"
    with pytest.raises(Exception, match="not a y"):
        readers.json_artifact(spark, str(tmp_path / "s.json"), "artifact_id string", "y").collect()
    out = writers.csv_ready(spark.createDataFrame([(None, True, ["a", "b"])], "a string, b boolean, c array<string>")).first()
    assert tuple(out) == ("", "true", "a;b")
    assert "| a |" in writers.report("T", {"s": spark.createDataFrame([("a",)], "x string")})


def test_cli_and_stream(spark, tmp_path):
    rows = [(1, "cat", "n", "small dog animal"), (2, "dog", "n", "large cat animal"), (3, "animal", "n", "living being"), (4, "kitten", "n", "young cat")]
    spark.createDataFrame(rows, "ord long, lemma string, pos string, definition string").write.parquet(str(tmp_path / "e"))
    cli.main([str(tmp_path / "e"), str(tmp_path / "out"), "--seed-method", "exact-small-greedy"])
    summary = {r.metric: r.value for r in spark.read.json(str(tmp_path / "out/summary")).collect()}
    assert summary["nodes"] == 4 and summary["kernel"] == 3 and summary["seed"] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(dict(zip(("ord", "lemma", "pos", "definition"), r))) for r in rows))
    q = ingest.keep_edges(ingest.entries(spark, str(tmp_path / "in")), str(tmp_path / "edges"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert ("cat", "kitten::n") in {(r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "edges")).collect()}


def test_closures_beyond_the_most_ids_are_truncated(spark):
    senses = spark.createDataFrame([(f"n{k}", f"c{k}", 0 if k else 1) for k in range(5)], "node string, ic string, layer int")
    edges = spark.createDataFrame([(f"n{k}", "n0") for k in range(1, 5)], "src string, dst string")
    seeds = senses.where("layer = 0").select("ic")
    closure, seed_closure = ground.unfold(senses, edges, seeds)
    for most, cut_off in ((3, True), (4, False), (500, False)):
        rows = {r.node: r for r in ground.index_rows(senses, closure, seed_closure, most).collect()}
        assert rows["n0"].closure_size == 4 and rows["n0"].closure_truncated == cut_off and len(rows["n0"].closure_ids) == min(most, 4)
        assert not rows["n1"].closure_truncated and rows["n1"].closure_size == 1


def test_cli_outputs(spark, tmp_path):
    rows = [{"word": w, "pos": "noun", "lang_code": "en", "senses": [{"glosses": [g]}]} for w, g in (("cat", "small dog animal"), ("dog", "large cat animal"), ("animal", "living being"), ("kitten", "young cat"))]
    (tmp_path / "dump.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.csv").write_text("Word,Frequency\ncat,1\ndog,2\n")
    (tmp_path / "b.csv").write_text("lemma,frequency\ndog,4\n")
    out = tmp_path / "out"
    keep = [x for name in cli.OUTPUTS for x in ("--keep", name)]
    cli.main([str(tmp_path / "dump.jsonl"), str(out), "--lexicon", "jsonl", "--seed-method", "exact-small-greedy", "--norms", str(tmp_path / "a.csv"), "--norms", str(tmp_path / "b.csv"), "--top", "2", *keep])
    read = lambda name: spark.read.json(str(out / name)).collect()
    assert {r.metric: r.value for r in read("loops")}["two_cycles"] == 1
    assert len(read("degrees")) == 2
    assert [(r.field, r.covered, r.total) for r in read("coverage")] == [("frequency", 2, 4)]
    assert {r.component: (r.n, r["mean"]) for r in read("components")}["kernel"] == (2, 2.5)
    text = "\n".join(r.value for r in spark.read.text(str(out / "report")).collect())
    assert text.startswith("# paper graph") and "## coverage" in text and "## layers" in text
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "y", "--keep", "nothing"])
