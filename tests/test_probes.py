import io
import random
import zipfile

import pytest

from glossweave.operators import argument, build, digraph, probe
from glossweave.sources import readers


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def names(spark, *nodes):
    return spark.createDataFrame([(v,) for v in nodes], "node string")


def test_component_probe_statuses(spark):
    e = frame(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "x"), ("x", "leaf")])
    got = {r.scc: (r.size, r.kind, r.status) for r in probe.component_probe(e).collect()}
    assert got == {"a": (2, "component", "sat"), "c": (1, "self-loop", "unsat"), "x": (3, "component", "unsat"), "s": (1, "single", "sat")}
    big = frame(spark, [(f"n{k}", f"n{j}") for k in range(9) for j in range(9) if k != j])
    assert {r.status for r in probe.component_probe(big, budget=0).collect()} == {"skipped"}


def test_probe_and_time_box(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("d", "d"), ("e", "f"), ("f", "e")])
    args = names(spark, *"abcdef")
    r = probe.probe(args, e).first()
    assert (r.arguments, r.attacks, r.grounded_in, r.grounded_out, r.stable) == (6, 5, 2, 1, False)
    assert probe.probe(names(spark, *"abcef"), e).first().stable is True
    labels, how = probe.grounded_within(args, e, 600)
    assert how["finished"] and {x.node for x in labels.where("label = 'in'").collect()} == {"a", "c"}
    assert probe.grounded_within(args, e, -1)[0] is None
    nodes, inside = probe.largest_scc_framework(e)
    assert sorted(x.node for x in nodes.collect()) == ["e", "f"] and inside.count() == 2


def test_preferred_and_enforced(spark):
    e = frame(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c")])
    got = {r.part: (r.n_extensions, list(r.in_all)) for r in probe.preferred_parts(names(spark, *"abcdef"), e).collect()}
    assert sorted(got.values()) == [(1, []), (1, ["f"]), (2, [])]
    assert [r.cost for r in probe.enforced(names(spark, *"ab"), frame(spark, [("a", "b"), ("b", "a")]), "a").collect()] == [1]
    g = digraph.graph_of("ab", [("a", "b"), ("b", "a")])
    assert len(argument.enforce_skeptical(g, "a", 1)) == 1


def test_bipolar_ranking(spark):
    supports, attacks = frame(spark, [("a", "b"), ("a", "c"), ("b", "c")]), frame(spark, [("d", "a")])
    table, pairs = probe.bipolar_ranking(supports, attacks)
    got = {r.node: (r.support, r.both, r.attackers) for r in table.collect()}
    assert got["a"] == (1.0, 0.5, 1) and got["d"] == (1.0, 1.0, 0) and got["c"][2] == 2
    assert {r.pair for r in pairs.collect()} == {"support-attackers", "both-attackers", "support-both"}
    assert set(probe.frameworks(supports, attacks)) == {"dung", "support", "both"}


def test_greedy_seeds_on_bits_and_on_sets():
    for k in range(60):
        rng = random.Random(k)
        nodes = [f"n{j:02d}" for j in range(rng.randint(1, 40))]
        g = digraph.graph_of(nodes, [(rng.choice(nodes), rng.choice(nodes)) for _ in range(int(len(nodes) * rng.uniform(0.5, 5)))])
        for limit in (2, 6):
            a, b = digraph.exact_small_greedy(g, limit), digraph._exact_small_greedy_sets(g, limit)
            assert sorted(a["seed"]) == sorted(b["seed"]) and a["exact"] == b["exact"]
            assert digraph.acyclic(digraph.without(g, a["seed"]))


def test_synset_signatures_are_without_the_lemma(spark):
    rows = [("t", "run", "v", 0, "bank of stone"), ("m1", "bank", "n", 1, "money house"), ("m2", "bank", "n", 2, "stone slope")]
    s = spark.createDataFrame(rows, "node string, lemma string, pos string, rank int, definition string")
    assert {(r.src, r.dst) for r in build.synset_graph(s).edges.collect()} == {("m2", "t")}


def test_workbook(spark, tmp_path):
    cells = [("A1", "Lemma"), ("B1", "Arousal"), ("A2", "Two-Words"), ("B2", 1.5), ("A3", "two words"), ("B3", 9), ("A4", "none"), ("A5", "bad"), ("B5", "x")]
    rows = {}
    for at, v in cells:
        rows.setdefault(int(at[1:]), []).append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>')
    body = "".join(f'<row r="{k}">{"".join(x)}</row>' for k, x in rows.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    assert [tuple(r) for r in readers.norms_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [("two_words", "arousal", 1.5)]


def test_shared_folder_is_named_on_a_cluster(spark):
    from glossweave.operators.loops import shared_folder

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Fake())
    assert shared_folder(spark) != shared_folder(spark)
