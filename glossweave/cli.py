"""``python -m glossweave.cli``: analysis of a lexicon, written as tables and a report."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.operators import build, export, structure
from glossweave.operators.digraph import METHODS
from glossweave.operators.loops import cut
from glossweave.sources import readers, writers


def _as_senses(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("ord").cast("string").alias("node"), "lemma", "pos", F.col("ord").alias("rank"), "definition")


GRAPHS: dict[str, Callable[[DataFrame], build.LexicalGraph]] = {
    "lemma": build.lemma_graph,
    "paper": build.paper_graph,
    "merged": build.merged_graph,
    "sense": lambda e: build.sense_graph(_as_senses(e)),
    "synset": lambda e: build.synset_graph(_as_senses(e)),
}
POLICIES = ("source-union", "largest-scc")
#: What a run can leave in its folder.
OUTPUTS = ("summary", "membership", "layers", "loops", "degrees", "coverage", "components", "report")


@dataclass
class Run:
    """One analysis: where from, how, and what to keep of it."""

    entries: str
    out: str
    lexicon: str = "parquet"  # or "jsonl", lines of a dictionary dump
    graph: str = "paper"
    seeds: str = "bounded-scc"
    core: str = "source-union"
    norms: list[str] = field(default_factory=list)
    keep: tuple[str, ...] = ("summary", "membership", "layers")
    top: int = 25

    def read(self, spark: SparkSession) -> DataFrame:
        if self.lexicon == "jsonl":
            return readers.wiktextract_entries(readers.jsonl(spark, self.entries, readers.ENTRY))
        return spark.read.parquet(self.entries)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The outputs asked for; each is made only if it is."""
        g = GRAPHS[self.graph](self.read(spark))
        edges = cut(g.edges)
        a = structure.analyze(edges, self.seeds, self.core)
        marks = readers.annotations(spark, self.norms) if self.norms else None
        groups = lambda: a["membership"].select(F.explode(F.array_compact(F.array(F.lit("all"), *[F.when(F.col(f"is_{c}"), F.lit(c)) for c in ("kernel", "core", "satellite", "seed")]))).alias("component"), "node")
        make = {
            "summary": lambda: writers.summary(a, edges),
            "membership": lambda: a["membership"],
            "layers": lambda: a["layers"],
            "loops": lambda: structure.loop_report(edges)["totals"],
            "degrees": lambda: structure.top_degrees(structure.degrees(edges), self.top),
            "coverage": lambda: export.coverage(structure.all_nodes(edges), marks),
            "components": lambda: export.component_summary(groups(), marks),
        }
        asked = OUTPUTS[:-1] if "report" in self.keep else self.keep
        return {name: make[name]() for name in asked if marks is not None or name not in ("coverage", "components")}

    def go(self, spark: SparkSession) -> dict[str, DataFrame]:
        made = self.tables(spark)
        for name, table in made.items():
            if name not in self.keep:
                continue
            if name == "layers":
                writers.write_layers(table, f"{self.out}/layers")
            elif name == "membership":
                writers.write_csv(table, f"{self.out}/membership")
            else:
                writers.write_json(table, f"{self.out}/{name}")
        if "report" in self.keep:
            small = {name: t for name, t in made.items() if name not in ("membership", "layers")}
            layers = made["layers"].groupBy("layer").agg(F.count("*").alias("nodes")).orderBy("layer")
            text = writers.report(f"{self.graph} graph", {**small, "layers": layers}, self.top)
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/report")
        return made


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossweave", description=__doc__)
    p.add_argument("entries", help="table with ord, lemma, pos, definition, or a dictionary dump (--lexicon jsonl)")
    p.add_argument("out", help="folder for what is kept")
    for name, values in (("lexicon", ("parquet", "jsonl")), ("graph", sorted(GRAPHS)), ("seed-method", sorted(METHODS)), ("core-policy", POLICIES)):
        p.add_argument(f"--{name}", choices=values, default={"graph": "paper", "seed-method": "bounded-scc"}.get(name, values[0]))
    p.add_argument("--norms", action="append", default=[], metavar="CSV", help="values of words; repeat for more files, later ones win")
    p.add_argument("--keep", action="append", choices=OUTPUTS, help="what to write; repeat for more (default: summary, membership, layers)")
    p.add_argument("--top", type=int, default=25, help="rows of a table in the report and of degrees")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run = Run(a.entries, a.out, a.lexicon, a.graph, a.seed_method, a.core_policy, a.norms, tuple(a.keep or Run.keep), a.top)
    run.go(SparkSession.builder.getOrCreate())


if __name__ == "__main__":
    main()
