"""Sinks: summaries, layers, CSV exports and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(analysis: dict[str, DataFrame], graph_edges: DataFrame) -> DataFrame:
    """``metric, value``: counts and shares of one analysis; a kernel's share is over at least 1."""
    m = analysis["membership"]
    n = m.agg(F.count("*").alias("nodes"), *[F.sum(F.col(c).cast("long")).alias(c[3:]) for c in ("is_kernel", "is_core", "is_satellite", "is_seed")], F.countDistinct("scc").alias("kernel_sccs"), F.coalesce(F.max("layer"), F.lit(0)).alias("deepest_layer"))
    e = graph_edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    r = n.crossJoin(e)
    k = F.greatest("kernel", F.lit(1))
    values = {"nodes": F.col("nodes"), "edges": F.col("edges"), "kernel": F.col("kernel"), "core": F.col("core"), "satellites": F.col("satellite"), "seed": F.col("seed"), "kernel_sccs": F.col("kernel_sccs"), "deepest_layer": F.col("deepest_layer"), "kernel_fraction": F.col("kernel") / F.col("nodes"), "core_fraction": F.col("core") / k, "seed_fraction": F.col("seed") / k}
    return r.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value")) for name, v in values.items()])).alias("x")).select("x.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_layers(layers: DataFrame, path: str) -> None:
    """Node to layer, in the order of nodes."""
    layers.select("node", "layer").orderBy("node").write.mode("overwrite").json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nulls as nothing, booleans as true and false, lists joined by semicolons."""
    return df.select(*[F.coalesce(F.array_join(F.col(c), ";") if kind.startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def markdown_table(df: DataFrame, rows: int = 25) -> str:
    """The first rows as a Markdown table; for aggregates, which are small."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]])


def report(title: str, sections: dict[str, DataFrame], rows: int = 25) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown_table(df, rows)}" for name, df in sections.items()]]) + "\n"


def progress(analysis: dict[str, DataFrame]) -> DataFrame:
    """``step, rows``: what a run has made, as events would say."""
    out = None
    for name, df in analysis.items():
        row = df.agg(F.lit(name).alias("step"), F.count("*").alias("rows"))
        out = row if out is None else out.union(row)
    return out
