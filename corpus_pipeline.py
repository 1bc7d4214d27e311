"""The corpus pipeline: from raw documents to a mixed corpus that survives an exact tokenizer round trip.

Stages, each over all that the one before it kept: documents that score as toxic
go; repeated runs of lines are cut; of near-duplicates by five-word shingles one
stays (the stage keeps the name it had with SimHash);
sources are mixed to their targets; texts are encoded to byte-level BPE ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from glossweave.llm._shared import Scratch, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents at this score and above are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judge = F.pandas_udf(lambda texts: texts.map(model.score), "double")
    return docs.where(judge(F.col("text")) < TOXIC).select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated(docs, pairs=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word Jaccard of 0.8 and more, the one with the smallest doc_id, then text."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.public())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("SimHash near-dedup", keep_one),
    ("mixing", mix),
    ("BPE", tokenize),
]

#: Fitting, fingerprints and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
