"""Entries that arrive as files: a stream that keeps the token edges of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.functions import text as T

ENTRY = "ord long, lemma string, pos string, definition string"


def entries(spark: SparkSession, folder: str, schema: str = ENTRY) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def defining_tokens(stream: DataFrame) -> DataFrame:
    """``src, dst``: content tokens of each definition with the entry's node; for streams and tables alike."""
    token = F.explode(F.array_distinct(T.content_tokens(F.col("definition"))))
    return stream.select(token.alias("src"), T.node_key(F.col("lemma"), F.col("pos")).alias("dst"))


def keep_edges(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's edges as Parquet, once (the batch id is part of the path)."""

    def write(batch: DataFrame, number: int) -> None:
        defining_tokens(batch).distinct().write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total``: tumbling windows with a watermark over ``(ts, event_type, value)``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
