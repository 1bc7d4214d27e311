"""Shared plumbing of the corpus operators: lineage cuts on the cluster's shared folder.

Executors can be lost at any time, so nothing here keeps data only in an
executor: intermediate tables are Parquet below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="glossweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call, below the shared folder.

    ``table`` writes and rereads, which cuts the lineage; ``drop`` frees one that
    nothing reads any more; what is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _FOLDERS.append((spark, self.folder))

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.folder}/{name}{self.n}"
        self.n += 1
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def sweep(self) -> None:
        """Frees the shuffle files of queries that have ended; they stay until the driver's JVM collects their plans, so it is asked to, after a large table."""
        for _ in range(2):  # what the first run unlinks, the second one finds
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            drop_path(self.spark, path)


@atexit.register
def _clean() -> None:
    for spark, folder in _FOLDERS:
        try:
            drop_path(spark, folder)
        except Exception:  # the session has ended before: its folder goes with the cluster
            return


def smallest(rows: DataFrame, by: F.Column, ties: list[str], most: int, n: int):
    """The at most ``most`` of ``n`` rows with the smallest ``by``, a hash, as an Arrow table.

    A limit brings as many rows of each partition together; so of many rows only
    those go into it that lie below a bound which twice as many are expected to meet.
    """
    place = F.pmod(by, F.lit(1 << 40))
    if n > 4 * most:
        few = rows.where(place < int(2 * most / n * (1 << 40))).orderBy(place, *ties).limit(most).toArrow()
        if few.num_rows == most:
            return few
    return rows.orderBy(place, *ties).limit(most).toArrow()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that little of a batch is held as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_key() -> list[F.Column]:
    """``k1, k2``, 128 bits a document: rows that agree in doc_id and text are the same document."""
    return [F.xxhash64("doc_id", "text", F.length("text")).alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2")]


def free(taken: Iterable[str], name: str) -> str:
    """``name``, or the first of it with underscores after it that no column in ``taken`` has (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
