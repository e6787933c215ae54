"""Shared helpers: reading tables, shared storage, batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that the vectorised text kernels take at a time; bounds a worker's memory.
BLOCK_CHARS = 1 << 18
#: Bytes of a batch that Spark sends to a Python worker, which else has up to 10,000 rows of any length.
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a private one only where Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("palimpsest.local.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.local.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound batches for Python workers by bytes in this session, unless it has its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def parallel(spark: SparkSession) -> int:
    """Partitions for a shuffle of a whole table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_runs(lengths: list[int], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``most`` code points; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
