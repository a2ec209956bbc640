"""What the training-data operators share: tables, the shared folder, byte views of texts and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Python's bytes.split() and the contract's ``[\x20\x09-\x0D]`` agree on these.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers find this package where the driver has found it, if they have no other path to it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that is one machine may name none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstack-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends at a replicated table, not at an executor."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing still to be run reads: what was made of them is stored itself."""
    for t in tables:
        remove_path(t.sparkSession, t.scratch)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def doc_crc(c: Column) -> Column:
    """Unsigned crc32 of the decimal doc_id; null ids hash as the empty string."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty, without a decode and encode."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that what a step holds beside the batch stays bounded whatever the texts' length.

    At the end the worker, which stays for later tasks, gives freed memory back.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()
