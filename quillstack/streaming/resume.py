"""Incremental processing of arriving files: what a run has finished is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.ranking import ordered_rank
from quillstack.operators.stored import stored

#: Rows after which what is done is committed.
ROWS = 10_000


def process_new_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Read the files that the checkpoint hasn't seen, apply the step, append to the sink, and end."""
    stream = spark.readStream.schema(schema).json(source)
    step(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _pieces(spark: SparkSession, sink: str) -> list[str]:
    """The committed pieces: folders whose job has ended. What a killed run has left half done is not among them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sink.rstrip('/')}/piece-*/_SUCCESS")) if fs.exists(root) else []
    return sorted(s.getPath().getParent().toString() for s in found or [])


def committed(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """The rows of all committed pieces."""
    paths = _pieces(spark, sink)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def process_in_pieces(
    spark: SparkSession, source: str, schema: str, sink: str, out_schema: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], keys: list[str],
    rows: int = ROWS, files: int = 100,
) -> None:
    """Read new files, apply the step to ``rows`` rows at a time in order of their keys, and commit each piece as it is done.

    A run that is killed inside a file goes on after its last committed piece: a batch that comes again leaves out the keys
    that the sink holds, and a piece is there whole or not at all. So no key is done twice and none is lost, whatever the
    number of kills; a key that comes in several rows or files is done once. ``step`` keeps the key columns.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = committed(spark, sink, out_schema).select(*keys).distinct()
        fresh = df.dropDuplicates(keys).join(done, keys, "left_anti")
        ranked = stored(ordered_rank(fresh, [F.col(k) for k in keys], "__place").withColumn("__piece", F.floor(F.col("__place") / rows)))
        last = ranked.agg(F.max("__piece")).first()[0]
        first = len(_pieces(spark, sink))
        for k in range(-1 if last is None else last + 1):
            piece = step(ranked.where(F.col("__piece") == k).drop("__place", "__piece"))
            piece.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/piece-{number:08d}-{first + k:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
