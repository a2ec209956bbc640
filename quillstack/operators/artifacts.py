"""Checks of an exported dataset: order, membership, counts, digests, round trips. Violations are rows; ``require`` fails."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.ranking import ordered_rank


def order_violations(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, position, manifest_index): ids that stand elsewhere, or on one side only. Both: id and their place from 0."""
    a = annotations.select("id", "position")
    return a.join(manifest.select("id", "manifest_index"), "id", "full_outer").where(~F.col("position").eqNullSafe(F.col("manifest_index")))


def split_violations(records: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(id, n): records that are in no part or in several, and ids that are no records (n below 0). All have ``id``."""
    rows = None
    for part in parts.values():
        own = part.select("id", F.lit(1).alias("n"), F.lit(0).alias("known"))
        rows = own if rows is None else rows.unionByName(own)
    every = records.select("id", F.lit(0).alias("n"), F.lit(1).alias("known"))
    sums = (every if rows is None else every.unionByName(rows)).groupBy("id").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    return sums.where("n <> 1 or known = 0").select("id", F.when(F.col("known") == 1, F.col("n")).otherwise(-F.col("n")).alias("n"))


def count_violations(actual: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    """(on, actual, expected) of the numbers that differ; both have ``on`` and ``n``."""
    joined = actual.select(on, F.col("n").alias("actual")).join(expected.select(on, F.col("n").alias("expected")), on, "full_outer")
    return joined.where(~F.col("actual").eqNullSafe(F.col("expected")))


def too_many(inputs: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    """(on, n_inputs, n_outputs) of the shards with more results than inputs."""
    count = lambda df, name: df.groupBy(on).agg(F.count(F.lit(1)).alias(name))
    both = count(outputs, "n_outputs").join(count(inputs, "n_inputs"), on, "left").select(on, F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"),
        "n_outputs")
    return both.where("n_outputs > n_inputs")


def repeated_keys(lines: DataFrame, on: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """(on, n, first, again): keys found twice or more, with the file and line of their first two occurrences."""
    at = F.struct(F.col(file).alias("file"), F.col(line).alias("line"))
    first = lines.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1")
    rest = lines.join(first, on).where(at > F.col("first")).groupBy(*on).agg(F.min(at).alias("again"))
    name = lambda c: F.concat_ws(":", F.col(f"{c}.file"), F.col(f"{c}.line"))
    return first.join(rest, on, "left").select(*on, "n", name("first").alias("first"), F.coalesce(name("again"), name("first")).alias("again"))


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns): rows, as often as they are, of one side only."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), "*")
    return side(a.exceptAll(b), "first").unionByName(side(b.exceptAll(a), "second"))


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write, read again, and what differs: no rows if the file holds what was written."""
    df.write.mode("errorifexists").parquet(path)
    return differing_rows(df, df.sparkSession.read.parquet(path))


#: Rows of a block of a tree digest.
BLOCK_ROWS = 65_536


def block_digests(df: DataFrame, order: str, column: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, n, digest): sha256 of each block of ``rows`` rows of the column in order, texts joined by line feeds.

    Blocks are hashed where they are; no task has more than one block's texts at once. Rows that tie in ``order`` are
    ordered by their text; null texts count as empty.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    own = df.select(F.col(order).alias("__order"), text.alias("__text"))
    ranked = ordered_rank(own, [F.col("__order"), F.col("__text")], "__place")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("__place", "__text"))), lambda x: x["__text"])
    blocks = ranked.groupBy(F.floor(F.col("__place") / rows).cast("long").alias("block"))
    return blocks.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(in_order, "\n").cast("binary"), 256).alias("digest"))


def tree_digest(df: DataFrame, order: str, column: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: rows, blocks and the sha256 of the blocks' digests in order. Equal columns in equal order have equal digests,
    whatever their partitions; unlike ``column_digest`` only a digest a block meets in one task."""
    blocks = block_digests(df, order, column, rows)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), "\n")
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"), F.sha2(joined.cast("binary"), 256).alias("digest"))


def column_digest(df: DataFrame, order: str, column: str, words: bool = False) -> str:
    """sha256 of a whole column in order: texts joined by line feeds, or with ``words`` unsigned 32-bit little-endian numbers.

    A hash is a chain: the bytes stream through the driver partition by partition, never as a whole.
    """
    at = df.select(F.col(order).alias("o"), F.col(column).cast("long" if words else "string").alias("c")).orderBy("o").select("c")

    def pack(batches):
        for batch in batches:
            values = batch.column(0)
            raw = values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() if words else "".join(f"\n{v}" for v in values.to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    digest, first = hashlib.sha256(), not words
    for row in at.mapInArrow(pack, "raw binary").toLocalIterator():
        raw = bytes(row.raw)
        digest.update(raw[1:] if first and raw else raw)
        first = first and not raw
    return digest.hexdigest()
