"""Token-ID files: every document's ids and an end id, Simple-8b coded in blocks, in ascending doc_id order.

File format: a folder of Parquet part files, so that any store Spark writes to can hold it and a lost executor's part is
written again. Each row is one block of whole documents: ``file_no`` (ascending with doc_id), ``block_no`` and
``block_start`` (ids before it in its file), ``doc_ids``, ``doc_tokens`` and ``payload``, a ``simple8b`` block of the ids.

Null texts are empty (the end id alone); null doc_ids come first; rows that share a doc_id are ordered by their text's
hash, equal rows are all written. No documents give no blocks. A very long document is a block of its own. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import simple8b
from quillstack.llm.bpe import encoder
from quillstack.llm.common import byte_texts, pieces

BLOCK_SCHEMA = "file_no long, block_no long, block_start long, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids long, payload binary"
#: A block is closed once it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file_no = encoder(tokenizer), TaskContext.get().partitionId()
        block_no = done = waiting = 0
        ids, names = [], []

        def block() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            rows = [[file_no], [block_no], [done], [names], [lengths], [waiting], [simple8b.encode(np.concatenate(ids))]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(rows, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in pieces(batches):
            for name, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                own = np.frombuffer(enc.ids(text), enc.dtype)
                ids.append(np.append(own.astype(np.uint32), np.uint32(end_id)))
                names.append(name)
                waiting += len(own) + 1
                if waiting >= block_ids:
                    yield block()
                    block_no, done, waiting, ids, names = block_no + 1, done + waiting, 0, [], []
        if names:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")  # deals out the rows of one id over several files, in a defined order
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks and ``start``: the ids before each in all files. The sums that are sent out are one row a file."""
    found = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    files = found.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect()
    before, total = [], 0
    for r in sorted(files, key=lambda r: r.file_no):
        before.append((r.file_no, total))
        total += r.n
    starts = spark.createDataFrame(before, "file_no long, file_start long")
    return found.join(F.broadcast(starts), "file_no").withColumn("start", F.col("file_start") + F.col("block_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4):
            for r in batch.to_pylist():
                ids = simple8b.decode(r["payload"])
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32)))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + starts), pa.array(r["doc_tokens"], pa.int64()),
                        pa.array(crc, pa.int64()), lists],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = read_blocks(spark, path).select("doc_ids", "doc_tokens", "start", "payload")
    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """read_documents without the ids themselves, which stay in the worker."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4):
            for r in batch.to_pylist():
                raw = simple8b.decode(r["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + starts), pa.array(r["doc_tokens"], pa.int64()),
                        pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = read_blocks(spark, path).select("doc_ids", "doc_tokens", "start", "payload")
    return blocks.mapInArrow(index, "doc_id long, start long, n_tokens long, ids_crc32 long")
