"""Removal of repeated byte strings, with suffixes sorted bucket by bucket.

Two suffixes matter to each other only if they tie over ``LENGTH`` bytes. Documents, cut into slices so that no one is too
long for a task, are packed in order of doc_id into blocks, stored bucketed by block: what later steps learn about a block
comes to it without moving texts again.

1. Cover sample: the suffixes at difference-cover positions (14 in 100) are sorted by their first 44 bytes, part by part;
   a sample's rank is either its own, or one shared with others in its block or elsewhere. Short hashes do, as a chance
   clash only keeps a suffix that could have gone.
2. Suffixes none of whose samples is shared tie with none and go. The others fall into buckets of suffixes, as many as keep
   what one bucket moves under the texts' size. One bucket at a time is sorted: within each block first, where equal
   suffixes are one entry, then part by part over blocks. Ties of 100 bytes are told by fingerprints of 96 bits and more,
   not byte by byte. In each class of equal suffixes all but the first have an earlier one.
3. The strings with an earlier one are united to spans, and these are removed.

A passage in a third of all documents is an entry a block. Nothing is collected but counts.

Null and empty texts have no bytes; texts under 100 bytes lose none. Documents are ordered by doc_id, rows without one
first, rows that share one as the table is read: each row is a document of its own. Spans are of bytes and may cut a
character. No documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import discard, remove_path, scratch_path, stored
from quillstack.llm.cover import HEAD, LENGTH, Prints, bytes_left, classes, near_repeats, sampled, split, union

#: Bytes of a slice that are its own, and of a block.
SLICE, BLOCK = 1 << 20, 2 << 20
#: Entries a part is meant to hold.
PART = 2_000_000
BUCKET_BYTES = 32 << 20
BLOCK_SCHEMA = "block long, rows array<long>, docs array<long>, starts array<long>, sizes array<long>, ends array<long>, body binary"


def slices(docs: DataFrame, length: int = SLICE) -> DataFrame:
    """row, doc, start, size (of the document), body: each slice with the bytes that strings starting in it reach."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(length))
    cut = rows.select("row", "doc", size.alias("size"), F.explode(starts).alias("start"), "text")
    return cut.select("row", "doc", "size", "start", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.lit(length + LENGTH - 1)).alias("body"))


def packer(block_bytes: int):
    """Slices in order to blocks; a block's number tells its order, bodies are compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, n = 0, 0

        def block() -> pa.RecordBatch:
            body = b"".join(s["body"] for s in held)
            cells = {
                "block": [(held[0]["task"] << 32) + n], "rows": [[s["row"] for s in held]], "docs": [[s["doc"] for s in held]], "starts": [[s["start"] for s in held]],
                "sizes": [[s["size"] for s in held]], "ends": [np.cumsum([len(s["body"]) for s in held]).tolist()], "body": [len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)],
            }
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cells.values(), kinds, strict=True)], list(cells))

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for s in batch.slice(at, 64).to_pylist():
                    if held and size + len(s["body"]) > block_bytes:
                        yield block()
                        held, size, n = [], 0, n + 1
                    held.append(s)
                    size += len(s["body"])
        if held:
            yield block()

    return pack


class Blocks:
    """The stored blocks: a table bucketed by block, so that joins by block leave the texts where they are."""

    def __init__(self, docs: DataFrame, slice_bytes: int = SLICE, block_bytes: int = BLOCK, part: int = PART):
        self.spark, self.slice_bytes, self.part = docs.sparkSession, slice_bytes, part
        spark = self.spark
        self.bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.bytes // BUCKET_BYTES)
        order = [F.col("doc").asc_nulls_first(), F.col("row"), F.col("start")]
        cut = slices(docs, slice_bytes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        blocks = cut.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(packer(block_bytes), BLOCK_SCHEMA)
        self.path, self.name = scratch_path(spark, "suffix-blocks"), f"suffix_blocks_{uuid.uuid4().hex}"
        # small row groups: a reader holds a few blocks at once
        out = blocks.repartition(parts, "block").write.option("path", self.path).option("parquet.block.size", 8 << 20)
        out.bucketBy(parts, "block").sortBy("block").format("parquet").saveAsTable(self.name)
        free(spark)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove_path(self.spark, self.path)


def free(spark: SparkSession) -> None:
    """Spark deletes the shuffles of finished steps when the driver's collectors find that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def powers_of_two(least: float) -> int:
    """The exponent of the least power of two that is not under ``least``."""
    return max(0, int(np.ceil(np.log2(max(1.0, least)))))


class Opened:
    """A block's bytes and the bytes left from each to its slice's end."""

    def __init__(self, row: dict):
        size = int.from_bytes(row["body"][:8], "little")
        self.body = np.frombuffer(pa.decompress(memoryview(row["body"])[8:], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        self.ends = np.array(row["ends"], np.int64)
        self.left = bytes_left(self.ends)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their keys: the upper 32 bits after ``bits`` of a part's number."""
        at = sampled(self.left)
        return at, Prints(self.body, 0).of(at, HEAD) >> np.uint64(32 - bits) << np.uint64(32 - bits)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def requests(block: int, keys: np.ndarray, firsts: np.ndarray, second: np.ndarray | None, shift: int, bits: int) -> pa.RecordBatch:
    """A row a part: the block's different keys, ascending, without the bits that the part tells."""
    own = keys[firsts]
    part = ((own >> np.uint64(64 - shift - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    runs = split(part)
    if second is None:
        low = (own >> np.uint64(32 - bits)).astype("<u4")
        cells = [low[s:e].tobytes() for _, s, e in runs]
    else:
        cells = [own[s:e].astype("<u8").tobytes() + second[firsts[s:e]].astype("<u4").tobytes() for _, s, e in runs]
    kinds = (pa.array([block] * len(runs), pa.int64()), pa.array([p for p, _, _ in runs], pa.int32()), pa.array(cells, pa.binary()))
    return pa.RecordBatch.from_arrays(list(kinds), ["block", "part", "keys"])


def answered(wide: bool, earlier: bool):
    """Per (block, part) a bit a key: whether another block (with ``earlier``: a block before) has it too."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        cells = table["keys"].to_pylist()
        if wide:
            first, second = (np.concatenate([np.frombuffer(c, kind, len(c) // 12, (len(c) // 12) * at) for c in cells]) for kind, at in (("<u8", 0), ("<u4", 8)))
        else:
            first = np.concatenate([np.frombuffer(c, "<u4") for c in cells]).astype(np.uint64) << np.uint64(32)
            second = np.zeros(len(first), np.uint32)
        order, new = classes(first, second)
        again = ~new
        if not earlier:
            again[:-1] |= ~new[1:]
        told = np.zeros(len(first), bool)
        told[order] = again
        sizes = [len(c) // (12 if wide else 4) for c in cells]
        bits = [np.packbits(x).tobytes() for x in np.split(told, np.cumsum(sizes)[:-1])]
        return pa.table([table["block"], table["part"], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], ["block", "part", "n", "bits"])

    return answer


ANSWER = "block long, part int, n int, bits binary"


def by_block(answers: DataFrame) -> DataFrame:
    """A block's answers in one row, in the order in which it asked: as many bits as it has keys."""
    keys = F.sort_array(F.collect_list(F.struct("bucket", "part", "n", "bits")))
    return answers.groupBy("block").agg(keys.alias("told"))


def bits_of(told: list[dict], bucket: int) -> np.ndarray:
    own = [np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=t["n"]) for t in told if t["bucket"] == bucket]
    return np.concatenate(own).astype(bool) if own else np.zeros(0, bool)


class Suffixes:
    """The suffixes of a block that may tie, with both fingerprints, in a bucket's share."""

    def __init__(self, opened: Opened, flags: bytes):
        at = sampled(opened.left)
        repeated = at[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(at)).astype(bool)]
        self.at = near_repeats(opened.left, repeated)
        self.first = Prints(opened.body, 1).of(self.at, LENGTH)
        self.second = Prints(opened.body, 2)

    def bucket(self, number: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, first = self.at, self.first
        if bits:
            here = first >> np.uint64(64 - bits) == number
            own, first = own[here], first[here]
        return own, first, (self.second.of(own, LENGTH) >> np.uint64(32)).astype(np.uint32)


def shared_samples(blocks: Blocks) -> DataFrame:
    """block, flags: a bit a sampled suffix, whether its head stands elsewhere too; n: suffixes that may tie."""
    bits = powers_of_two(max(blocks.bytes * 0.14 / blocks.part, 16))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, keys = Opened(row).samples(bits)
            order, new = classes(keys, np.zeros(len(keys), np.uint32))
            yield requests(row["block"], keys, order[new], None, 0, bits)

    asked = blocks.table().select("block", "ends", "body").mapInArrow(ask, "block long, part int, keys binary")
    answers = stored(asked.groupBy("part").applyInArrow(answered(False, False), ANSWER), "sample-answers")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            opened = Opened(row)
            at, keys = opened.samples(bits)
            order, new = classes(keys, np.zeros(len(keys), np.uint32))
            within = ~new
            within[:-1] |= ~new[1:]
            flags = np.zeros(len(at), bool)
            flags[order] = within | bits_of(row["told"] or [], 0)[np.cumsum(new) - 1]
            n = len(near_repeats(opened.left, at[flags]))
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "flags": [np.packbits(flags).tobytes()], "n": [n]})

    told = by_block(answers.withColumn("bucket", F.lit(0)))
    flags = stored(blocks.table().select("block", "ends", "body").join(told, "block", "left").mapInArrow(flag, "block long, flags binary, n long"), "sample-flags")
    discard(answers)
    free(blocks.spark)
    return flags


def earlier_suffixes(blocks: Blocks, flags: DataFrame) -> tuple[list[DataFrame], int]:
    """Per bucket of suffixes the stored answers, and the bits of a bucket's number."""
    n = flags.agg(F.sum("n")).first()[0] or 0
    bucket_bits = powers_of_two(12 * n / max(1, blocks.bytes))
    bits = powers_of_two(max(n / (1 << bucket_bits) / blocks.part, 16))
    out = []
    for b in range(1 << bucket_bits):

        def ask(batches: Iterator[pa.RecordBatch], b: int = b) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                _, first, second = Suffixes(Opened(row), row["flags"]).bucket(b, bucket_bits)
                order, new = classes(first, second)
                yield requests(row["block"], first, order[new], second, bucket_bits, bits)

        own = flags.where("n > 0").select("block", "flags")
        asked = blocks.table().select("block", "ends", "body").join(own, "block").mapInArrow(ask, "block long, part int, keys binary")
        out.append(stored(asked.groupBy("part").applyInArrow(answered(True, True), ANSWER).withColumn("bucket", F.lit(b)), "suffix-answers"))
        free(blocks.spark)
    return out, bucket_bits


PIECE = "row long, doc_id long, start long, size long, spans array<struct<start: long, end: long>>, body binary"


def pieces(blocks: Blocks, flags: DataFrame, answers: list[DataFrame], bucket_bits: int) -> DataFrame:
    """Every slice with the spans of its document that go because of strings that start in it."""
    spark, slice_bytes = blocks.spark, blocks.slice_bytes
    told = by_block(spark.read.schema(answers[0].schema).parquet(*(a.scratch for a in answers)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            opened = Opened(row)
            gone = []
            if row["told"]:
                own = Suffixes(opened, row["flags"])
                for b in range(1 << bucket_bits):
                    at, first, second = own.bucket(b, bucket_bits)
                    order, new = classes(first, second)
                    earlier = ~new | bits_of(row["told"], b)[np.cumsum(new) - 1]
                    gone.append(at[order[earlier]])
            spans = union(np.sort(np.concatenate(gone))) if gone else np.zeros((0, 2), np.int64)
            ends, begins = opened.ends, opened.ends - np.diff(opened.ends, prepend=0)
            # spans of two slices never meet in one string, but may touch: cut at the ends of slices
            own_spans = [[] for _ in ends]
            for s, e in spans.tolist():
                k = int(np.searchsorted(ends, s, "right"))
                while s < e:
                    to = min(e, int(ends[k]))
                    if s < to:
                        own_spans[k].append({"start": s - int(begins[k]) + row["starts"][k], "end": to - int(begins[k]) + row["starts"][k]})
                    s, k = to, k + 1
            body = opened.body.tobytes()
            for at in range(0, len(ends), 64):
                k = range(at, min(at + 64, len(ends)))
                cells = {"row": [row["rows"][i] for i in k], "doc_id": [row["docs"][i] for i in k], "start": [row["starts"][i] for i in k], "size": [row["sizes"][i] for i in k]}
                arrays = [pa.array(v, pa.int64()) for v in cells.values()]
                arrays.append(pa.array([own_spans[i] for i in k], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                arrays.append(pa.array([kept_bytes(body[begins[i] : ends[i]], own_spans[i], row["starts"][i]) if row["sizes"][i] <= slice_bytes else body[begins[i] : ends[i]] for i in k], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [*cells, "spans", "body"])

    joined = blocks.table().join(flags.select("block", "flags"), "block").join(told, "block", "left")
    return joined.mapInArrow(cut, PIECE)


def kept_bytes(body: bytes, spans: list[dict], start: int) -> bytes:
    """The bytes outside the ascending spans; ``start`` is where the body stands in the document."""
    out, at = [], 0
    for s in spans:
        out.append(body[at : s["start"] - start])
        at = s["end"] - start
    return b"".join([*out, body[at:]])


def merger(slice_bytes: int):
    """The slices of one document as one piece: touching spans are one, bodies lose what several slices share."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()
        spans: list[dict] = []
        for s in sorted((s for r in rows for s in r["spans"]), key=lambda s: s["start"]):
            if spans and s["start"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], s["end"])
            else:
                spans.append(dict(s))
        body = kept_bytes(b"".join(r["body"][:slice_bytes] for r in rows), spans, 0)
        return pa.Table.from_pylist([{**rows[0], "start": 0, "spans": spans, "body": body}], table.schema)

    return merged


def without_repeats(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes, maximal) and kept (the remaining bytes) of every document, stored."""
    blocks = Blocks(docs, **settings)
    flags = shared_samples(blocks)
    answers, bucket_bits = earlier_suffixes(blocks, flags)
    found = stored(pieces(blocks, flags, answers, bucket_bits), "suffix-pieces")
    blocks.drop()
    discard(flags, *answers)
    whole = found.where(F.col("size") <= blocks.slice_bytes)
    long = found.where(F.col("size") > blocks.slice_bytes).groupBy("row").applyInArrow(merger(blocks.slice_bytes), PIECE)
    return whole.unionAll(long).select("doc_id", F.col("size").alias("n_bytes"), "spans", F.col("body").alias("kept"))


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def report(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return without_repeats(docs, **settings).select(
        "doc_id", "n_bytes", removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
