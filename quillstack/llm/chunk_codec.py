"""BPE encoding by content-defined chunks: a chunk that documents share is encoded once, joins are then repaired.

A gear rolling hash over the bytes cuts a text where its content says so, hence copies and near copies are cut alike.
Documents are dealt out, and within a part sorted, in the order of a sketch (the least hash of their lines), so those that
share chunks come one after the other in one worker, where each chunk is encoded once: the distance between repeats, not
the size of a part, decides whether the worker still keeps its ids. Large groups of copies are divided by their text hash
and row. At every join the k blank-separated words on both sides are encoded again, with k doubled until two sizes give
the same ids. ``reuse`` tells how often chunks were encoded, against how many different ones there are.

Null and empty texts have no ids. Equal rows are all returned. No documents give no rows. Results do not depend on the
dealing. A very long text is cut into chunks like any other and settled chunk by chunk; a run of chunks without a blank
has no place to settle at, so it is one unit with the chunks at its ends and encoded once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.bpe import Encoder, encoder
from quillstack.llm.common import byte_texts, pieces

#: One byte in so many ends a chunk, on average; shorter ones than LEAST join their successor.
AVERAGE, LEAST = 1024, 128
#: Bytes of ids that a worker keeps of chunks it has encoded; beyond that it starts anew.
KEPT_BYTES = 16 << 20
#: Words whose ids a worker keeps beside its chunks.
KEPT_WORDS = 100_000

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def _hash_cuts(text: bytes) -> list[int]:
    """Where the rolling hash cuts a text, its own end last."""
    n = len(text)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # the sum over 32 bytes of gear << age, by doubling
        h[width:] += h[:-width] << np.uint32(width)
    out, last = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1).tolist():
        if i - last >= LEAST and i < n and text[i] & 0xC0 != 0x80:  # never inside a code point
            out.append(i)
            last = i
    return [*out, n]


_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text, its own end last; a piece without a blank is one chunk with its neighbours."""
    out: list[int] = []
    last, open_ = 0, False
    for end in _hash_cuts(text):
        bare = _BLANK.search(text, last, end) is None
        if out and (open_ or bare):
            out[-1] = end
        else:
            out.append(end)
        last, open_ = end, bare
    return out


def _edge(text: bytes, k: int, last: bool) -> bytes:
    """The last or first k blank-separated words with the blanks outside of them; all of it if there are no more."""
    words = text.rsplit(None, k) if last else text.split(None, k)
    if len(words) <= k:
        return text
    return text[len(words[0]) :] if last else text[: len(text) - len(words[-1])]


class ChunkEncoder:
    def __init__(self, enc: Encoder, kept_bytes: int = KEPT_BYTES):
        self.enc, self.kept, self.kept_bytes, self.held = enc, {}, kept_bytes, 0
        self.encoded = self.reused = 0

    def chunk(self, text: bytes) -> bytes:
        key = hashlib.blake2b(text, digest_size=16).digest()
        ids = self.kept.get(key)
        if ids is not None:
            self.reused += 1
            return ids
        self.encoded += 1
        ids = self.enc.ids(text)
        if self.held > self.kept_bytes:
            self.kept.clear()
            self.held = 0
        self.kept[key] = ids
        self.held += len(ids) + 120
        return ids

    def joined(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> bytes:
        """The ids of left + right from those of both."""
        enc, before, k = self.enc.ids, None, 1
        while True:
            a, b = _edge(left, k, True), _edge(right, k, False)
            if len(a) == len(left) and len(b) == len(right):
                return enc(left + right)
            ia, ib = enc(a), enc(b)
            if left_ids.endswith(ia) and right_ids.startswith(ib):
                now = left_ids[: len(left_ids) - len(ia)] + enc(a + b) + right_ids[len(ib) :]
                if now == before:
                    return now
                before = now
            k *= 2

    def ids(self, text: bytes) -> bytes:
        ends = cuts(text)
        if len(ends) == 1:
            return self.chunk(text)
        # what is settled, and the last chunk, whose end the next join may still change
        done: list[bytes] = []
        left = text[: ends[0]]
        left_ids = self.chunk(left)
        for a, b in zip(ends, ends[1:], strict=False):
            right = text[a:b]
            right_ids = self.chunk(right)
            both = self.joined(left, left_ids, right, right_ids)
            # settle all but the last words of right: they are whole words of the text, alike in both
            tail = _edge(right, 8, True)
            tail_ids = self.enc.ids(tail)
            if len(tail) < len(right) and both.endswith(tail_ids):
                done.append(both[: len(both) - len(tail_ids)])
                left, left_ids = tail, tail_ids
            else:
                left, left_ids = left + right, both
        return b"".join([*done, left_ids])


def by_sketch(docs: DataFrame) -> DataFrame:
    """Documents that share lines next to one another, in even parts whatever a group's size."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(x))
    order = (F.array_min(lines), F.xxhash64("text"), F.xxhash64("doc_id"))
    return docs.repartitionByRange(*order).sortWithinPartitions(*order)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, KEPT_WORDS)
        chunks = ChunkEncoder(enc)
        for batch in pieces(batches):
            ids = [np.frombuffer(chunks.ids(x), enc.dtype).astype(np.int32) for x in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return by_sketch(_rows(docs)).mapInArrow(run, "doc_id long, ids array<int>")


def reuse(docs: DataFrame, tokenizer: str, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """One row: ``chunks``, how many of them were ``encoded``, and how many are ``distinct``.

    A worker hands on a row per chunk it has encoded (its hash), and one for those it has reused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkEncoder(encoder(tokenizer, KEPT_WORDS), kept_bytes)
        for batch in pieces(batches):
            before, hashes = chunks.reused, []
            for text in byte_texts(batch.column(1)):
                at = 0
                for end in cuts(text):
                    encoded = chunks.encoded
                    chunks.chunk(text[at:end])
                    if chunks.encoded > encoded:
                        hashes.append(hashlib.blake2b(text[at:end], digest_size=16).digest())
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array([*hashes, None], pa.binary()),
                pa.array([0] * len(hashes) + [chunks.reused - before], pa.int64())], ["chunk", "again"])

    found = by_sketch(_rows(docs)).mapInArrow(run, "chunk binary, again long").groupBy("chunk").agg(F.count("chunk").alias("n"),
        F.sum("again").alias("again"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg((count(F.col("n")) + count(F.col("again"))).alias("chunks"), count(F.col("n")).alias("encoded"),
        F.count("chunk").alias("distinct"))


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, KEPT_WORDS)
        for batch in pieces(batches):
            text = [enc.decoded(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text: both stay in the worker that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, KEPT_WORDS)
        chunks = ChunkEncoder(enc)
        names = {i: str(i) for i in enc.strings}
        for batch in pieces(batches):
            n, shas, texts = [], [], []
            for text in byte_texts(batch.column(1)):
                ids = np.frombuffer(chunks.ids(text), enc.dtype).tolist()
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(enc.decoded(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_sketch(_rows(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
