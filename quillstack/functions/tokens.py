"""Lengths and pieces by a real tokenizer: its file's content goes to the workers, texts meet it in Arrow batches.

The content is one string, checked against ``LARGEST`` before it is sent. A worker builds a tokenizer once. Null texts have
no tokens.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.bpe import Encoder

#: Bytes of a tokenizer file at most.
LARGEST = 64 << 20


def tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read where the driver finds it (or by Spark, if the path names a file system)."""
    if "://" in path:
        content = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as f:
            content = f.read()
    if len(content.encode()) > LARGEST:
        raise ValueError(f"{path} has over {LARGEST} bytes: too large to send to every worker")
    return spark.sparkContext.broadcast(content)


@lru_cache(2)
def _built(content: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(None, content=content)


def encoded(content: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text; a word that recurs is encoded once a worker, if the tokenizer's words are independent."""
    made = _built(content)
    for t in texts:
        yield np.frombuffer(made.ids((t or "").encode()), made.dtype)


def _with(df: DataFrame, column: str, out: str, kind: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    at, names = df.columns.index(column), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(at))], names)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}")


def with_token_counts(df: DataFrame, text: str, sent: Broadcast, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text."""
    return _with(df, text, out, "bigint", lambda c: pa.array([len(ids) for ids in encoded(sent.value, c.to_pylist())], pa.int64()))


def with_pair_tokens(df: DataFrame, pairs: str, sent: Broadcast, out: str = "pair_tokens") -> DataFrame:
    """df with array<bigint>: per pair (user, assistant) the tokens of both sides; null for null pairs."""

    def count(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        flat = iter([len(ids) for ids in encoded(sent.value, [s for r in rows for p in r or [] for s in (p["user"], p["assistant"])])])
        return pa.array([None if r is None else [next(flat) + next(flat) for _ in r] for r in rows], pa.list_(pa.int64()))

    return _with(df, pairs, out, "array<bigint>", count)


def with_token_chunks(df: DataFrame, text: str, sent: Broadcast, size: int, out: str = "chunks") -> DataFrame:
    """df with array<struct<n_tokens,text>>: the text as it is if its tokens fit, else what slices of ``size`` tokens decode to."""
    kind = pa.list_(pa.struct([("n_tokens", pa.int32()), ("text", pa.string())]))

    def cut(column: pa.Array) -> pa.Array:
        texts, made = column.to_pylist(), _built(sent.value)
        rows = []
        for t, ids in zip(texts, encoded(sent.value, texts), strict=True):
            parts = [ids[i : i + size].tolist() for i in range(0, len(ids), size)] if len(ids) > size else []
            rows.append([{"n_tokens": len(p), "text": made.tok.decode(p, skip_special_tokens=False)} for p in parts] or [{"n_tokens": len(ids), "text": t}])
        return pa.array(rows, kind)

    return _with(df, text, out, "array<struct<n_tokens:int,text:string>>", cut)


def masked_nll(logps: Column, n_prompt: Column, most: int = 1024) -> Column:
    """struct<nll, n_scored, n_tokens> of array<double> of each token's log-probability given those before it.

    Only the first ``most`` tokens count. The first token has no token before it and is not scored, nor are the first
    ``n_prompt``; nothing left to score gives 0.
    """
    held = F.slice(logps, 1, most)
    first = F.greatest(F.least(n_prompt, F.lit(most)), F.lit(1)).cast("int") + 1
    scored = F.slice(held, first, F.lit(most))
    total = F.aggregate(scored, F.lit(0.0), lambda s, x: s - x)
    n = F.size(scored).cast("bigint")
    return F.struct((total / F.greatest(n, F.lit(1))).alias("nll"), n.alias("n_scored"), F.size(held).cast("bigint").alias("n_tokens"))
