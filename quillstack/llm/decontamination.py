"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

A shard is a run of documents of one partition. Its symbols are the benchmark's words: a document word that no window
has ends a run, and runs shorter than the shortest window can hold none, so neither is indexed. Windows are searched as
one set per length, their occurrences located through sampled suffix positions and merged into spans of words.

The benchmark goes to the workers in blocks of at most ``block_bytes`` of text. One block is searched while documents
stream by. Of several, each is a pass of its own over the documents, stored with their rows' numbers: a pass has one block
in memory and leaves the spans it has found, which are joined to the documents at the end.

Null or wordless documents have no hits; null or wordless items are never found; items with the same id count once, and
items that share a window share its occurrences, which are not multiplied by them. Equal rows are all returned. No
documents give no rows, no benchmark gives no hits. A very long document is a shard of its own. Other columns, whatever
their names, travel as one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import byte_texts, discard, stored
from quillstack.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: A shard is indexed once it has so many symbols; a longer document is a shard of its own.
SHARD_SYMBOLS = 1 << 19
#: Words are runs of digits, letters a-z in either case and everything beyond ASCII.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

_WORD = re.compile(rb"[^ ]+")
#: Of a document: its words, the merged spans of words that are hit, and the items found in it.
FOUND = "struct<n_words:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _item_windows(item: bytes, window: int) -> list[tuple[bytes, ...]]:
    found = words(item)
    if not found:
        return []
    n = min(window, len(found))
    return [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]


class Phrases:
    """The windows of one block of the benchmark by length, in the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            for phrase in _item_windows(text, window):
                by.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in phrase), set()).add(name)
        self.shortest = min(map(len, by), default=0)
        self.sets = []
        for n in sorted({len(x) for x in by}):
            keys = [x for x in by if len(x) == n]
            self.sets.append((n, np.array(keys, np.int64), [sorted(by[x]) for x in keys]))
        self.sigma = len(self.vocabulary) + 2  # 0 ends the index, 1 stands between runs

    def search(self, symbols: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(position, length, items) of every occurrence; the list of items is the window's own, not a copy."""
        index = FMIndex(symbols, self.sigma)
        for n, patterns, names in self.sets:
            lo, hi = index.ranges(patterns)
            hit = np.flatnonzero(hi > lo)
            count = (hi - lo)[hit]
            if len(hit):
                which = np.repeat(hit, count)
                rows = np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                for p, w in zip(index.locate(rows).tolist(), which.tolist(), strict=True):
                    yield p, n, names[w]


def _runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= shortest]


def find_hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text its number of words, the merged (first word, word after the last) of all occurrences, and the items."""
    symbols, places, at = [], [], 0
    counts = [0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[dict[int, list[str]]] = [{} for _ in texts]

    def flush() -> None:
        nonlocal symbols, places, at
        if symbols:
            starts = np.array([p[0] for p in places])
            for pos, n, names in phrases.search(np.concatenate(symbols)):
                base, doc, word = places[int(np.searchsorted(starts, pos, "right")) - 1]
                spans[doc].append((word + pos - base, word + pos - base + n))
                items[doc][id(names)] = names
        symbols, places, at = [], [], 0

    get = phrases.vocabulary.get
    for doc, text in enumerate(texts):
        found = words(text)
        counts[doc] = len(found)
        ids = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
        for a, b in _runs(ids, phrases.shortest) if phrases.sets else ():
            symbols += [ids[a:b], np.ones(1, np.int64)]
            places.append((at, doc, a))
            at += b - a + 1
        if at >= SHARD_SYMBOLS:
            flush()
    flush()
    return [(n, _merged(own), sorted({x for names in sets.values() for x in names})) for n, own, sets in zip(counts, spans, items, strict=True)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most so many bytes, or one item, each on the driver for as long as it is dealt out."""
    block, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text").cast("string"), "utf-8")).toLocalIterator():
        if r[0] is None or r[1] is None:
            continue
        block.append((r[0], bytes(r[1])))
        held += len(r[1])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _searched(rows: DataFrame, block: list[tuple[str, bytes]], window: int, all_rows: bool):
    """rows (key, row) -> key and what the block has in each row's text; the broadcast that the plan reads.

    Without a column ``row``, key is the row.
    """
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for batch in batches:
            hits = find_hits(byte_texts(batch.columns[-1].field("text")), phrases)
            told = [{"n_words": n, "spans": [{"start": a, "stop": b} for a, b in spans], "items": items} for n, spans, items in hits]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, _FOUND)], ["key", "found"])
            yield out if all_rows else out.filter(pa.array([bool(h[1]) for h in hits], pa.bool_()))

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(search, f"key {key}, found {FOUND}"), sent


def _as_row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (a struct of the columns of docs) and ``found`` of every document."""
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    rows = docs.select(_as_row(docs).alias("row"))
    if second is None:
        return _searched(rows.withColumnRenamed("row", "key"), first, window, True)[0].withColumnRenamed("key", "row")
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("key"), "row"), "numbered")
    passes, block = [], first
    while block is not None:
        found, sent = _searched(numbered, block, window, not passes)
        passes.append(stored(found, "hits"))
        sent.destroy()
        block, second = second, next(blocks, None)
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    # a row a document and block that has hits in it
    lists = every.groupBy("key").agg(F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"),
        F.flatten(F.collect_list("found.items")).alias("items"))
    joint = stored(lists.select("key", F.struct("n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items")).alias("found")),
        "all-hits")
    discard(*passes)
    return numbered.join(joint, "key").select("row", "found")


def hit_words(spans: Column) -> Column:
    """Words in the union of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(h["start"], s["end"])).cast("long")).alias("n"),
            F.greatest(s["end"], h["stop"]).alias("end")),
    )["n"]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = hit_words(F.col("found.spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("found.n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    found = contamination(docs, benchmark)
    n_hit = hit_words(F.col("found.spans"))
    kept = found.where((n_hit == 0) | (20 * n_hit < F.col("found.n_words")))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; from their texts the spans are cut, from the first letter of the first word to the last of the last."""
    found = contamination(docs, benchmark).select("row", "found", F.col("row.text").alias("text"))
    names = found.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if found["spans"]:
                    raw = text.encode()
                    places = [m.span() for m in _WORD.finditer(raw.translate(_WORDS))]
                    for a, b in reversed(_merged([(x["start"], x["stop"]) for x in found["spans"]])):
                        raw = raw[: places[a][0]] + raw[places[b - 1][1] :]
                    text = raw.decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    done = found.mapInArrow(cut, f"row {names}, text string")
    changed = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs
        .columns else {})
    return done.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
