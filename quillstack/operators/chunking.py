"""Pages to chunks and back.

The running sum of a book's tokens starts anew at every cut, so a page's chunk depends on all pages before it. Yet a run of
pages is a small function of the sum carried into it: the sum carried out and the number of cuts. Runs' functions are
worked out side by side, composed in order of pages, and then each run cuts its own pages. No book is one row or one task.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.stored import stored

#: Pages of a run.
RUN = 100_000


@dataclass
class Carry:
    """What a run makes of the sum carried in: without a cut it adds ``total``; from each threshold in ``at`` on, the sum carried
    out is ``out`` and the number of cuts ``cuts``. Thresholds ascend."""

    total: int = 0
    at: list[int] = field(default_factory=list)
    out: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)

    def __call__(self, carried: int) -> tuple[int, int]:
        i = bisect_right(self.at, carried) - 1
        return (carried + self.total, 0) if i < 0 else (self.out[i], self.cuts[i])

    def _add(self, at: int, out: int, cuts: int) -> None:
        if self.at and self.at[-1] >= max(at, 0):  # both start at or below no sum: the later one holds
            self.out[-1], self.cuts[-1] = out, cuts
        elif not self.at or (self.out[-1], self.cuts[-1]) != (out, cuts):
            self.at.append(max(at, 0))
            self.out.append(out)
            self.cuts.append(cuts)


def cuts_after(upto: np.ndarray, first: int, base: int, limit: int) -> list[int]:
    """The pages that close a chunk, from page ``first`` on with ``base`` tokens counted off. upto: running sums of the run."""
    found = []
    while True:
        k = int(np.searchsorted(upto[first:], base + limit, "right")) + first
        if k >= len(upto):
            return found
        found.append(k)
        first, base = k + 1, int(upto[k])


def carry_of(tokens: np.ndarray, limit: int) -> Carry:
    """A run's function. Whatever is carried in, the first cut is at a page by which the run alone is over the limit."""
    upto = np.cumsum(tokens)
    made = Carry(int(upto[-1]) if len(upto) else 0)
    last = int(np.searchsorted(upto, limit, "right"))  # a sum of nothing is cut here
    firsts = range(min(last, len(upto) - 1), -1, -1)
    # chains of cuts meet: what follows a cut is worked out once
    known: dict[int, tuple[int, int]] = {}
    for k in firsts:
        least = limit + 1 - int(upto[k])  # the least sum carried in that is cut at page k or before
        chain, at = [], k
        while at not in known:
            nxt = int(np.searchsorted(upto[at + 1 :], int(upto[at]) + limit, "right")) + at + 1
            chain.append(at)
            if nxt >= len(upto):
                known[at] = (int(upto[-1] - upto[at]), 1)
                chain.pop()
                break
            at = nxt
        for page in reversed(chain):
            nxt = int(np.searchsorted(upto[page + 1 :], int(upto[page]) + limit, "right")) + page + 1
            out, cuts = known[nxt]
            known[page] = (out, cuts + 1)
        made._add(least, *known[k])
    return made


CARRY = "book string, run long, total long, at array<long>, out array<long>, cuts array<long>"


def _carries(limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("page_idx")
        c = carry_of(table["n_tokens"].to_numpy().astype(np.int64), limit)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        cells = ([table["book"][0].as_py()], [table["run"][0].as_py()], [c.total], [c.at], [c.out], [c.cuts])
        return pa.table([pa.array(v, k) for v, k in zip(cells, kinds, strict=True)], ["book", "run", "total", "at", "out", "cuts"])

    return run


def _carried(table: pa.Table) -> pa.Table:
    """A book's runs in order: the sum carried into each and the number of chunks closed before it. A row a run."""
    rows = table.sort_by("run").to_pylist()
    carried, chunks, out = 0, 0, []
    for r in rows:
        out.append((carried, chunks))
        carried, more = Carry(r["total"], r["at"], r["out"], r["cuts"])(carried)
        chunks += more
    own = pa.array([c for c, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())
    return pa.table([pa.array([r["book"] for r in rows], pa.string()), pa.array([r["run"] for r in rows], pa.int64()), *own], ["book", "run", "carried", "closed"])


def _numbered(limit: int):
    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("page_idx")
        upto = np.cumsum(table["n_tokens"].to_numpy().astype(np.int64))
        ends = cuts_after(upto, 0, -table["carried"][0].as_py(), limit)
        before = np.zeros(len(upto) + 1, np.int64)
        before[np.array(ends, np.int64) + 1] = 1
        chunk = table["closed"][0].as_py() + np.cumsum(before[:-1])
        return pa.table([table["book"], table["page_idx"], table["n_tokens"], pa.array(chunk.astype(np.int32))], ["book", "page_idx", "n_tokens", "chunk"])

    return number


def page_numbers(pages: DataFrame, limit: int, run: int = RUN) -> DataFrame:
    """(book, page_idx, n_tokens, chunk from 0): a page is added, and only when the sum then exceeds the limit is the chunk closed with it.

    pages: book, page_idx (a whole number, unique in a book), n_tokens (not negative; null counts as none). Pages without a
    book or number go.
    """
    tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")
    own = pages.where("book is not null and page_idx is not null").select(F.col("book").cast("string").alias("book"), F.col("page_idx").cast("long").alias("page_idx"), tokens)
    own = stored(own)  # lengths are worked out once
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // run))
    # partitions are pages in order: a run is what a partition has of a book
    numbers = stored(own.repartitionByRange(parts, "book", "page_idx").withColumn("run", F.spark_partition_id().cast("long")))
    carries = numbers.groupBy("book", "run").applyInArrow(_carries(limit), CARRY)
    carried = carries.groupBy("book").applyInArrow(_carried, "book string, run long, carried long, closed long")
    met = numbers.join(carried, ["book", "run"]).select("book", "run", "page_idx", "n_tokens", "carried", "closed")
    return met.groupBy("book", "run").applyInArrow(_numbered(limit), "book string, page_idx long, n_tokens long, chunk int")


def page_chunks(pages: DataFrame, limit: int, run: int = RUN) -> DataFrame:
    """book, page_idx, page_number, text, n_tokens -> book, chunk, start_page, end_page, n_pages, text.

    A chunk is labelled as starting at the page that closed the chunk before it. A last chunk without tokens is left out.
    Texts meet their chunk, not their book.
    """
    numbers = stored(page_numbers(pages, limit, run))
    each = pages.select("book", "page_idx", "page_number", "text").join(numbers, ["book", "page_idx"])
    chunks = each.groupBy("book", "chunk").agg(
        F.min_by("page_number", "page_idx").alias("first_page"), F.max_by("page_number", "page_idx").alias("end_page"),
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_tokens").alias("mass"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda x: x["text"]), "").alias("text"),
    ).where("mass > 0")
    # a chunk starts with the number of the page that closed the one before: a join of page numbers, not of texts
    last = numbers.groupBy("book", "chunk").agg(F.max("page_idx").alias("page_idx")).join(pages.select("book", "page_idx", "page_number"), ["book", "page_idx"])
    closing = last.select("book", (F.col("chunk") + 1).alias("chunk"), F.col("page_number").alias("closed_by"))
    start = F.coalesce("closed_by", "first_page").alias("start_page")
    return chunks.join(closing, ["book", "chunk"], "left").select("book", "chunk", start, "end_page", "n_pages", "text")


def reassemble(chunks: DataFrame, keys: list[str], index: str, text: str, sep: str = " ") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda x: x[text])
    return chunks.groupBy(*keys).agg(F.array_join(ordered, sep).alias(text))


def shard_of(index, rows_per_shard: int):
    return F.floor(index / rows_per_shard).cast("bigint")
