"""Hard-negative mining over product-quantised vectors.

Every row is coded once: its whole-number components, cut into pieces of two, become one byte a piece (the nearest of 256
codewords), and the norm of what the codewords leave over is stored beside the code. An anchor's products with all
codewords are a table, so a row's score is a sum of looked-up numbers, and the true score differs from it by at most the
anchor's norm times the row's residual norm (Cauchy-Schwarz). A row whose upper bound is under what is held already, or
whose bounds lie outside the window, can't be among the results; every other row's exact integer product is worked out.
So results are exact whatever the codebooks, which are fitted on ``SAMPLE`` rows at most.

Anchors are a stated query set (ids divisible by ``every``). They go out in blocks of ``BLOCK`` rows at most, a size that
does not depend on the data; each block is a pass over all coded rows for the positives and one for the negatives. A task
holds the best few rows an anchor and sends only these on, so no row a pair is ever made.

Rows with a null id, label or vector, or any component null or not finite, take no part. Repeated rows are rows of their
own: each repeated anchor has its own results, and its twin may be its positive. Ties go to the smaller id. Vectors of
other lengths count as ended by zeros. Components whose 256-fold is beyond 2**27 end there. An empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import discard, stored
from quillstack.llm.vectors import is_finite, matrix, packed, unpacked, whole

PIECE, WORDS, ROUNDS = 2, 256, 6
SAMPLE, BLOCK = 8192, 4096


def fit_codebooks(rows: np.ndarray, piece: int = PIECE, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """(pieces, words, piece) whole codewords by k-means of each piece; fewer rows than words repeat the first row."""
    n, pieces = rows.shape[0], rows.shape[1] // piece
    books = np.zeros((pieces, words, piece), np.int64)
    if not n:
        return books
    order = np.random.default_rng(seed).permutation(n)
    for m in range(pieces):
        x = rows[:, m * piece : (m + 1) * piece].astype(float)
        c = x[np.resize(order, words)].copy() if n >= words else np.concatenate([x, np.repeat(x[:1], words - n, 0)])
        for _ in range(rounds):
            near = nearest(x, c)
            count = np.bincount(near, minlength=words)
            for j in range(piece):
                c[:, j] = np.where(count > 0, np.bincount(near, x[:, j], words) / np.maximum(count, 1), c[:, j])
        books[m] = np.rint(c)
    return books


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 2048):
        out[at : at + 2048] = np.argmin((words * words).sum(1) - 2 * x[at : at + 2048] @ words.T, 1)
    return out


def encode(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, one byte a piece, and the residual norms, rounded up."""
    piece = books.shape[2]
    codes = np.empty((len(rows), len(books)), np.uint8)
    left = np.zeros(len(rows))
    for m, book in enumerate(books):
        x = rows[:, m * piece : (m + 1) * piece]
        codes[:, m] = near = nearest(x.astype(float), book.astype(float))
        off = (x - book[near]).astype(float)
        left += (off * off).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-12)


class Coded:
    """A batch of coded rows; exact components are read only for the rows that bounds can't decide."""

    def __init__(self, batch: pa.RecordBatch, pieces: int, width: int):
        self.ids = batch["vec_id"].to_numpy(zero_copy_only=False)
        self.labels = batch["label"].to_numpy(zero_copy_only=False)
        self.norms = batch["residual"].to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, pieces)
        self.places = codes.astype(np.int32) + WORDS * np.arange(pieces, dtype=np.int32)
        self.rows = unpacked(batch["whole"], width)
        self.of_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels)}

    def bounds(self, anchor: np.ndarray, table: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the rows ``at``, below and above."""
        looked_up = np.take(table, self.places[at]).sum(1).astype(float)
        slack = np.sqrt(float((anchor.astype(float) ** 2).sum())) * self.norms[at]
        slack = slack + 1e-9 * (np.abs(looked_up) + slack) + 1e-3
        return looked_up - slack, looked_up + slack

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.rows[at].astype(np.int64) @ anchor


def tables(anchors: np.ndarray, books: np.ndarray, i: int) -> np.ndarray:
    """The anchor's products with all codewords, piece after piece."""
    pieces, _, piece = books.shape
    return np.einsum("mwp,mp->mw", books, anchors[i].reshape(pieces, piece)).ravel()


def best(score: np.ndarray, ids: np.ndarray, more_score: np.ndarray, more_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n of both, higher scores first, ties by smaller id."""
    score, ids = np.concatenate([score, more_score]), np.concatenate([ids, more_ids])
    order = np.lexsort((ids, -score))[:n]
    return score[order], ids[order]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nth(values: np.ndarray, n: int) -> float:
    """The n-th largest value, or minus infinity."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -np.inf


def nearest_of_label(part: Coded, anchor: np.ndarray, label: int, table: np.ndarray, held: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``held`` with the batch's rows of the label: the n best."""
    at = part.of_label.get(label)
    if at is None:
        return held
    low, high = part.bounds(anchor, table, at)
    least = max(nth(low, n), float(held[0][n - 1]) if len(held[0]) >= n else -np.inf)
    at = at[high >= least]
    return best(*held, part.exact(anchor, at), part.ids[at], n)


def in_windows(part: Coded, anchor: np.ndarray, label: int, table: np.ndarray, windows: list[tuple[int, int]], held: list, n: int) -> list:
    """For each window the n best rows of other labels, held ones and the batch's."""
    low, high = part.bounds(anchor, table, slice(None))
    other = part.labels != label
    near = np.zeros(len(low), bool)
    for (least, most), (score, _) in zip(windows, held, strict=True):
        if least > most:
            continue
        sure = low[other & (low >= least) & (high <= most)]
        least = max(float(least), nth(sure, n), float(score[n - 1]) if len(score) >= n else -np.inf)
        near |= other & (high >= least) & (low <= most)
    at = np.flatnonzero(near)
    if not len(at):
        return held
    exact, ids = part.exact(anchor, at), part.ids[at]
    out = []
    for (least, most), was in zip(windows, held, strict=True):
        fits = (exact >= least) & (exact <= most)
        out.append(best(*was, exact[fits], ids[fits], n) if fits.any() else was)
    return out


def prepared(vectors: DataFrame, every_shift: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, whole of the rows that take part; where vec_id is divisible by 7 the label is the next one."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.where(vec_id.isNotNull() & label.isNotNull() & is_finite(F.col("embedding")))
    moved = F.when(F.pmod(vec_id, F.lit(every_shift)) == 0, (label + 1) % classes).otherwise(label)
    return rows.select(vec_id.alias("vec_id"), moved.alias("label"), whole(F.col("embedding")).alias("whole"))


def coded(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, int]:
    """The stored code table of all rows, the codebooks, fitted on ``sample`` rows at most, and the padded length."""
    n, width = rows.agg(F.count("*"), F.max(F.size("whole"))).first()
    width = -(-max(width or 0, 1) // PIECE) * PIECE
    some = rows.where(F.pmod(F.xxhash64("vec_id", "whole"), F.lit(max(1, n // sample))) == 0).select("whole").limit(sample).toArrow()
    books = fit_codebooks(matrix(some["whole"].combine_chunks(), width) if n else np.zeros((0, width), np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["whole"], width)
            codes, residual = encode(x, books)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual), pa.array(packed(x), pa.binary())],
                ["vec_id", "label", "code", "residual", "whole"],
            )

    out = rows.mapInArrow(code, "vec_id long, label long, code binary, residual double, whole binary")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "codes"), books, width


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``positives`` other rows of the same label. For each, the first ``negatives`` rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    codes, books, width = coded(prepared(vectors), sample)
    pieces = len(books)
    anchors = codes.where(F.col("vec_id") % every == 0).select("vec_id", "label", "whole", "row")
    n_blocks = max(1, -(-2 * anchors.count() // block))
    # a block has twice its mean at most, but for chance that grows with no table; what it holds is asserted below
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).repartition("block"), "anchors")
    found = []
    for b in range(n_blocks):
        own = anchors.where(F.col("block") == b).drop("block").toArrow()
        for at in range(0, own.num_rows, block):
            found.append(mine_block(codes, own.slice(at, block), books, width, pieces, positives, negatives, low, high))
    discard(anchors, codes)
    if not found:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*(f.scratch for f in found))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_block(codes: DataFrame, own: pa.Table, books: np.ndarray, width: int, pieces: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """One block of anchors against all rows, stored."""
    context = codes.sparkSession.sparkContext
    ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
    rows = unpacked(own["whole"].combine_chunks(), width).astype(np.int64)
    sent = context.broadcast((ids, labels, rows, books))

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, rows, books = sent.value
        held = [NONE] * len(labels)
        for batch in batches:
            part = Coded(batch, pieces, width)
            for i, label in enumerate(labels):
                held[i] = nearest_of_label(part, rows[i], int(label), tables(rows, books, i), held[i], positives + 1)
        yield flat(held, "anchor")

    def flat(held: list, *names: str) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in held]
        keys = {"anchor": np.repeat(np.arange(len(held), dtype=np.int32), sizes)}
        score, found = (np.concatenate([h[k] for h in held] or [NONE[0]]) for k in (0, 1))
        return pa.RecordBatch.from_pydict({names[0]: keys["anchor"], "score": score, "vec_id": found})

    def first(df: DataFrame, key: str, n: int) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    near = first(codes.mapInArrow(same_label, "anchor int, score long, vec_id long"), "anchor", positives + 1)
    pairs: list[list[tuple[int, int]]] = [[] for _ in ids]
    for anchor, score, vec_id in near.orderBy("anchor", "rank").select("anchor", "score", "vec_id").collect():
        pairs[anchor].append((score, vec_id))
    self_scores = (rows * rows).sum(1)
    for i, have in enumerate(pairs):
        # one row equal to the anchor in id and score is the anchor itself; if it is not among these, as many others are better
        own_row = (int(self_scores[i]), int(ids[i]))
        if own_row in have:
            have.remove(own_row)
        del have[positives:]
    windows = [[(-(-low * s // 100), high * s // 100) for s, _ in have] for have in pairs]
    asked = context.broadcast(windows)

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, rows, books = sent.value
        held = [[NONE] * len(w) for w in asked.value]
        for batch in batches:
            part = Coded(batch, pieces, width)
            for i, label in enumerate(labels):
                if held[i]:
                    held[i] = in_windows(part, rows[i], int(label), tables(rows, books, i), asked.value[i], held[i], negatives)
        yield flat([h for own in held for h in own], "pair")

    told = [(n, int(ids[i]), vec_id, score) for n, (i, score, vec_id) in enumerate((i, s, v) for i, have in enumerate(pairs) for s, v in have)]
    named = codes.sparkSession.createDataFrame(told, "pair int, anchor_id long, positive_id long, positive_score long")
    hard = first(codes.mapInArrow(other_labels, "pair int, score long, vec_id long"), "pair", negatives)
    out = hard.join(F.broadcast(named), "pair").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
    return stored(out, "hard-negatives")
