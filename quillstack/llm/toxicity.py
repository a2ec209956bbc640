"""Toxicity by non-negative positive-unlabelled learning: a linear classifier trained in numpy.

Confirmed toxic documents are the positives, a sample of all documents of the learning side is unlabelled. The risk is
prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) with the logistic loss: what positives put into the unlabelled negative
risk is taken off, and where that estimate falls below zero the step goes the other way (non-negative correction).

Features are a text's words (digits, letters, non-ASCII; lower case) and their first 3, 4, 5 and 6 characters, each as
found once, and as found twice or more. A feature is used if ``LEAST_DOCS`` positives and a share of ``LEAST_SHARE`` have it, ``LIFT`` times as often
as unlabelled texts and ``SIGNIFICANT`` standard errors beyond chance. doc_id, lang, source and labels are never features.

Both samples are of different rows (by doc_id and text) and hold ``POSITIVES`` and ``UNLABELLED`` of them at most: rows
are drawn by a hash of doc_id and text, and what is beyond the bound is cut by that hash. The sample's features stay in a
stored table; they are counted there, and only the selected ones come to the driver. The prior is the share of toxic
documents among all labelled ones of the learning side.

Null and empty texts have no features and score by the bias. Labels with a null doc_id or label are ignored; of several
labels of one document the greater counts; documents that share a doc_id share its label, documents without one have none.
Without positives the score is 0. Equal rows are all returned, no documents give no rows. A very long text is scored whole
in one task. Other columns are never read; ``clean`` hands them on as they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import byte_texts, discard, doc_crc, pieces, stored
from quillstack.llm.decontamination import words

HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3
#: Most rows of the samples that the classifier is fitted on; expected are a tenth less.
POSITIVES, UNLABELLED = 4000, 12000
LEAST_DOCS, LEAST_SHARE, LIFT, SIGNIFICANT = 3, 0.02, 3.0, 6.0
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
PREFIXES = (3, 4, 5, 6)
#: Odd slots are features found twice or more.
SLOTS = 1 << 22


def held_out(doc_id: Column) -> Column:
    return doc_crc(doc_id) % FOLDS == HELD_OUT


def word_features(word: bytes) -> tuple[int, ...]:
    text = word.decode("utf-8").lower()
    keys = ["=" + text, *("^" + text[:n] for n in PREFIXES if len(text) >= n)]
    return tuple(zlib.crc32(k.encode()) % (SLOTS // 2) * 2 for k in keys)


def text_features(text: bytes) -> list[int]:
    count: Counter[int] = Counter()
    for word, n in Counter(words(text)).items():
        for f in word_features(word):
            count[f] += n
    return sorted([*count, *(f + 1 for f, n in count.items() if n > 1)])


def sample(docs: DataFrame, labels: DataFrame, most_p: int = POSITIVES, most_u: int = UNLABELLED) -> tuple[DataFrame | None, float]:
    """toxic, drawn, ids (features) of the rows to learn from, as a stored table, and the prior."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    total, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not positive:
        return None, 0.0
    # at most most_p ids of one long each: bounded whatever the labels' number
    chosen = known.where("toxic = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(most_p).withColumn("toxic", F.lit(True))
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    flagged = rows.join(F.broadcast(chosen), "id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    n, n_toxic = flagged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    key = F.xxhash64("id", "text")
    share = lambda bound, n: 1.0 if n <= bound else 0.9 * bound / n
    part = lambda salt, bound, n: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * share(bound, n))
    picked = flagged.withColumns({"key": key, "toxic": F.col("toxic") & part(1, most_p, n_toxic),
        "drawn": part(2, most_u, n)}).where("toxic or drawn")
    different = picked.groupBy("key").agg(*(F.first(c).alias(c) for c in ("toxic", "drawn", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = [text_features(x) for x in byte_texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["key", "toxic", "drawn", "ids"])

    found = stored(different.mapInArrow(run, "key long, toxic boolean, drawn boolean, ids array<int>"), "sample")
    # however rows repeat their ids or texts: the bound is kept
    bounded = {c: F.col(c) & (F.col("key") <= F.lit(last)) for c,
        bound in (("toxic", most_p), ("drawn", most_u)) if (last := _last(found.where(c), bound)) is not None}
    out = found.withColumns(bounded) if bounded else found
    out.scratch = found.scratch
    return out, positive / total


def _last(rows: DataFrame, bound: int) -> int | None:
    """The greatest key of the first ``bound`` ones, if there are more."""
    if rows.count() <= bound:
        return None
    return rows.select("key").orderBy("key").limit(bound).agg(F.max("key")).first()[0]


def selected(rows: DataFrame, least_docs: int = LEAST_DOCS) -> list[int]:
    """Features that tell toxic rows from drawn ones; counted where the rows are."""
    n_p, n_u = rows.agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)) for c in ("toxic", "drawn"))).first()
    if not n_p or not n_u:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(2).offsets.to_numpy())
            feature, where = np.unique(ids, return_inverse=True)
            each = [np.bincount(where, np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64), lengths), len(feature))
                .astype(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (feature.astype(np.int32), *each)], ["feature", "p", "u"])

    counts = rows.select("toxic", "drawn", "ids").mapInArrow(run, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"),
        F.sum("u").alias("u"))
    in_p, in_u = F.col("p") / n_p, F.greatest("u", F.lit(1)) / n_u
    error = F.sqrt(in_u * F.greatest(1 - in_u, F.lit(1e-9)) / n_p)
    least = min(max(least_docs, LEAST_SHARE * n_p), n_p)
    return sorted(r[0] for r in counts.where((F.col("p") >= least) & (in_p >= LIFT * in_u) & (in_p - in_u >= SIGNIFICANT * error)).select("feature")
        .collect())


#: Nonzeros of a 0/1 matrix: their rows, their columns, and the number of rows.
Matrix = tuple[np.ndarray, np.ndarray, int]


def matrices(rows: DataFrame, features: list[int]) -> tuple[Matrix, Matrix]:
    """The toxic and the drawn rows' selected features. Rows are bounded by the sample's bounds."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(features, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for batch in batches:
            ids, lengths = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(2).offsets.to_numpy())
            at = np.searchsorted(names, ids)
            kept = names[np.minimum(at, len(names) - 1)] == ids if len(names) else np.zeros(len(ids), bool)
            owner = np.repeat(np.arange(len(lengths)), lengths)[kept]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[kept].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["toxic", "drawn", "ids"])

    found = rows.orderBy("key").select("toxic", "drawn", "ids").mapInArrow(run,
        "toxic boolean, drawn boolean, ids array<int>").toArrow().combine_chunks()

    def matrix(c: str) -> Matrix:
        lists = found.filter(found.column(c)).column("ids").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()).astype(np.int64)), cols, len(lists)

    return matrix("toxic"), matrix("drawn")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def margins(w: np.ndarray, x: Matrix) -> np.ndarray:
    return w[-1] + np.bincount(x[0], w[x[1]], x[2])


def risk(w: np.ndarray, p: Matrix, u: Matrix, prior: float) -> tuple[float, float]:
    """The positive part, and the negative part before it is held at 0. The last weight is the bias."""
    zp, zu = margins(w, p), margins(w, u)
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def step_gradient(w: np.ndarray, p: Matrix, u: Matrix, prior: float) -> np.ndarray:
    """Of the whole risk, or, if the negative part has fallen below 0, of that part alone the other way."""
    k, zp, zu = len(w) - 1, margins(w, p), margins(w, u)
    if risk(w, p, u, prior)[1] >= 0:
        gp, gu = prior * (_sigmoid(zp) - 1 - _sigmoid(zp)) / p[2], _sigmoid(zu) / u[2]
    else:
        gp, gu = prior * _sigmoid(zp) / p[2], -_sigmoid(zu) / u[2]
    return np.append(np.bincount(p[1], gp[p[0]], k) + np.bincount(u[1], gu[u[0]], k), gp.sum() + gu.sum())


def fit(p: Matrix, u: Matrix, n_features: int, prior: float) -> np.ndarray:
    """Weights, the bias last."""
    k = n_features
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    for step in range(1, STEPS + 1):
        g = step_gradient(w, p, u, prior)
        g[:k] += RIDGE * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # the bias once more, so that the unlabelled sample's mean score is the prior
    plain, low, high = margins(np.append(w[:k], 0.0), u), -30.0, 30.0
    for _ in range(60):
        w[k] = (low + high) / 2
        low, high = (w[k], high) if _sigmoid(plain + w[k]).mean() < prior else (low, w[k])
    return w


class Scorer(dict):
    """word -> the features it has that carry weight, for at most ``limit`` words."""

    def __init__(self, weights: dict[int, float], bias: float, limit: int = 400_000):
        super().__init__()
        self.weights, self.bias, self.limit = weights, bias, limit
        self.used = {f - f % 2 for f in weights}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(f for f in word_features(word) if f in self.used)
        return found

    def score(self, text: bytes) -> float:
        count: Counter[int] = Counter(chain.from_iterable(map(self.__getitem__, words(text))))
        get = self.weights.get
        z = self.bias + sum(get(f, 0.0) + (get(f + 1, 0.0) if n > 1 else 0.0) for f, n in sorted(count.items()))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def model(docs: DataFrame, labels: DataFrame, most_p: int = POSITIVES, most_u: int = UNLABELLED) -> tuple[dict[int, float], float]:
    """Weights by feature id, and the bias."""
    rows, prior = sample(docs, labels, most_p, most_u)
    if rows is None:
        return {}, -30.0
    features = selected(rows)
    p, u = matrices(rows, features)
    w = fit(p, u, len(features), prior) if p[2] and u[2] else None
    discard(rows)
    if w is None:
        return {}, -30.0
    return {f: float(x) for f, x in zip(features, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels))  # bounded by the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in pieces(batches):
            found = [scorer.score(x) for x in byte_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()),
                pa.array([int(x >= THRESHOLD) for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels))
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in pieces(batches):
            yield batch.filter(pa.array([scorer.score(x) < THRESHOLD for x in byte_texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
