"""Votes, majorities and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.textops import label_ordinal
from quillstack.schemas import LABEL_BANDS


def vote_counts(votes: DataFrame, book: str = "book", label: str = "label") -> DataFrame:
    """One row a book: the votes of every band, 0 if none."""
    return votes.groupBy(book).agg(*(F.coalesce(F.sum((F.col(label) == b).cast("bigint")), F.lit(0)).alias(f"n_{i}") for i,
        b in enumerate(LABEL_BANDS)))


def majority(votes: DataFrame, book: str = "book", label: str = "label") -> DataFrame:
    """The band with most votes; of equals the youngest; books without a vote are left out."""
    counts = votes.where(F.col(label).isNotNull()).groupBy(book, label).count()
    return counts.groupBy(book).agg(F.max_by(label, F.struct("count", -label_ordinal(F.col(label)))).alias("age_group"))


def diagnostics(votes: DataFrame, book: str = "book", label: str = "label") -> DataFrame:
    """How many bands share the greatest count: none, single or multiple majority."""
    counts = vote_counts(votes, book, label)
    each = F.array(*(F.col(f"n_{i}") for i in range(len(LABEL_BANDS))))
    top = F.array_max(each)
    ties = F.size(F.filter(each, lambda c: c == top))
    kind = F.when(top == 0, "none").when(ties == 1, "single").otherwise("multiple")
    return counts.select(book, top.alias("top"), ties.cast("bigint").alias("ties"), kind.alias("kind"))


def first_majority(votes: DataFrame, book: str, label: str, position: str) -> DataFrame:
    """The label with most votes; of equals the one seen first."""
    counts = votes.groupBy(book, label).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(book).agg(F.max_by(label, F.struct(F.col("n"), -F.col("first"))).alias("pred"))


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    known = pairs.where(F.col(gold).isin(*LABEL_BANDS) & F.col(pred).isin(*LABEL_BANDS))
    return known.groupBy(gold).agg(*(F.sum((F.col(pred) == b).cast("bigint")).alias(f"pred_{i}") for i, b in enumerate(LABEL_BANDS)))


def agreement(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Exact and adjacent agreement over books whose labels are both canonical."""
    known = pairs.where(F.col(gold).isin(*LABEL_BANDS) & F.col(pred).isin(*LABEL_BANDS))
    gap = F.abs(label_ordinal(F.col(gold)) - label_ordinal(F.col(pred)))
    return known.agg(F.count(F.lit(1)).alias("n"), F.avg((gap == 0).cast("double")).alias("exact"),
        F.avg((gap <= 1).cast("double")).alias("adjacent"))


def odd_predictions(pairs: DataFrame, pred: str = "pred") -> DataFrame:
    return pairs.where(~F.col(pred).isin(*LABEL_BANDS)).groupBy(pred).count()
