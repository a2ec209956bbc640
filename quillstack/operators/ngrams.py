"""A fitted word-bigram model as a backend of log-probabilities.

Counts are tables, so the model grows with its corpus; what a scored text needs of it comes by joins on different word
pairs, each looked up once. Both sides of the last join are exchanged, so that Spark can split a pair that stands in a third
of all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.stored import stored

#: Weight of the unigram in a bigram's estimate, counts added to a word.
WEIGHT, ADDED = 1.0, 1.0


def words(text: Column) -> Column:
    """array<string>: runs of a-z of the lower-cased text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.array().cast("array<string>"))


@dataclass
class Bigrams:
    """pairs (prev, w, c), singles (w, c), contexts (prev, c), and the sums that smoothing needs."""

    pairs: DataFrame
    singles: DataFrame
    contexts: DataFrame
    n: int
    n_words: int


def placed(df: DataFrame, id_: str, tokens: str) -> DataFrame:
    """id, pos from 0, prev (empty before the first), w."""
    prev = F.when(F.col("pos") > 0, F.get(F.col("__tokens"), F.col("pos") - 1)).otherwise("")
    return df.select(id_, F.col(tokens).alias("__tokens"), F.posexplode(tokens).alias("pos", "w")).select(id_, "pos", prev.alias("prev"), "w")


def fit(df: DataFrame, tokens: str) -> Bigrams:
    """Counts over all rows' token arrays; words are counted in each task before they meet."""
    pairs = stored(placed(df.withColumn("__id", F.lit(0)), "__id", tokens).groupBy("prev", "w").agg(F.count(F.lit(1)).alias("c")))
    singles = stored(pairs.groupBy("w").agg(F.sum("c").alias("c")))
    contexts = stored(pairs.groupBy("prev").agg(F.sum("c").alias("c")))
    n, n_words = singles.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    return Bigrams(pairs, singles, contexts, n, n_words)


def log_probability(pair: Column, context: Column, single: Column, n: int, n_words: int) -> Column:
    """ln of (c(prev, w) + WEIGHT p(w)) / (c(prev) + WEIGHT), p(w) = (c(w) + ADDED) / (n + ADDED (n_words + 1))."""
    zero = F.lit(0)
    p = (F.coalesce(single, zero) + ADDED) / F.lit(n + ADDED * (n_words + 1))
    return F.log((F.coalesce(pair, zero) + WEIGHT * p) / (F.coalesce(context, zero) + WEIGHT))


def token_log_probabilities(df: DataFrame, id_: str, tokens: str, model: Bigrams) -> DataFrame:
    """id, logps (array<double>, in order) of every row's tokens. ids are unique; rows without tokens have an empty array."""
    own = stored(placed(df, id_, tokens))
    asked = own.select("prev", "w").distinct()
    single = model.singles.select("w", F.col("c").alias("c_w"))
    context = model.contexts.select("prev", F.col("c").alias("c_prev"))
    met = asked.join(model.pairs, ["prev", "w"], "left").join(single, "w", "left").join(context, "prev", "left")
    known = stored(met.select("prev", "w", log_probability(F.col("c"), F.col("c_prev"), F.col("c_w"), model.n, model.n_words).alias("logp")))
    each = own.join(known, ["prev", "w"]).groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("pos", "logp"))).alias("__at"))
    ordered = F.transform("__at", lambda x: x["logp"])
    return df.select(id_).join(each, id_, "left").select(id_, F.coalesce(ordered, F.array().cast("array<double>")).alias("logps"))


def vocabulary_hits(df: DataFrame, id_: str, text: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """The ids of texts with at least one word of the vocabulary table.

    A text's different words meet the table by a semi-join, which Spark broadcasts only if the table is small enough; a
    word of a third of all texts is split by the other side's exchange.
    """
    each = df.select(id_, F.explode(F.array_distinct(words(F.col(text)))).alias("__word"))
    known = vocabulary.select(F.lower(word).alias("__word")).where("__word is not null").distinct()
    return each.join(known, "__word", "left_semi").select(id_).distinct()

