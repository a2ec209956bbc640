"""Score surrogates and rank agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.lexicon import frequent, word_sums
from quillstack.operators.ranking import quantile_cuts, score_rank
from quillstack.operators.stored import stored


def unigram_nll(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Mean negative log probability of a text's words under the table's own word frequencies, and the word count.

    Words are counted in each task before they meet; a text's frequent words are added up where it is read.
    """
    words = df.select(id_, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).where("w <> ''")
    counts = stored(words.groupBy("w").agg(F.count(F.lit(1)).alias("c")))
    least, mass = frequent(counts, "w", "c")
    table = counts.select("w", "c", (-F.log(F.col("c") / F.lit(mass or 1))).alias("value"))
    scored = word_sums(words, id_, "w", table, least).select(id_, F.col("total").alias("s"), F.col("n").alias("n_tokens"))
    count = F.coalesce("n_tokens", F.lit(0))
    nll = F.coalesce("s", F.lit(0.0)) / F.greatest(count, F.lit(1))
    return df.select(id_).join(scored, id_, "left").select(id_, nll.alias("nll"), count.alias("n_tokens"))


def _ranks(df: DataFrame, id_: str, a: str, b: str) -> tuple[int, DataFrame]:
    """The number of rows, and their ranks ``ra`` and ``rb``. The scores are read once and stored."""
    base = stored(df.select(id_, a, b, F.md5(F.col(id_).cast("string").cast("binary")).alias("tie")))
    n, cuts = quantile_cuts(base, [a, b])
    first = score_rank(base, a, "tie", id_, "ra", cuts[a], base)
    return n, score_rank(first, b, "tie", id_, "rb", cuts[b], base)


def spearman(df: DataFrame, id_: str, a: str, b: str) -> DataFrame:
    """Pearson correlation of ordinal ranks; ties by the id's hash."""
    return _ranks(df, id_, a, b)[1].agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def quartile_overlap(df: DataFrame, id_: str, a: str, b: str) -> DataFrame:
    n, ranks = _ranks(df, id_, a, b)
    q = n // 4
    if not q:
        raise ValueError("fewer than four rows")
    share = lambda c: F.sum(c.cast("bigint")) / F.lit(q)
    return ranks.agg(share((F.col("ra") < q) & (F.col("rb") < q)).alias("lowest"),
        share((F.col("ra") >= n - q) & (F.col("rb") >= n - q)).alias("highest"))


def band_means(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy("age_band").agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count(F.lit(1)).alias("n"))
