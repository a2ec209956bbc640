"""Sums over a text's words of what a table holds for each word.

The frequent words of the table, ``LIMIT`` at most, are sent to every worker: a text's words are added up where the text is
read, one row a text is shuffled. All other words meet the rest of the table by a join, in which no short word is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are sent to every worker at most, and characters of such a word at most.
LIMIT, LONGEST = 1 << 17, 64
#: Classes of counts from one power of two to the next.
STEPS = 16


def frequent(table: DataFrame, word: str, count: str, limit: int = LIMIT) -> tuple[int | None, int]:
    """The count from which on a word is frequent (None: no word is), and the sum of all counts. Only classes of counts are collected."""
    step = F.floor(F.log2(count) * STEPS)
    short = F.length(word) <= LONGEST
    classes = table.groupBy(step.alias("step")).agg(F.count(F.when(short, 1)).alias("n"), F.min(count).alias("least"), F.sum(count).alias("mass")).collect()
    least, n = None, 0
    for r in sorted(classes, key=lambda r: -r.step):
        n += r.n
        if n > limit:
            break
        least = r.least
    return least, sum(r.mass for r in classes)


def word_sums(words: DataFrame, id_: str, word: str, table: DataFrame, least: int | None) -> DataFrame:
    """id, total, n: the sum of ``value`` over an id's words that the table has, and their number.

    words: id, word, a row an occurrence. table (stored): word (each once), ``c`` occurrences, ``value``; least: as ``frequent`` says.
    """
    # stored: the join by word has an exchange on either side, and Spark can split a word that is long and in every text
    often = F.lit(False) if least is None else (F.col("c") >= least) & (F.length(word) <= LONGEST)
    sent, rest = F.broadcast(table.where(often).select(word, "value")), table.where(~often).select(word, "value")
    near = words.join(sent, word).select(id_, "value")
    far = words.join(F.broadcast(table.where(often).select(word)), word, "left_anti").join(rest, word).select(id_, "value")
    return near.unionByName(far).groupBy(id_).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
