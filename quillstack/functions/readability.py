"""Reading grades by pronunciations: syllables come from a dictionary table, rules only serve words that it hasn't.

Different words are looked up once: a table of all words with their syllables, which then meets the texts' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.textops import sentence_count
from quillstack.operators.lexicon import frequent, word_sums
from quillstack.operators.stored import stored


def word_list(text: Column) -> Column:
    """array<string>: lower-case words, marks at their ends off; an apostrophe inside stays."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:'\p{L}+)*"), F.lit(0))


def ruled_syllables(word: Column) -> Column:
    """Vowel groups, less a silent closing e (not that of a consonant with le), one at least."""
    groups = F.regexp_count(word, F.lit("[aeiouyàâäæéèêëîïôöœùûü]+"))
    silent = word.rlike("[^aeiouy]e$") & ~word.rlike("[^aeiouy]le$")
    return F.greatest(groups - silent.cast("int"), F.lit(1)).cast("bigint")


def syllable_table(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words (each once) with their syllables. dictionary: word, syllables; of several entries the fewest syllables count."""
    known = dictionary.select(F.lower("word").alias("word"), F.col("syllables").cast("bigint").alias("told")).where("word is not null and told is not null")
    known = known.groupBy("word").agg(F.min("told").alias("told"))
    return words.join(known, "word", "left").select(*words.columns, F.coalesce("told", ruled_syllables(F.col("word"))).alias("syllables"))


def grades(df: DataFrame, id_: str, text: str, dictionary: DataFrame) -> DataFrame:
    """id, n_words, n_sentences, n_syllables, fk_grade (to 3 places). Texts without words have grade 0; ids are unique."""
    listed = df.select(id_, F.coalesce(word_list(F.col(text)), F.array().cast("array<string>")).alias("__words"),
        F.coalesce(sentence_count(F.col(text)), F.lit(1)).alias("n_sentences"))
    own = listed.select(id_, F.explode("__words").alias("word"))
    table = stored(syllable_table(own.groupBy("word").agg(F.count(F.lit(1)).alias("c")), dictionary)).withColumnRenamed("syllables", "value")
    sums = word_sums(own, id_, "word", table, frequent(table, "word", "c")[0]).select(id_, F.col("total").alias("n_syllables"))
    every = listed.select(id_, F.size("__words").cast("bigint").alias("n_words"), "n_sentences").join(sums, id_, "left")
    counted = every.select(id_, "n_words", "n_sentences", F.coalesce("n_syllables", F.lit(0)).alias("n_syllables"))
    grade = 0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syllables") / F.col("n_words") - 15.59
    return counted.withColumn("fk_grade", F.when(F.col("n_words") > 0, F.floor(grade * 1000 + 0.5) / 1000).otherwise(0.0))
