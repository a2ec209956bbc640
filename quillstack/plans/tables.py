"""The driver's tables in the roles of the domain, and the same views as SQL. Both sides use the same expressions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.schemas import BANDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers find this package where the driver has found it, if they have no other path to it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of books: source is the book, doc_id the page."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("page_number"),
        "text")


PAGES = "SELECT source AS book, doc_id AS page, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS page_number, text FROM documents"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored manifest: idx, id, image, task, age_band, n_words, n_tokens and the scores."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"),
        F.char_length("text").cast("bigint").alias("len"))
    band = F.element_at(T.lit_array(BANDS), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("caption_"), band, F.lit("_"), F.col("doc_id").cast("string")).alias("id"),
            F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.lit("caption").alias("task"), band.alias("age_band"), "n_words",
        F.when(F.pmod(F.col("doc_id"), F.lit(5)) == 0, 0).otherwise(F.col("n_words") + 7).cast("bigint").alias("n_tokens"),
        (F.pmod(F.col("n_words"), F.lit(97)) / F.lit(4.0) - 3).alias("fk_grade"),
            (F.pmod(F.col("len"), F.lit(1009)) / F.lit(256.0) + 0.5).alias("nll"),
        (F.pmod(F.col("len") * 3, F.lit(1009)) / F.lit(256.0) + 0.25).alias("nll_qwen"),
            (F.pmod(F.col("len") + F.col("n_words"), F.lit(1009)) / F.lit(256.0)).alias("nll_gemma"),
    )


RECORDS = r"""SELECT doc_id AS idx, 'caption_' || band || '_' || CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) || '.jpg' AS image, 'caption'
  AS task, band AS age_band, n_words,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_words + 7 END AS n_tokens, (n_words % 97) / 4.0::DOUBLE - 3 AS fk_grade, (len % 1009) / 256.0::DOUBLE + 0.5
  AS nll,
  ((len * 3) % 1009) / 256.0::DOUBLE + 0.25 AS nll_qwen, ((len + n_words) % 1009) / 256.0::DOUBLE AS nll_gemma
FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS len, ['3_5', '6_8', '9_12',
  '12'][doc_id % 4 + 1] AS band FROM documents)"""


ANSWERS = ("Age group: 3-5", "Age group:\n6-8 years", "Age group: 9-12+", "Well.\nAge group: 12+", "Age group: 9+", "no idea")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an age classifier, a few of them without a label: book, pos, answer."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.char_length("text").alias("n"))
    pick = F.element_at(T.lit_array(ANSWERS), (F.pmod(F.col("n"), F.lit(6)) + 1).cast("int"))
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("pos"), pick.alias("answer"))


VOTES = """SELECT source AS book, doc_id AS pos, ['Age group: 3-5', 'Age group:' || chr(10) || '6-8 years', 'Age group: 9-12+',
  'Well.' || chr(10) || 'Age group: 12+', 'Age group: 9+', 'no idea'][length(text) % 6 + 1] AS answer FROM documents"""



def second_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of another classifier on every row: every third differs from the first classifier's."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.char_length("text").alias("n"))
    shift = F.when(F.pmod(F.floor(F.col("n") / 6), F.lit(3)) == 0, 1).otherwise(0)
    pick = F.element_at(T.lit_array(ANSWERS), (F.pmod(F.col("n") + shift, F.lit(6)) + 1).cast("int"))
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("pos"), pick.alias("answer"))


SECOND_VOTES = """SELECT source AS book, doc_id AS pos, ['Age group: 3-5', 'Age group:' || chr(10) || '6-8 years', 'Age group: 9-12+',
  'Well.' || chr(10) || 'Age group: 12+', 'Age group: 9+', 'no idea'][(length(text) + CASE WHEN (length(text) // 6) % 3 = 0 THEN 1
  ELSE 0 END) % 6 + 1] AS answer FROM documents"""

EVENT_ORDERS = ("developmental", "readability", "perplexity", "random")
EVENT_TASKS = ("blimp", "ewok", "vqa")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation results: run, step, task, accuracy, path."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    order = F.element_at(T.lit_array(EVENT_ORDERS), (F.pmod(F.col("user_id"), F.lit(4)) + 1).cast("int"))
    schedule = F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, "competence").otherwise("staged")
    name = F.concat(F.lit("tl_"), order, F.lit("_"), schedule,
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "_ep5_smallm_mm_seed").otherwise("_ep10_smallm_textonly_seed"),
            F.pmod(F.col("event_id"), F.lit(3)).cast("string"), F.lit("_0101-"), F.lpad(F.pmod(F.col("user_id"), F.lit(50)).cast("string"), 6, "0"))
    return e.select(
        name.alias("run"), F.concat(F.lit("step_"), (F.pmod(F.col("event_id"), F.lit(7)) * 100).cast("string")).alias("step_name"),
            F.element_at(T.lit_array(EVENT_TASKS), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int")).alias("task"),
        F.floor(F.col("value")).cast("bigint").alias("score"), F.concat(F.lit("r/"), F.col("event_id").cast("string")).alias("path"), "event_id",
    )


RUNS = """SELECT 'tl_' || ['developmental', 'readability', 'perplexity', 'random'][user_id % 4 + 1] || '_' || CASE WHEN user_id % 3 = 0
  THEN 'competence' ELSE 'staged' END || CASE WHEN user_id % 2 = 0 THEN '_ep5_smallm_mm_seed' ELSE '_ep10_smallm_textonly_seed' END
  || CAST(event_id % 3 AS VARCHAR) || '_0101-' || lpad(CAST(user_id % 50 AS VARCHAR), 6, '0') AS run, 'step_' || CAST((event_id % 7) * 100 AS VARCHAR)
  AS step_name, ['blimp', 'ewok', 'vqa'][event_id % 3 + 1] AS task,
  CAST(floor(value) AS BIGINT) AS score, 'r/' || CAST(event_id AS VARCHAR) AS path, event_id FROM events"""

RUN_SQL = r"""SELECT *, regexp_extract(run, '^tl_(.+)_(staged|competence)_ep', 1) AS "order", regexp_extract(run, '_(staged|competence)_ep', 1)
  AS schedule, CAST(regexp_extract(run, '_ep(\d+)_', 1) AS INTEGER) AS epochs,
  regexp_extract(run, '_ep\d+_([^_]+)lm_', 1) AS lm_init, regexp_extract(run, 'lm_([^_]+)_seed', 1) AS modality, CAST(regexp_extract(run,
  '_seed(\d+)_', 1) AS INTEGER) AS seed, regexp_extract(run, '_seed\d+_(.+)$', 1) AS run_id FROM (""" + RUNS + ")"
