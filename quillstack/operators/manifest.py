"""Conversation records to the flat manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.schemas import BANDS


def manifest(records: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """id, image, task, age_band, turns -> texts without image tags, n_words, fk_grade; records with no turn or an empty side go."""
    bare = F.transform("turns", lambda p: F.struct(T.strip_image_tag(p["user"]).alias("user"), T.strip_image_tag(p["assistant"]).alias("assistant")))
    sound = F.forall("texts", lambda p: (p["user"] != "") & (p["assistant"] != ""))
    joined = F.array_join(F.transform("texts", lambda p: F.concat_ws(" ", p["user"], p["assistant"])), " ")
    kept = records.withColumn("texts", bare).where((F.size("texts") > 0) & sound).withColumn("joined", joined)
    return kept.select(*also, "id", "image", "texts", "task", "age_band", T.word_count(F.col("joined")).alias("n_words"),
        T.fk_grade(F.col("joined")).alias("fk_grade"))


def indexed(records: DataFrame, task: str = "task", band: str = "age_band", row: str = "row") -> DataFrame:
    """manifest_index from 0 by task, band and row: ranks inside each file, offsets from the files' counts."""
    from quillstack.operators.ranking import _ranked
    from quillstack.schemas import TASKS

    file = F.concat(F.array_position(T.lit_array(TASKS), F.col(task)).cast("string"), (T.band_ordinal(F.col(band))).cast("string"))
    return _ranked(records, file, [F.col(row)], (), "manifest_index")


def from_rows(rows: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of annotation files' rows, and one row of totals.

    rows: file_name (task_band.json), row, id, image, conversations; images: path. Rows without their image, and those with
    no turn or an empty side, are skipped and counted. Files come in the order of TASKS, then BANDS. Other names fail.
    """
    from quillstack.operators.convert import turns_of
    from quillstack.schemas import BANDS, TASKS

    files = {f"{t}_{b}.json": (t, b) for t in TASKS for b in BANDS}
    named = F.when(F.col("file_name").isin(*files), F.col("file_name")).otherwise(F.raise_error(F.concat(F.lit("no task and band: "), "file_name")))
    task = F.regexp_extract(named, r"^([a-z]+)_", 1)
    band = F.regexp_extract(named, r"^[a-z]+_(.*)\.json$", 1)
    shown = rows.join(images.select(F.col("path").alias("image")), "image", "left_semi")
    placed = shown.select(F.concat_ws("_", task, band, F.col("id")).alias("id"), "image", task.alias("task"), band.alias("age_band"), "row",
        turns_of(F.col("conversations")).alias("turns"))
    kept = indexed(placed.where(_sound()), row="row")
    out = manifest(kept, ("manifest_index",))
    words = out.agg(F.count(F.lit(1)).alias("n_out"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    return out, words.crossJoin(rows.agg(F.count(F.lit(1)).alias("n_rows"))).select("n_out", (F.col("n_rows") - F.col("n_out")).alias("n_skipped"),
        "words")


def _sound():
    return (F.size("turns") > 0) & F.forall("turns", lambda p: (T.strip_image_tag(p["user"]) != "") & (T.strip_image_tag(p["assistant"]) != ""))


def band_words(records: DataFrame) -> DataFrame:
    """Samples and words of every band, 0 for absent ones."""
    counts = records.groupBy("age_band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    bands = records.sparkSession.createDataFrame([(b,) for b in BANDS], "age_band string")
    return bands.join(counts, "age_band", "left").select("age_band", F.coalesce("n", F.lit(0)).alias("n_samples"),
        F.coalesce("words", F.lit(0)).alias("words"))


def scoring_texts(texts: str = "texts") -> list:
    """prompt (the first question) and full text of a sample."""
    pairs = F.array_join(F.transform(texts, lambda p: F.concat(p["user"], F.lit("\n"), p["assistant"])), "\n")
    return [F.concat(F.element_at(F.col(texts), 1)["user"], F.lit("\n")).alias("prompt"), pairs.alias("full")]
