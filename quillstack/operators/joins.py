"""Joins with what they reject, resume keys, reconciliation. Small sides are left to the optimizer's size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.textops import book_key, image_candidates


def age_join(descriptions: DataFrame, labels: DataFrame, images: DataFrame) -> DataFrame:
    """descriptions (idx, book_name, page_number, caption) with age_group and ``status``: written, missing_label or
    missing_image. labels (ordinal, book_name, age_group): of several the last counts. images: (path)."""
    last = labels.groupBy(book_key(F.col("book_name")).alias("book_name")).agg(F.max_by("age_group", "ordinal").alias("age_group"))
    labelled = descriptions.join(last, "book_name", "left")
    wanted = labelled.select("idx", F.explode(image_candidates(F.col("book_name"), F.col("page_number"))).alias("path"))
    shown = wanted.join(images.select("path"), "path", "left_semi").select("idx").distinct().withColumn("shown", F.lit(True))
    status = F.when(F.col("age_group").isNull(), "missing_label").when(F.col("shown").isNull(), "missing_image").otherwise("written")
    return labelled.join(shown, "idx", "left").withColumn("status", status).drop("shown")


def reject_report(joined: DataFrame) -> DataFrame:
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def first_rejects(joined: DataFrame, most: int = 10) -> DataFrame:
    """The first examples of every reason, in input order. A limit by rank is planned as a partial top-k per task."""
    order = F.row_number().over(Window.partitionBy("status").orderBy("idx"))
    return joined.where("status <> 'written'").withColumn("place", order).where(F.col("place") <= most).select("status",
        F.col("place").cast("bigint").alias("place"), F.concat_ws("/", "book_name", "page_number").alias("example"))


def with_original(chunks: DataFrame, originals: DataFrame, phrase: str) -> DataFrame:
    """chunks (book_name, page_number, chunk_idx, text): where the text has the phrase and the chunk is the first left of
    its page, the original text replaces it; without an original the chunk is dropped. Of several originals of a page the one
    with the greatest ``ordinal`` counts (the greatest text, where there is no such column)."""
    first = F.row_number().over(Window.partitionBy("book_name", "page_number").orderBy("chunk_idx")) == 1
    flagged = chunks.withColumn("wants", F.col("text").contains(phrase))
    # a first chunk without its original goes, and the next becomes the first: settled before ranks are given
    last = F.max_by("text", "ordinal") if "ordinal" in originals.columns else F.max("text")
    source = originals.groupBy("book_name", "page_number").agg(last.alias("original"))
    joined = flagged.join(source, ["book_name", "page_number"], "left")
    dropped = F.col("wants") & F.col("original").isNull()
    lead = F.min(F.when(~dropped, F.col("chunk_idx"))).over(Window.partitionBy("book_name", "page_number"))
    kept = joined.withColumn("lead", lead).where(~(dropped & (F.col("lead").isNull() | (F.col("chunk_idx") < F.col("lead")))))
    return kept.withColumn("text", F.when(F.col("wants") & first, F.col("original")).otherwise(F.col("text"))).select(*chunks.columns)


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(done.select(*on), on, "left_anti")


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """(key columns, side): keys of one side only; empty if the sets are equal."""
    a, b = expected.select(*on).distinct().withColumn("l", F.lit(1)), actual.select(*on).distinct().withColumn("r", F.lit(1))
    return a.join(b, on, "full_outer").where("l is null or r is null").select(*on,
        F.when(F.col("r").isNull(), "missing").otherwise("unexpected").alias("side"))


def merge_scores(base: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """base (manifest_index, image, ...) with the other teacher's nll as ``nll_<name>``; both must align."""
    alt = other.select("manifest_index", F.col("image").alias("image_alt"), F.col("nll").alias(f"nll_{name}"))
    joined = base.join(alt, "manifest_index", "full_outer")
    bad = F.col("image").isNull() | F.col("image_alt").isNull() | (F.col("image") != F.col("image_alt"))
    return joined.withColumn(f"nll_{name}",
        F.when(bad, F.raise_error(F.lit("scores do not align")).cast("double")).otherwise(F.col(f"nll_{name}"))).drop("image_alt")


def with_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (image: a path below the image folder) with ``content`` of the file of that path; null if there is none.

    files: path, content. A record's path is met by the end of a file's, part by part, so folders above don't matter.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    named = files.select("path", F.explode(ends).alias("image"))
    # names first: of several files the one with the least path; no content moves before its path is known
    found = named.join(records.select("image").distinct(), "image", "left_semi").groupBy("image").agg(F.min("path").alias("__path"))
    shown = records.join(found, "image", "left")
    return shown.join(files.select(F.col("path").alias("__path"), "content"), "__path", "left").drop("__path")
