"""Files to DataFrames. Schemas are given, order is explicit where it matters."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.textops import split_key


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, book: bool = False) -> DataFrame:
    """JSON lines, blank ones skipped; strict fails on a broken line. book adds the file's stem as book_name."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "").alias("book_name"), "*") if book else df


def json_array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """One JSON array a file: its items with file_name and row, their place."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"),
        F.from_json("value", f"array<struct<{item}>>").alias("items"))
    return whole.select("file_name", F.posexplode("items").alias("row", "item")).select("file_name", F.col("row").cast("bigint").alias("row"),
        "item.*")


def first_rows(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The debug limit, by an explicit order."""
    return df.orderBy(order).limit(n)


def images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """book and page of .jpg files in nested folders."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    found = df.select("path", F.element_at(parts, -2).alias("book"), F.regexp_replace(F.element_at(parts, -1), r"\.jpg$", "").alias("page"),
        *(["content"] if content else []))
    return found


def annotations(spark: SparkSession, path: str, books: DataFrame) -> DataFrame:
    """OCR boxes (one JSON array a book), of the given books only."""
    df = json_array(spark, path, "page_number string, bounding_box array<array<double>>")
    return df.select(F.regexp_replace("file_name", r"\.json$", "").alias("book_name"), "row", "page_number",
        "bounding_box").join(books.select(F.col("book").alias("book_name")).distinct(), "book_name", "left_semi")


def flat_images(spark: SparkSession, path: str) -> DataFrame:
    """position and path of the .jpg files of one folder, in order of their paths."""
    from quillstack.operators.ranking import ordered_rank

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path")
    return ordered_rank(found, [F.col("path")], "position")


def pages_by_folder(found: DataFrame) -> DataFrame:
    """(folder, n) of the files in nested folders."""
    return found.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def tar_shards(spark: SparkSession, path: str, members: int = 64) -> DataFrame:
    """url, key, jpg of tar shards; a shard is read as a stream, ``members`` at a time, and left where it is unreadable.

    Paths may be of any file system that Arrow opens (local, HDFS, S3, GCS).
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillstack.sources.writers import _file_system

        for batch in batches:
            for url in batch.column(0).to_pylist():
                files, at = _file_system(url)
                rows: list[tuple[str, bytes]] = []
                with files.open_input_stream(at) as source:
                    try:
                        with tarfile.open(fileobj=source, mode="r|*") as tar:
                            for m in tar:
                                if m.isfile() and m.name.endswith(".jpg"):
                                    rows.append((m.name[:-4], tar.extractfile(m).read()))
                                if len(rows) == members:
                                    yield _members(url, rows)
                                    rows = []
                    except tarfile.TarError:
                        pass  # what came before the damage stays
                if rows:
                    yield _members(url, rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(stream, "url string, key string, jpg binary")


def _members(url: str, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([url] * len(rows)), pa.array([n for n, _ in rows]), pa.array([b for _, b in rows], pa.binary())],
        ["url", "key", "jpg"])


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports with what their path says: run, revision, task, dataset."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda k: F.element_at(parts, -k)
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
        at(7).alias("run"), at(6).alias("revision"), at(3).alias("task"), at(2).alias("dataset"), F.col("value").alias("body"))


def prompt(text: str, system: str = "") -> list[tuple[str, str]]:
    """Turns parted by === lines, user and assistant in turn; the system message goes before the first."""
    parts = [p for p in text.split("===\n") if p]
    out = [("user" if i % 2 == 0 else "assistant", p + "===") for i, p in enumerate(parts)]
    return [(r, system + c) if i == 0 else (r, c) for i, (r, c) in enumerate(out)]


def patterns(raw: bytes) -> list[str]:
    """A pattern a line, with Python's escapes, closing blanks off."""
    return [line.decode("unicode_escape").rstrip() for line in raw.splitlines(keepends=True)]


def instructions(text: str) -> list[str]:
    return text.split("\n\n")


def requirements(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return lines.select(F.split("line", "==", 2)[0].alias("package"), F.split("line", "==", 2)[1].alias("version"))


def vqa_items(spark: SparkSession, path: str) -> DataFrame:
    df = jsonl(spark, path, "image_id bigint, question string, target string, distractors array<string>")
    return df.withColumn("image", F.format_string("COCO_val2014_%012d.jpg", "image_id"))


def shard_keys(df: DataFrame) -> DataFrame:
    return df.select("*", split_key(F.col("key"), "/").alias("k")).select(*df.columns, "k.book", "k.page")
