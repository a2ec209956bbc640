"""DataFrames to files. Each write is one Spark job whose commit is all or nothing."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def split_by(df: DataFrame, path: str, key: str) -> None:
    """One folder a key that occurs; no folder for others."""
    df.write.partitionBy(key).json(path)


def exclusive(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Fails if there is something already."""
    df.write.mode("errorifexists").format(kind).save(path)


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(at) or len(fs.listStatus(at)) == 0


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_tar_shards(samples: DataFrame, folder: str, rows_per_shard: int) -> DataFrame:
    """index, key, jpg -> (shard, rows): tars ``library-NNNNNN.tar`` in the folder; one that is there stays as it is.

    Members stream one by one into a file beside the shard, which takes its name when it is complete: a task that is lost
    leaves no half shard, and its successor writes it anew.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        shard, tar, sink, rows = None, None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if tar is not None:
                tar.close()
                sink.close()
                files.move(part, name)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rows], pa.int64())], ["shard", "rows"])

        name = part = ""
        for batch in batches:
            for at in range(batch.num_rows):
                own, key, jpg = (batch.column(c)[at].as_py() for c in (0, 2, 3))
                if own != shard:
                    yield from close()
                    shard, rows, tar = own, 0, None
                    name = f"{root}/library-{own:06d}.tar"
                    if files.get_file_info(name).type == _not_found():
                        part = _attempt(name)
                        sink = files.open_output_stream(part)
                        tar = tarfile.open(fileobj=sink, mode="w|")
                if tar is not None:
                    info = tarfile.TarInfo(f"{key}.jpg")
                    info.size = len(jpg)
                    tar.addfile(info, io.BytesIO(jpg))
                    rows += 1
        yield from close()

    sharded = samples.select(F.floor(F.col("index") / rows_per_shard).cast("bigint").alias("shard"), "index", "key", "jpg")
    return sharded.repartition("shard").sortWithinPartitions("shard", "index").mapInArrow(pack, "shard bigint, rows bigint")


def _attempt(name: str) -> str:
    """A name of this attempt's own beside the file: two attempts of one task don't write into each other."""
    return f"{name}.{uuid.uuid4().hex}.part"


def _not_found():
    from pyarrow import fs

    return fs.FileType.NotFound


def copy_images(images: DataFrame, folder: str) -> DataFrame:
    """path, name -> (name): each file copied to its flat name in the folder, in pieces; what is there is replaced.

    A copy takes its name when it is complete.
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = _file_system(folder)
        to.create_dir(root, recursive=True)
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, at = _file_system(path)
                part = _attempt(f"{root}/{name}")
                with files.open_input_stream(at) as source, to.open_output_stream(part) as sink:
                    while piece := source.read(1 << 20):
                        sink.write(piece)
                to.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["name"])

    return images.select(F.col("path").cast("string"), F.col("name").cast("string")).mapInArrow(copy, "name string")


def json_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array in a new file, in order: rows stream through the driver, which writes them one by one."""
    import json

    files, at = _file_system(path)
    if files.get_file_info(at).type != _not_found():
        raise FileExistsError(path)
    with files.open_output_stream(at) as sink:
        sink.write(b"[")
        for i, (row,) in enumerate(df.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
            text = json.dumps(json.loads(row), ensure_ascii=False, indent=2, allow_nan=False)
            sink.write((("," if i else "") + "\n  " + text.replace("\n", "\n  ")).encode())
        sink.write(b"\n]\n")


def finite_json(df: DataFrame, path: str) -> None:
    """JSON lines in a new folder; a number that is not finite fails the job."""
    from quillstack.operators.validate import finite

    sound = {f.name: finite(F.col(f.name), f.name) for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    exclusive(df.withColumns(sound) if sound else df, path, "json")


def sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.option("header", True).csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and path of every file below, by path. A file streams through its task in pieces, whatever its size."""
    from quillstack.sources.ranged import listing

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                files, at = _file_system(name)
                own = hashlib.sha256()
                with files.open_input_stream(at) as source:
                    while piece := source.read(1 << 20):
                        own.update(piece)
                found.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0)], ["sha256", "path"])

    files = listing(spark, path).select("path", "size")
    dealt = files.repartition(max(1, min(files.count(), 1000)), "path").select("path")
    return dealt.mapInArrow(digest, "sha256 string, path string").orderBy("path")


def lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("append").text(path)


def batches(df: DataFrame) -> Iterator:
    return df.toLocalIterator(prefetchPartitions=True)
