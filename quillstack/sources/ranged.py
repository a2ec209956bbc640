"""Large files read by several tasks: tar shards by their members' offsets, JSON arrays by ranges of bytes.

Files are opened by Arrow, so they may be of any file system that it knows (local, HDFS, S3, GCS). Listings ask for names
and sizes alone. No file, and no part of one but a single member or item, has to fit a cell.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.stored import stored
from quillstack.sources.writers import _file_system

#: Bytes that one task reads.
RANGE = 64 << 20
BLOCK = 512


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, size of the files in a folder, or of one file. A row a file: names come to the driver, contents don't."""
    from pyarrow import fs

    files, root = _file_system(path)
    info = files.get_file_info(root)
    found = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    lead = path.split("://")[0] + "://" if "://" in path else ""
    rows = [(lead + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)]
    return spark.createDataFrame(sorted(rows), "path string, size long")


def _long_name(header: tarfile.TarInfo, data: bytes) -> str | None:
    """The name that a header of the GNU or PAX kind gives the next member."""
    if header.type == tarfile.GNUTYPE_LONGNAME:
        return data.rstrip(b"\0").decode("utf-8", "surrogateescape")
    while data:
        size = data.partition(b" ")[0]
        if not size.isdigit():
            break
        key, _, value = data[len(size) + 1 : int(size) - 1].partition(b"=")
        if key == b"path":
            return value.decode("utf-8", "surrogateescape")
        data = data[int(size) :] if int(size) else b""
    return None


def tar_headers(source, size: int) -> Iterator[tuple[str, int, int]]:
    """(name, offset, size) of the regular members of an open tar: only headers are read.

    After a damaged header the search goes on, block by block, for the next sound one; a member that the file's end cuts off
    is left out.
    """
    at, name = 0, None
    while at + BLOCK <= size:
        source.seek(at)
        block = source.read(BLOCK)
        try:
            header = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        except tarfile.HeaderError:
            at, name = at + BLOCK, None
            continue
        data = at + BLOCK
        if data + header.size > size:
            at, name = at + BLOCK, None
            continue
        if header.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE):
            source.seek(data)
            name = _long_name(header, source.read(header.size)) or name
        elif header.isreg():
            yield name or header.name, data, header.size
            name = None
        else:
            name = None
        at = data + -(-header.size // BLOCK) * BLOCK


def tar_index(files: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """path, key (name without suffix), offset, length of the members of tars that are not compressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                opened, at = _file_system(path)
                rows: list[tuple] = []
                with opened.open_input_file(at) as source:
                    for name, offset, length in tar_headers(source, size):
                        if name.endswith(suffix):
                            rows.append((name[: len(name) - len(suffix)], offset, length))
                        if len(rows) == 10_000:
                            yield _table(path, rows)
                            rows = []
                yield _table(path, rows)

    def _table(path: str, rows: list[tuple]) -> pa.RecordBatch:
        cells = [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(cells, ["path", "key", "offset", "length"])

    return files.repartition(max(1, min(files.count(), 1000))).mapInArrow(read, "path string, key string, offset long, length long")


def tar_members(spark: SparkSession, path: str, suffix: str = ".jpg", range_bytes: int = RANGE) -> DataFrame:
    """url, key, jpg of all members: each task reads a run of members of about ``range_bytes``, in any tar."""
    index = stored(tar_index(listing(spark, path, ".tar"), suffix))
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartitionByRange(max(1, -(-total // range_bytes)), "path", "offset").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for p, key, offset, length in zip(*(batch[c].to_pylist() for c in ("path", "key", "offset", "length")), strict=True):
                if p != opened:
                    if source is not None:
                        source.close()
                    files, at = _file_system(p)
                    opened, source = p, files.open_input_file(at)
                source.seek(offset)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([key]), pa.array([source.read(length)], pa.binary())], ["url", "key", "jpg"])
        if source is not None:
            source.close()

    return dealt.mapInArrow(read, "url string, key string, jpg binary")


@dataclass
class Marks:
    """What a range of bytes of a JSON text holds, given whether it starts inside a string and after an odd run of backslashes."""

    inside: bool
    odd: bool

    def __post_init__(self):
        self.depth = 0

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of braces and brackets outside strings, the depth before each, and what they are. Goes on after the last call."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), b
        here = np.arange(len(b))
        last = np.maximum.accumulate(np.where(b != 92, here, -1))  # the last byte that is no backslash
        before = np.concatenate([[-1], last[:-1]])
        run = here - 1 - before + (self.odd & (before < 0))
        toggles = (b == 34) & (run % 2 == 0)
        within = (np.cumsum(toggles) + self.inside) % 2 == 1  # after the byte; a closing quote is outside, no matter here
        at = np.flatnonzero(((b == 123) | (b == 125) | (b == 91) | (b == 93)) & ~within)
        step = np.where((b[at] == 123) | (b[at] == 91), 1, -1)
        upto = np.cumsum(step) + self.depth
        self.inside = bool(within[-1])
        tail = len(b) - 1 - last[-1] + (self.odd if last[-1] < 0 else 0)
        self.odd, self.depth = bool(tail % 2), int(upto[-1]) if len(at) else self.depth
        return at, upto - step, b[at]


EFFECT = "file string, part long, start long, length long, effects array<struct<inside: boolean, odd: boolean, depth: long, at: array<long>, objects: array<long>>>"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range, for each of the four ways to start: how it ends, and how many objects open at each depth below the start's."""
    for batch in batches:
        for row in batch.to_pylist():
            files, at = _file_system(row["file"])
            with files.open_input_file(at) as source:
                source.seek(row["start"])
                data = source.read(row["length"])
            made = []
            for inside, odd in ((False, False), (False, True), (True, False), (True, True)):
                m = Marks(inside, odd)
                _, before, kind = m.read(data)
                depths, n = np.unique(before[kind == 123], return_counts=True)
                made.append({"inside": m.inside, "odd": m.odd, "depth": m.depth, "at": depths.tolist(), "objects": n.tolist()})
            kinds = pa.list_(pa.struct([("inside", pa.bool_()), ("odd", pa.bool_()), ("depth", pa.int64()), ("at", pa.list_(pa.int64())), ("objects", pa.list_(pa.int64()))]))
            cells = [pa.array([row["file"]]), *(pa.array([row[c]], pa.int64()) for c in ("part", "start", "length")), pa.array([made], kinds)]
            yield pa.RecordBatch.from_arrays(cells, ["file", "part", "start", "length", "effects"])


def _started(table: pa.Table) -> pa.Table:
    """A file's ranges in order: how each starts, and the items before it. A row a range."""
    inside, odd, depth, items, out = False, False, 0, 0, []
    for r in table.sort_by("part").to_pylist():
        out.append({k: r[k] for k in ("file", "part", "start", "length")} | {"inside": inside, "odd": odd, "depth": depth, "items": items})
        e = r["effects"][2 * inside + odd]
        items += dict(zip(e["at"], e["objects"], strict=True)).get(1 - depth, 0)
        inside, odd, depth = e["inside"], e["odd"], depth + e["depth"]
    kinds = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("part", "start", "length")), ("inside", pa.bool_()), ("odd", pa.bool_()), ("depth", pa.int64()), ("items", pa.int64())])
    return pa.Table.from_pylist(out, kinds)


def _items(piece: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = _file_system(row["file"])
                with files.open_input_file(at) as source:
                    source.seek(row["start"])
                    data = source.read(row["length"])
                    m = Marks(row["inside"], row["odd"])
                    m.depth = row["depth"]
                    places, before, kind = m.read(data)
                    starts = places[(kind == 123) & (before == 1)].tolist()
                    ends = places[(kind == 125) & (before == 2)].tolist()
                    if ends and (not starts or ends[0] < starts[0]):
                        del ends[0]  # of an item that an earlier range has
                    while len(ends) < len(starts):  # the last item goes on in what follows
                        more = source.read(piece)
                        if not more:
                            raise ValueError(f"{row['file']}: an item has no end")
                        places, before, kind = m.read(more)
                        found = places[(kind == 125) & (before == 2)]
                        ends += [len(data) + int(found[0])] if len(found) else []
                        data += more
                for n in range(0, len(starts), 1000):
                    own = list(zip(starts[n : n + 1000], ends[n : n + 1000], strict=True))
                    texts = pa.array([data[s : e + 1].decode() for s, e in own], pa.string())
                    numbers = pa.array([row["items"] + n + k for k in range(len(own))], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(own)), numbers, texts], ["file", "row", "json"])

    return read


def json_array_ranges(spark: SparkSession, path: str, item: str, range_bytes: int = RANGE) -> DataFrame:
    """file_name, row and the fields of the objects of JSON arrays, a file read by as many tasks as it has ranges.

    Whether a range starts inside a string, and how deep, hangs on all bytes before it: each range tells what it makes of
    every way to start, these are composed in order, and then each range has its items; the task in which an item starts
    reads it to its end. Files hold one array of objects; escapes and braces in strings are told apart.
    """
    files = listing(spark, path, ".json")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select(F.col("path").alias("file"), "size", F.posexplode(starts).alias("part", "start"))
    ranges = ranges.select("file", F.col("part").cast("long").alias("part"), "start", F.least(F.lit(range_bytes), F.col("size") - F.col("start")).cast("long").alias("length"))
    n = max(1, min(ranges.count(), 100_000))
    effects = ranges.repartition(n, "file", "part").mapInArrow(_effects, EFFECT)
    begun = stored(effects.groupBy("file").applyInArrow(_started, "file string, part long, start long, length long, inside boolean, odd boolean, depth long, items long"))
    found = begun.repartition(n, "file", "part").mapInArrow(_items(min(range_bytes, 1 << 20)), "file string, row long, json string")
    parsed = found.select(F.element_at(F.split("file", "/"), -1).alias("file_name"), "row", F.from_json("json", item).alias("item"))
    return parsed.select("file_name", "row", "item.*")
