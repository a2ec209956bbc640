"""One large file, many tasks: tars by member offsets, JSON arrays by ranges of bytes."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillstack.sources import ranged, readers


def make_tar(path, members, fmt=tarfile.GNU_FORMAT):
    with tarfile.open(path, "w", format=fmt) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("fmt", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_one_tar_by_several_tasks(spark, tmp_path, fmt):
    draw = random.Random(1)
    long = "d" * 60 + "/" + "n" * 70 if fmt == tarfile.USTAR_FORMAT else "d/" + "n" * 150
    members = [(f"b/{i}.jpg", draw.randbytes(draw.choice((0, 1, 511, 512, 513, 4000)))) for i in range(200)]
    members += [("b/note.txt", b"no image"), (f"{long}.jpg", b"long name"), ("b/é.jpg", b"accent")]
    make_tar(tmp_path / "one.tar", members, fmt)
    got = ranged.tar_members(spark, str(tmp_path), range_bytes=30_000)
    assert got.rdd.getNumPartitions() >= 5
    assert got.where("jpg is not null").groupBy(F.spark_partition_id()).count().count() >= 5
    assert sorted((r.key, bytes(r.jpg)) for r in got.collect()) == sorted((n[:-4], d) for n, d in members if n.endswith(".jpg"))
    same = readers.tar_shards(spark, str(tmp_path))
    assert sorted((r.key, bytes(r.jpg)) for r in same.collect()) == sorted((r.key, bytes(r.jpg)) for r in got.collect())


def test_damaged_members_are_left_out(spark, tmp_path):
    members = [(f"{i}.jpg", bytes([i]) * 700) for i in range(20)]
    make_tar(tmp_path / "bad.tar", members)
    raw = bytearray((tmp_path / "bad.tar").read_bytes())
    raw[5 * 1536 + 100 : 5 * 1536 + 140] = b"\xff" * 40  # the header of member 5
    (tmp_path / "bad.tar").write_bytes(raw[: 18 * 1536 + 900])  # and member 18 is cut off
    make_tar(tmp_path / "good.tar", [("x.jpg", b"x")])
    (tmp_path / "empty.tar").write_bytes(b"")
    got = {(r.url.rsplit("/", 1)[1], r.key) for r in ranged.tar_members(spark, str(tmp_path), range_bytes=4000).collect()}
    assert got == {("bad.tar", str(i)) for i in range(18) if i != 5} | {("good.tar", "x")}


ITEM = "id string, n long, inner struct<a: string, b: array<struct<c: string>>>"


def nasty(n, seed=3):
    draw = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", " ", "é", "\n", "x", '\\"', "\\\\", "日"]
    word = lambda: "".join(draw.choice(bits) for _ in range(draw.randrange(12)))
    return [{"id": word(), "n": i, "inner": {"a": word(), "b": [{"c": word()} for _ in range(draw.randrange(3))]}} for i in range(n)]


@pytest.mark.parametrize(("size", "indent"), [(7, None), (64, 2), (1000, None), (1 << 20, 1)])
def test_one_array_by_many_ranges(spark, tmp_path, size, indent):
    rows = nasty(60 if size > 10 else 12)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[:3]))
    (tmp_path / "none.json").write_text(" [ ] ")
    got = ranged.json_array_ranges(spark, str(tmp_path), ITEM, range_bytes=size)
    want = readers.json_array(spark, str(tmp_path), ITEM)
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(got) == same(want)
    assert [r.id for r in got.where("file_name = 'a.json'").orderBy("row").collect()] == [r["id"] for r in rows]


def test_an_array_without_end(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "y')
    with pytest.raises(Exception, match="no end"):
        ranged.json_array_ranges(spark, str(tmp_path), ITEM, range_bytes=8).collect()


def test_checksums_stream(spark, tmp_path):
    import hashlib

    from quillstack.sources import writers

    data = {"a.bin": b"", "b.bin": b"x" * 3_000_001, "d/c.bin": bytes(range(256)) * 9}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = [(r.path.removeprefix(f"{tmp_path}/"), r.sha256) for r in writers.checksums(spark, str(tmp_path)).collect()]
    assert got == [(n, hashlib.sha256(c).hexdigest()) for n, c in sorted(data.items())]
