"""Every reader and writer on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillstack.operators import joins, manifest, validate
from quillstack.operators.convert import turns_of
from quillstack.schemas import BANDS, TASKS
from quillstack.sources import models, readers, writers


def test_jsonl_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n')
    assert readers.jsonl(spark, str(tmp_path), "x int").where("x = 1").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path), "x int", strict=True).collect()


def test_first_rows(spark):
    assert [r.id for r in readers.first_rows(spark.range(100).repartition(5), "id", 3).collect()] == [0, 1, 2]


def test_images(spark, tmp_path):
    for name in ("b1/p2.jpg", "b1/p1.jpg", "b2/p1.jpg", "b2/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = readers.images(spark, str(tmp_path), content=True)
    assert sorted((r.book, r.page, bytes(r.content).decode()) for r in found.collect()) == [("b1", "p1", "b1/p1.jpg"), ("b1", "p2", "b1/p2.jpg"), ("b2", "p1", "b2/p1.jpg")]
    assert {r.folder.rsplit("/", 1)[1]: r.n for r in readers.pages_by_folder(found).collect()} == {"b1": 2, "b2": 1}
    assert [r.path.rsplit("/", 1)[1] for r in readers.flat_images(spark, str(tmp_path / "b1")).orderBy("position").collect()] == ["p1.jpg", "p2.jpg"]
    wanted = spark.createDataFrame([("b1/p2.jpg", 1), ("b1/p2.jpg", 2), ("b2/p1.jpg", 3), ("p9.jpg", 4)], "image string, k int")
    loaded = {r.k: r.content and bytes(r.content).decode() for r in joins.with_images(wanted, found).collect()}
    assert loaded == {1: "b1/p2.jpg", 2: "b1/p2.jpg", 3: "b2/p1.jpg", 4: None}
    flat = found.select("path", F.concat_ws("_", "book", "page").alias("name"))
    assert writers.copy_images(flat, str(tmp_path / "flat")).count() == 3
    assert (tmp_path / "flat" / "b1_p2").read_bytes() == b"b1/p2.jpg"


def test_annotations(spark, tmp_path):
    box = [[0.0, 0.0], [2.0, 0.0], [2.0, 3.0], [0.0, 3.0]]
    for book in ("a", "b"):
        (tmp_path / f"{book}.json").write_text(json.dumps([{"page_number": "1", "bounding_box": box}]))
    books = spark.createDataFrame([("a",), ("a",)], "book string")
    assert [(r.book_name, r.row, r.page_number, r.bounding_box[2]) for r in readers.annotations(spark, str(tmp_path), books).collect()] == [("a", 0, "1", [2.0, 3.0])]


def test_csv_and_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    writers.sorted_csv(df, str(tmp_path / "csv"), ["k"])
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "csv"), "k int, v string").orderBy("k").collect()] == [(1, "a"), (2, "b")]
    writers.lines(df.select("v"), str(tmp_path / "txt"))
    writers.lines(df.select("v"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 4
    assert {r.v for r in writers.batches(df)} == {"a", "b"}
    assert {len(r.sha256) for r in writers.checksums(spark, str(tmp_path / "txt")).collect()} == {64}
    assert writers.is_empty_folder(spark, str(tmp_path / "none")) and not writers.is_empty_folder(spark, str(tmp_path / "txt"))


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "a", 0.5)], "k int, v string, x double")
    writers.json_array(df, str(tmp_path / "all.json"), "k")
    assert json.loads((tmp_path / "all.json").read_text()) == [{"k": 1, "v": "a", "x": 0.5}, {"k": 2, "v": "é", "x": None}]
    assert "é" in (tmp_path / "all.json").read_text()
    with pytest.raises(FileExistsError):
        writers.json_array(df, str(tmp_path / "all.json"), "k")
    writers.append_jsonl(df, str(tmp_path / "lines"), by="k")
    writers.append_jsonl(df, str(tmp_path / "lines"), by="k")
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    writers.split_by(df, str(tmp_path / "split"), "v")
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["v=a", "v=é"]
    writers.finite_json(df, str(tmp_path / "finite"))
    assert spark.read.json(str(tmp_path / "finite")).count() == 2
    with pytest.raises(Exception, match="x is not finite"):
        writers.finite_json(df.withColumn("x", F.lit(float("nan"))), str(tmp_path / "nan"))


def test_prompts_and_items(spark, tmp_path):
    assert readers.instructions("a\n\nb\nc") == ["a", "b\nc"]
    (tmp_path / "req.txt").write_text("# pins\nnumpy==1.26.4\n\ntorch==2.1.0\n")
    assert [tuple(r) for r in readers.requirements(spark, str(tmp_path / "req.txt")).collect()] == [("numpy", "1.26.4"), ("torch", "2.1.0")]
    (tmp_path / "vqa.jsonl").write_text('{"image_id": 7, "question": "q", "target": "t", "distractors": ["d"]}\n')
    assert readers.vqa_items(spark, str(tmp_path / "vqa.jsonl")).first().image == "COCO_val2014_000000000007.jpg"
    keys = readers.shard_keys(spark.createDataFrame([("a/b/7",)], "key string")).first()
    assert (keys.book, keys.page) == ("a/b", "7")


def test_images_through_a_backend(spark):
    """A backend sees bytes as they are; rows of like length come together."""
    df = spark.createDataFrame([(b"abc",), (b"",)], "jpg binary")
    out = models.generate(df, "jpg", lambda: lambda images: [str(len(x)) for x in images])
    assert {r.generated_text for r in out.collect()} == {"3", "0"}
    lengths = [[r.id for r in part] for part in models.by_length(spark.range(1000).repartition(7), "id", 4).rdd.glom().collect()]
    assert all(p == sorted(p) for p in lengths) and [p[0] for p in lengths if p] == sorted(p[0] for p in lengths if p)
    ranked = models.rank_completions(spark.createDataFrame([("a", 0, -2.0), ("a", 1, -1.0), ("a", 2, -1.0)], "item string, completion int, loglik double"))
    assert ranked.first().chosen == 1


def test_manifest_from_twelve_files(spark, tmp_path):
    turns = [{"from": "human", "value": "<image>\nWhat is it?"}, {"from": "gpt", "value": "A cat sat. "}]
    n = 0
    for task in TASKS:
        for band in BANDS:
            rows = [{"id": str(i), "image": f"{i}.jpg", "conversations": turns if i < 3 else [turns[0], {"from": "gpt", "value": " "}]} for i in range(4)]
            (tmp_path / f"{task}_{band}.json").write_text(json.dumps(rows))
            n += len(rows)
    item = "id string, image string, conversations array<struct<from:string,value:string>>"
    images = spark.createDataFrame([(f"{i}.jpg",) for i in (0, 2, 3)], "path string")
    out, totals = manifest.from_rows(readers.json_array(spark, str(tmp_path), item), images)
    got = [(r.manifest_index, r.id, r.n_words) for r in out.orderBy("manifest_index").collect()]
    want = [f"{t}_{b}_{i}" for t in TASKS for b in BANDS for i in (0, 2)]
    assert got == [(i, x, 6) for i, x in enumerate(want)]
    assert tuple(totals.first()) == (24, n - 24, 24 * 6)
    wrong = spark.createDataFrame([("caption_3_5.json", 0, "1", "0.jpg", [("gpt", "x"), ("human", "y")])], f"file_name string, row bigint, {item}")
    with pytest.raises(Exception, match="not from human"):
        manifest.from_rows(wrong, images)[0].collect()
    with pytest.raises(Exception, match="no task and band"):
        manifest.from_rows(wrong.withColumn("file_name", F.lit("song_3_5.json")), images)[0].collect()


def test_conversations(spark):
    item = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([("ok", [("human", "a"), ("gpt", "b")]), ("odd", [("human", "a")]), ("role", [("gpt", "a"), ("human", "b")]), ("empty", [("human", "a"), ("gpt", " ")]), ("none", [])], f"id string, conversations {item}")
    assert {r.id: r.rule for r in validate.conversation_violations(df).collect()} == {"odd": "length", "none": "length", "role": "roles", "empty": "empty"}
    turns = df.where("id in ('ok', 'odd')").select("id", turns_of(F.col("conversations")).alias("t")).collect()
    assert {r.id: [(p.user, p.assistant) for p in r.t] for r in turns} == {"ok": [("a", "b")], "odd": []}
