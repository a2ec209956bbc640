"""Quirks and file operators on literal rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.operators import convert, curriculum, joins, labels, results, validate
from quillstack.schemas import BANDS
from quillstack.sources import models, readers, writers
from quillstack.streaming.resume import process_new_files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_text_quirks(spark):
    assert one(spark, "no marker", T.extract_cleaned) == "no marke"
    assert one(spark, "Cleaned:\nab===cd", T.extract_cleaned) == "ab"
    assert one(spark, "Cleaned:\n     ab===cd", T.extract_cleaned) == "ab"
    assert one(spark, "aBCDe", lambda c: T.truncate_at(c, ("CD", "BCD"))) == "aB"
    assert one(spark, "red\norange", T.caption_separators) == "red"
    assert one(spark, "x\n===\n\ny===z---", T.caption_separators) == "x\n\ny"
    assert one(spark, "Thai: rice", T.speaker_turns) == ["rice"]
    assert one(spark, "Age group: 9+", T.age_label) is None and one(spark, "a\nAge group: 9-12+", T.age_label) == "9-12"
    assert one(spark, "is 9+ or 12+", T.audit_label) == "9+" and one(spark, "?", T.audit_label) == "unparsed"
    assert one(spark, "\n12. x", lambda c: T.clean_page(c, F.lit("b"))) == "x"
    assert one(spark, "Tale's Of Foxes: once 3.", lambda c: T.clean_page(c, F.lit("Tales Of Foxes"))) == "once"
    assert one(spark, "out/book-a.jsonl", T.book_key) == "book-a"
    assert one(spark, "a_b_7", lambda c: T.split_key(c, "_")) == ("a_b", "7")


def test_dialogue(spark):
    text = "intro Child: hi? AI: yes.\n=== Child: what of the description? AI: no. Child: odd"
    rows = spark.createDataFrame([("b", "1", text), ("b", "2", "ERR Child: a AI: b"), ("b", "3", "Child: a b c AI: d e f")], "book_name string, page_number string, generated_text string")
    out = {r.id: r.turns for r in convert.dialogue_records(rows, (), ("ERR",), budget=4).collect()}
    assert [t.assistant for t in out["b_1"]] == ["yes."] and "<image>" in out["b_1"][0].user and out["b_3"] == [] and "b_2" not in out


def test_majority_ties(spark):
    votes = spark.createDataFrame([("a", 0, "12+"), ("a", 1, "6-8"), ("b", 0, None)], "book string, pos int, label string")
    assert [tuple(r) for r in labels.majority(votes).collect()] == [("a", "6-8")]
    assert labels.first_majority(votes.where("book = 'a'"), "book", "label", "pos").first().pred == "12+"


def test_age_join(spark):
    desc = spark.createDataFrame([(0, "book-a", "0001", "kept"), (1, "book-b", "0002", "m"), (2, "book-c", "0003", "u")], "idx int, book_name string, page_number string, caption string")
    names = spark.createDataFrame([(0, "book-a.jsonl", "6-8"), (1, "book-a", "3-5"), (2, "book-b", "6-8")], "ordinal int, book_name string, age_group string")
    out = joins.age_join(desc, names, spark.createDataFrame([("book-a_0001.jpg",)], "path string"))
    assert {r.book_name: (r.status, r.age_group) for r in out.collect()} == {"book-a": ("written", "3-5"), "book-b": ("missing_image", "6-8"), "book-c": ("missing_label", None)}
    assert {r.example for r in joins.first_rejects(out).collect()} == {"book-b/0002", "book-c/0003"}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, f"caption_3_5_page{i}", f"page{i}.jpg", "caption", BANDS[i % 4], 3, 10, float(i), 1 + i / 100, 2 + i / 100, 3 + i / 100) for i in range(100)]
    return spark.createDataFrame(rows, "idx bigint, id string, image string, task string, age_band string, n_words bigint, n_tokens bigint, fk_grade double, nll double, nll_qwen double, nll_gemma double").cache()


@pytest.mark.parametrize(("order", "schedule"), [("developmental", "staged"), ("perplexity", "competence"), ("randomblock", "staged"), ("random", None)])
@pytest.mark.parametrize("build", [curriculum.build_order, curriculum.numpy_order])
def test_orders(scored, order, schedule, build):
    seq = build(scored, order, schedule, 2, 1)
    seen = curriculum.exposure(seq, 100).first()
    assert seen.draws == 200 and seen.unique_samples + seen.omitted == 100
    assert not curriculum.sequence_violations(seq, 100, 2, schedule != "competence").count()
    if schedule == "staged":
        assert (seen.min_exposure, seen.max_exposure) == (2, 2)


def test_order_errors(scored, spark):
    for order, schedule in (("randomblock", "competence"), ("nonsense", "staged"), ("perplexity", "other")):
        with pytest.raises(ValueError):
            curriculum.build_order(scored, order, schedule, 2, 1)
    for bad, n, permuted in (([0, 0], 2, True), ([0, 2], 2, False)):
        df = spark.createDataFrame(list(enumerate(bad)), "position bigint, sample_index bigint")
        assert curriculum.sequence_violations(df, n, 1, permuted).count()
    specs = curriculum.order_specs(spark)
    assert specs.count() == specs.distinct().count() == 63


def test_split(scored):
    out = curriculum.split_records(scored)
    assert {(r.split, r["count"]) for r in out.groupBy("split").count().collect()} == {("train", 98), ("validation", 2)}


def test_records(scored):
    assert not validate.record_violations(scored).count()
    for bad in (None, float("nan"), float("inf"), -1.0):
        assert {r.rule for r in validate.record_violations(scored.withColumn("nll", F.lit(bad).cast("double"))).collect()} == {"nll"}
    assert not validate.record_violations(scored.withColumn("fk_grade", F.lit(-2.5))).count()
    assert validate.record_violations(scored.unionByName(scored.limit(1))).first().rule == "duplicate"
    with pytest.raises(ValueError, match="duplicate"):
        validate.require_none(validate.record_violations(scored.unionByName(scored.limit(1))), "records")


def test_reports(spark, tmp_path):
    for epochs, score in ((5, 50.0), (10, 70.0)):
        at = tmp_path / f"tl_random_staged_ep{epochs}_smallm_mm_seed0_x/main/zero_shot/causal/blimp/all"
        at.mkdir(parents=True)
        (at / "best_temperature_report.txt").write_text(f"### AVERAGE ACCURACY\n{score}\n")
    got = results.parse_runs(readers.reports(spark, str(tmp_path)).withColumn("score", results.report_accuracy(F.col("body"))))
    table = results.pivot_means(got, ["epochs"], "task", ("blimp", "ewok"), "score")
    assert results.markdown(table, ["epochs"], ("blimp", "ewok"))[2:] == ["| 5 | 50.00 | — |", "| 10 | 70.00 | — |"]


def test_files(spark, tmp_path):
    src = tmp_path / "book1.jsonl"
    src.write_text('{"page_number": "1", "text": "a"}\n\n{"page_number": "2", "text": "b"}\n')
    assert [r.book_name for r in readers.jsonl(spark, str(src), "page_number string, text string", book=True).collect()] == ["book1", "book1"]
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert [(r.row, r.a) for r in readers.json_array(spark, str(tmp_path / "x.json"), "a int").collect()] == [(0, 1), (1, 2)]
    samples = spark.createDataFrame([(i, f"b/{i}", bytes([i])) for i in range(5)], "index int, key string, jpg binary")
    assert sorted(map(tuple, writers.write_tar_shards(samples, str(tmp_path / "tar"), 2).collect())) == [(0, 2), (1, 2), (2, 1)]
    assert sorted(os.listdir(tmp_path / "tar")) == [f"library-00000{i}.tar" for i in range(3)]
    (tmp_path / "tar" / "library-000001.tar").unlink()
    assert [tuple(r) for r in writers.write_tar_shards(samples, str(tmp_path / "tar"), 2).collect()] == [(1, 2)]  # the others are there
    (tmp_path / "tar" / "library-000009.tar").write_bytes(b"no tar at all")
    assert sorted((r.key, bytes(r.jpg)) for r in readers.tar_shards(spark, str(tmp_path / "tar"), members=1).collect()) == [(f"b/{i}", bytes([i])) for i in range(5)]
    writers.exclusive(samples, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exists"):
        writers.exclusive(samples, str(tmp_path / "once"))
    assert readers.prompt("a===\nb===\n", "S ") == [("user", "S a==="), ("assistant", "b===")]
    assert readers.patterns(b"\\nI hope \nx") == ["\nI hope", "x"]


def test_generate_and_stream(spark, tmp_path):
    def backend():
        def run(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return run

    out = models.generate(spark.createDataFrame([("a",), ("bad",)], "p string").coalesce(1), "p", backend).collect()
    assert {(r.p, r.generated_text, r.error) for r in out} == {("a", "A", None), ("bad", None, "RuntimeError: no")}
    src = tmp_path / "in"
    src.mkdir()
    for k in (1, 2):
        (src / f"{k}.json").write_text(json.dumps({"k": k}) + "\n")
        process_new_files(spark, str(src), "k int", str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
