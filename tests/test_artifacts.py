"""Checks of exports, reports against published numbers, orders whose ties fall anew."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillstack.operators import artifacts, cleaning, curriculum, joins, results
from quillstack.operators.ranking import cuts_upto, ordered_rank, quantile_cuts, score_rank

# Published BLiMP accuracies of three seeds, and the published mean and deviation.
SEEDS = """
ep10 antidevelopmental competence 51.10 52.25 51.67 = 51.67 0.58
ep10 antidevelopmental staged 52.19 50.17 52.22 = 51.53 1.18
ep10 developmental competence 52.88 50.98 52.61 = 52.16 1.03
ep10 developmental staged 51.16 52.44 51.83 = 51.81 0.64
ep10 gemmappl staged 54.20 54.13 53.76 = 54.03 0.24
ep10 perplexity competence 54.55 53.44 52.47 = 53.49 1.04
ep10 perplexity staged 53.29 55.03 57.38 = 55.23 2.05
ep10 qwenppl staged 51.76 53.88 52.25 = 52.63 1.11
ep10 random staged 53.79 53.08 53.23 = 53.37 0.37
ep10 randomblock staged 52.80 51.64 53.80 = 52.75 1.08
ep10 readability competence 51.78 52.84 52.86 = 52.49 0.62
ep10 readability staged 50.93 54.23 53.13 = 52.76 1.68
ep5 antidevelopmental competence 51.71 51.59 53.19 = 52.16 0.89
ep5 antidevelopmental staged 53.10 53.55 56.59 = 54.41 1.90
ep5 developmental competence 51.69 53.30 54.99 = 53.33 1.65
ep5 developmental staged 54.43 53.40 53.96 = 53.93 0.52
ep5 perplexity competence 55.85 54.52 56.45 = 55.61 0.99
ep5 perplexity staged 52.77 54.87 56.78 = 54.81 2.01
ep5 random staged 52.40 53.02 54.15 = 53.19 0.89
ep5 readability competence 53.96 51.04 53.37 = 52.79 1.54
ep5 readability staged 53.30 53.71 52.35 = 53.12 0.70
"""


@pytest.fixture(scope="module")
def published(spark):
    rows = [line.replace(" =", "").split() for line in SEEDS.strip().split("\n")]
    seeds = [(e, o, s, k, float(r[k])) for e, o, s, *r in rows for k in range(3)]
    want = {(e, o, s): (float(r[3]), float(r[4])) for e, o, s, *r in rows}
    return spark.createDataFrame(seeds, "epochs string, order string, schedule string, seed int, blimp double"), want


def test_published_means(published):
    df, want = published
    got = results.mean_sd(df, ["epochs", "order", "schedule"], "blimp").collect()
    assert len(got) == 21 and all(r.n == 3 for r in got)
    for r in got:
        mean, sd = want[r.epochs, r.order, r.schedule]
        assert abs(r["mean"] - mean) <= 0.00501 and abs(r.sd - sd) <= 0.00501


def test_random_baseline_and_panels(published):
    df, _ = published
    base = {r.epochs: r.baseline for r in results.against_random(df, "blimp").collect()}
    assert round(base["ep5"], 2) == 53.19 and round(base["ep10"], 2) == 53.37
    shown = results.panels(df.where("epochs = 'ep10'")).withColumn("label", results.order_label())
    got = {(r.panel, r.label) for r in shown.collect()}
    assert ("staged", "random") in got and ("competence", "random") in got and ("staged", "random-block") in got
    assert ("competence", "random-block") not in got and ("competence", "perplexity/comp") in got and ("staged", "perplexity (Gemma)") in got


def test_repeated_results_fail(spark):
    df = spark.createDataFrame([("a", "x", "p1"), ("a", "x", "p2"), ("b", "x", "p3")], "run string, task string, path string")
    with pytest.raises(ValueError, match="2 results of a/x: p1 and p2"):
        results.require_unique(df, ["run", "task"])
    results.require_unique(df.where("path <> 'p2'"), ["run", "task"])


def test_repeated_keys_name_their_lines(spark):
    lines = spark.createDataFrame([("b", "1", "f1", 4), ("b", "1", "f0", 9), ("b", "1", "f0", 2), ("b", "2", "f1", 1)], "book string, page string, file string, line int")
    assert [tuple(r) for r in artifacts.repeated_keys(lines, ["book", "page"]).collect()] == [("b", "1", 3, "f0:2", "f0:9")]
    more = artifacts.too_many(spark.createDataFrame([(1,), (1,), (2,)], "shard int"), spark.createDataFrame([(1,), (2,), (2,), (3,)], "shard int"), "shard")
    assert sorted(map(tuple, more.collect())) == [(2, 1, 2), (3, 0, 1)]


def test_split_and_order_checks(spark):
    ids = spark.createDataFrame([(i, str(i)) for i in range(6)], "manifest_index int, id string")
    parts = {"train": ids.where("manifest_index < 4"), "validation": ids.where("manifest_index in (3, 5)").unionByName(spark.createDataFrame([(9, "x")], "manifest_index int, id string"))}
    assert sorted(map(tuple, artifacts.split_violations(ids, parts).collect())) == [("3", 2), ("4", 0), ("x", -1)]
    assert not artifacts.order_violations(ids.withColumnRenamed("manifest_index", "position"), ids).count()
    expected = spark.createDataFrame([("train", 4), ("validation", 2)], "split string, n bigint")
    actual = spark.createDataFrame([("train", 4), ("validation", 3)], "split string, n bigint")
    assert [tuple(r) for r in artifacts.count_violations(actual, expected, "split").collect()] == [("validation", 3, 2)]


def test_digests_and_round_trip(spark, tmp_path):
    import numpy as np

    df = spark.range(1000).select("id", F.concat(F.lit("s"), F.col("id")).alias("name"), (999 - F.col("id")).alias("back")).repartition(7)
    assert artifacts.column_digest(df, "id", "name") == hashlib.sha256("\n".join(f"s{i}" for i in range(1000)).encode()).hexdigest()
    assert artifacts.column_digest(df, "id", "back", words=True) == hashlib.sha256(np.arange(999, -1, -1).astype("<u4").tobytes()).hexdigest()
    assert artifacts.column_digest(df.where("false"), "id", "name") == hashlib.sha256(b"").hexdigest()
    assert artifacts.round_trip(df, str(tmp_path / "t")).count() == 0
    assert artifacts.differing_rows(df, df.unionByName(df.limit(1))).select("side").collect()[0].side == "second"


def test_order_specs_cover_all_configurations(spark):
    specs = curriculum.order_specs(spark)
    assert specs.count() == 63 and specs.agg(F.sum(F.size("modalities"))).first()[0] == 72


def test_ties_at_an_edge_fall_anew_in_every_epoch(spark):
    scores = [0.0] * 10 + [float(i) for i in range(1, 6)] + [7.0] * 30 + [float(i) for i in range(8, 23)]
    df = spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(scores)], "idx bigint, id string, score double")
    staged, sizes = curriculum.epoch_stages(df, 3, 6)
    assert sizes == [15] * 4
    rows = staged.collect()
    for e in range(6):
        own = {r.idx: r.stage for r in rows if r.epoch == e}
        assert sorted(own.values()) == sorted([1, 2, 3, 4] * 15) and len(own) == 60
        ordered = [s for _, s in sorted((scores[i], s) for i, s in own.items())]
        assert ordered == sorted(ordered)
    per = {i: {r.stage for r in rows if r.idx == i} for i in range(60)}
    assert all(len(per[i]) == 1 for i in range(60) if scores[i] != 7.0) and any(len(per[i]) > 1 for i in range(60) if scores[i] == 7.0)


def test_numpy_order_is_bounded(spark):
    df = spark.createDataFrame([(i, f"r{i}", "3_5", 3, 10) for i in range(20)], "idx bigint, id string, age_band string, n_words bigint, n_tokens bigint")
    assert curriculum.numpy_order(df, "random", None, 2, 0).count() == 40
    with pytest.raises(ValueError, match="use build_order"):
        curriculum.numpy_order(df, "random", None, 2, 0, most=39)


def test_ranks_in_buckets(spark, monkeypatch):
    from quillstack.operators import ranking

    monkeypatch.setattr(ranking, "ROWS", 50)
    values = [(i, float((i * 37) % 90 if i % 3 else 5), f"{(i * 7919) % 256:02x}{i:04x}") for i in range(600)]
    df = spark.createDataFrame(values, "id bigint, score double, tie string")
    n, cuts = quantile_cuts(df, ["score"])
    assert n == 600 and len(cuts["score"]) > 5
    assert [r.k for r in df.orderBy("id").select(cuts_upto(F.col("score"), cuts["score"]).alias("k")).collect()] == [sum(c <= v[1] for c in cuts["score"]) for v in values]
    want = {i: k for k, (_, _, i) in enumerate(sorted((s, t, i) for i, s, t in values))}
    assert {r.id: r["rank"] for r in score_rank(df, "score", "tie", "id").collect()} == want
    assert {r.id: r.at for r in ordered_rank(df, [-F.col("score"), F.col("id")], "at").collect()} == {i: k for k, (_, i) in enumerate(sorted((-s, i) for i, s, _ in values))}


def test_cleaning_job(spark):
    rows = [
        ("Tales", "1", 0, "Cleaned:\nThis text does not contain any OCR errors that require cleaning.===", "stop"),
        ("Tales", "1", 1, "Cleaned:\n     more 12.===x", "length"),
        ("Tales", "2", 2, "The provided OCR text is empty.", "stop"),
        ("Tales", "3", 3, "Cleaned:\nThis text does not contain any OCR errors that require cleaning.===", "stop"),
        ("Tales", "3", 4, "\n12. x===", "stop"),
        ("Tales", "4", 5, None, None),
    ]
    df = spark.createDataFrame(rows, "book_name string, page_number string, chunk_idx int, generated_text string, finish_reason string")
    originals = spark.createDataFrame([("Tales", "1", 0, "old"), ("Tales", "1", 1, "Tale's: the original 3")], "book_name string, page_number string, ordinal int, text string")
    out = {r.page_number: r.text for r in cleaning.clean_library(df, originals).collect()}
    assert out == {"1": "the original more", "3": "x", "4": ""}
    assert cleaning.extracted(df, originals).where("unfinished").count() == 2


def test_original_of_repeated_pages(spark):
    chunks = spark.createDataFrame([("b", "1", 0, "none")], "book_name string, page_number string, chunk_idx int, text string")
    originals = spark.createDataFrame([("b", "1", "x"), ("b", "1", "y")], "book_name string, page_number string, text string")
    assert [r.text for r in joins.with_original(chunks, originals, "none").collect()] == ["y"]


def test_own_columns_survive(spark):
    df = spark.createDataFrame([(i, f"r{i}", "3_5", 3, 10, "p", "q", "r") for i in range(60)], "idx bigint, id string, age_band string, n_words bigint, n_tokens bigint, perm string, place string, part string")
    assert set(df.columns) < set(curriculum.split_records(df).columns)
