"""Edge cases of operators on literal rows: limits met exactly, ties, missing and repeated rows."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.operators import chunking, convert, curriculum, joins, labels, pages, results, scores


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_every_unusable_phrase(spark):
    assert column(spark, [f"x {p} y" for p in T.UNUSABLE] + ["a page"], "string", T.usable) == [False] * len(T.UNUSABLE) + [True]


def test_short_text_stays_raw(spark):
    raw = "a  b\nc"
    df = spark.createDataFrame([(raw,), ("a  b c d",)], "t string").select(T.text_chunks(F.col("t"), F.split("t", r"\s+"), 3).alias("c"))
    assert [[(p.n_tokens, p.text) for p in r.c] for r in df.collect()] == [[(3, raw)], [(3, "a b c"), (1, "d")]]


def test_chunks_at_the_limit(spark):
    # a sum that equals the limit doesn't cut, one more does; a rest without tokens is no chunk; a page beyond the limit is one
    rows = [("a", i, f"p{i}", n) for i, n in enumerate([3, 2, 1, 5, 1, 0, 0])] + [("b", 0, "p0", 99), ("c", 0, "p0", 0), ("d", 2, "p2", 1), ("d", 7, "p7", 2)]
    df = spark.createDataFrame(rows, "book string, page_idx int, page_number string, n_tokens int").withColumn("text", F.concat("page_number", F.lit(";")))
    out = [tuple(r) for r in chunking.page_chunks(df, 5).orderBy("book", "chunk").collect()]
    assert out == [
        ("a", 0, "p0", "p2", 3, "p0;p1;p2;"), ("a", 1, "p2", "p4", 2, "p3;p4;"), ("b", 0, "p0", "p0", 1, "p0;"), ("d", 0, "p2", "p7", 2, "p2;p7;"),
    ]


def test_text_share_and_gate(spark):
    box = lambda w, h: [[0.0, 0.0], [w, 0.0], [w, h], [0.0, h]]
    page = spark.createDataFrame([("b", "none", 10.0, 10.0), ("b", "two", 10.0, 10.0), ("b", "limit", 10.0, 10.0)], "book_name string, page_number string, height double, width double")
    boxes = spark.createDataFrame([("b", "two", box(2.0, 5.0)), ("b", "two", box(2.0, 5.0)), ("b", "limit", box(10.0, 3.0))], "book_name string, page_number string, bounding_box array<array<double>>")
    shares = pages.text_share(page, boxes)
    assert {r.page_number: round(r.text_area, 6) for r in shares.collect()} == {"none": 0.0, "two": 0.2, "limit": 0.3}  # overlaps count twice
    metrics = shares.withColumns({"pixels": F.lit(100.0), "edge_pixels": F.lit(10.0), "masked_edge_pixels": F.lit(10.0)})
    assert {r.page_number: r.retained for r in pages.gate(metrics).collect()} == {"none": True, "two": True, "limit": False}
    assert not any(r.retained for r in pages.gate(metrics.withColumn("masked_edge_pixels", F.lit(9.9))).collect())
    assert not any(r.retained for r in pages.gate(metrics.withColumn("edge_pixels", F.lit(0.0))).collect())


def test_speaker_turns_and_mismatches(spark):
    rows = [(1, 0, "human"), (1, 1, "gpt"), (2, 0, "human"), (2, 1, "gpt"), (2, 2, "human"), (3, 0, "gpt")]
    df = spark.createDataFrame(rows, "c int, turn int, role string")
    assert {r.c: (r.n_questions, r.n_answers, r.more_answers) for r in convert.qa_mismatch(df, "c", "role", "human", "gpt").collect()} == {2: (2, 1, False), 3: (0, 1, True)}


def test_rank_agreement(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(-i), float(i % 2)) for i in range(10)], "id int, a double, b double, c double, d double")
    assert scores.spearman(df, "id", "a", "b").first().rho == pytest.approx(1.0)
    assert scores.spearman(df, "id", "a", "c").first().rho == pytest.approx(-1.0)
    same = scores.quartile_overlap(df, "id", "a", "b").first()
    assert (same.lowest, same.highest) == (1.0, 1.0)
    assert scores.quartile_overlap(df, "id", "a", "c").first().lowest == 0.0
    assert -1 < scores.spearman(df, "id", "a", "d").first().rho < 1
    with pytest.raises(ValueError):
        scores.quartile_overlap(df.limit(3), "id", "a", "b")


def test_scores_must_align(spark):
    base = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0)], "manifest_index int, image string, nll double")
    assert [r.nll_alt for r in joins.merge_scores(base, base, "alt").orderBy("manifest_index").collect()] == [1.0, 2.0]
    for other in (base.withColumn("image", F.lit("z")), base.limit(1), base.unionByName(base.withColumn("manifest_index", F.col("manifest_index") + 5))):
        with pytest.raises(Exception, match="do not align"):
            joins.merge_scores(base, other, "alt").collect()


def test_blocks_of_token_mass(spark):
    # masses 10, 0, 0 and 10: both inner blocks are empty, and a sample whose sum is a boundary belongs behind it
    rows = [(i, f"r{i}", "3_5" if i < 2 else "12", 3, 5 if i % 2 else 0) for i in range(4)]
    df = spark.createDataFrame(rows, "idx bigint, id string, age_band string, n_words bigint, n_tokens bigint")
    blocks, sizes = curriculum.random_blocks(df, 0)
    assert sum(sizes) == 4 and sizes[1:3] == [0, 0]
    order = curriculum.build_order(df, "randomblock", "staged", 3, 0)
    assert not curriculum.sequence_violations(order, 4, 3, True).count()
    assert column(spark, [None, 0, 7], "bigint", lambda c: T.tokens_or_estimate(c, F.lit(10).cast("bigint"))) == [13, 13, 7]


@pytest.mark.parametrize(("n", "sizes"), [(4, [3] * 4), (5, [3, 3, 3, 6])])
def test_stages_of_four_and_five_values(spark, n, sizes):
    values = [float(v) for v in range(n) for _ in range(3)]
    df = spark.createDataFrame([(i, f"r{i}", v) for i, v in enumerate(values)], "idx bigint, id string, score double")
    staged, got = curriculum.epoch_stages(df, 0, 2)
    assert got == (sizes if n == 4 else [4, 4, 4, 3])
    assert [r["count"] for r in staged.where("epoch = 1").groupBy("stage").count().orderBy("stage").collect()] == got


def test_audit_of_ties_and_unknown_labels(spark):
    answers = [("a", 0, "is 12+"), ("a", 1, "6-8 or 3-5"), ("b", 0, "9+"), ("c", 0, "?"), ("d", 0, "3-5")]
    df = spark.createDataFrame(answers, "book string, pos int, answer string").withColumn("label", T.audit_label(F.col("answer")))
    gold = spark.createDataFrame([("a", "12+"), ("b", "9-12"), ("c", "3-5")], "book string, gold string")
    pairs = labels.first_majority(df, "book", "label", "pos").join(gold, "book", "left")
    assert {r.book: r.pred for r in pairs.collect()} == {"a": "12+", "b": "9+", "c": "unparsed", "d": "3-5"}
    assert labels.agreement(pairs).first().n == 1 and {r.pred for r in labels.odd_predictions(pairs).collect()} == {"9+", "unparsed"}


def test_run_filters(spark):
    names = ["tl_random_staged_ep5_smallm_mm_seed0_x", "tl_perplexity_competence_ep10_biglm_textonly_seed2_y", "other"]
    runs = results.parse_runs(spark.createDataFrame([(n,) for n in names], "run string"))
    pick = lambda **k: [r.order for r in results.filter_runs(runs, **k).collect()]
    assert pick(epochs=10) == ["perplexity"] and pick(lm_init="smal") == ["random"] and pick(modality="textonly") == ["perplexity"]
    assert pick(name_regex="tl_r.*") == ["random"] and pick(name_regex="random") == [] and len(pick()) == 2
