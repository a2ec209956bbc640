"""Resume inside a shard, image embeddings reused, generator jump-ahead, plans and sinks that survive attempts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import curriculum, joins
from quillstack.sources import models, writers
from quillstack.streaming.resume import committed, process_in_pieces
from tests.test_operators import scored  # noqa: F401  a fixture

OUT = "book string, page long, caption string"


def test_killed_inside_a_shard(spark, tmp_path):
    """Runs that are killed again and again: no page twice, none lost, none done again."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    pages = [(f"b{i % 3}", i) for i in range(95)]
    for f in range(2):
        own = pages[f::2] + pages[:5]  # some pages stand in both files, some twice in one
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(json.dumps({"book": b, "page": p}) for b, p in own))
    calls, seen = [0], []

    def step(df):
        calls[0] += 1
        if calls[0] in (3, 4, 8):
            raise RuntimeError("killed")
        rows = df.collect()
        assert len(rows) <= 10
        seen.extend((r.book, r.page) for r in rows)
        return df.withColumn("caption", F.concat(F.lit("page "), F.col("page").cast("string")))

    def run():
        process_in_pieces(spark, source, "book string, page long", sink, OUT, check, step, ["book", "page"], rows=10, files=1)

    kills = 0
    while True:
        try:
            run()
            break
        except Exception as e:
            assert "killed" in str(e)
            kills += 1
            half = tmp_path / "out" / f"piece-99999999-{kills:08d}"  # what a kill in the middle of a write leaves
            half.mkdir(parents=True)
            (half / "part-0.parquet").write_bytes(b"half a file")
    assert kills == 3
    got = sorted((r.book, r.page) for r in committed(spark, sink, OUT).collect())
    assert got == sorted(pages) and sorted(seen) == sorted(pages)
    (tmp_path / "in" / "late.json").write_text(json.dumps({"book": "late", "page": 1}))
    run()
    assert committed(spark, sink, OUT).count() == len(pages) + 1
    run()
    assert committed(spark, sink, OUT).count() == len(pages) + 1


def test_one_encoding_an_image(spark):
    """A third of all candidates share an image: it is encoded once a part, all others once."""
    rows = [(f"i{i}", c, "x" * (i + c), "hot.jpg" if i < 100 else f"{i % 40}.jpg" if i < 290 else None) for i in range(300) for c in range(4)]
    df = spark.createDataFrame(rows, "item string, completion int, text string, image string").repartition(6)
    images = spark.createDataFrame([(f"{k}.jpg", bytes([k])) for k in range(60)] + [("hot.jpg", b"hot")], "image string, content binary")

    def make():
        def encode(content):
            assert isinstance(content, bytes)
            return len(content)

        return encode, lambda e, texts: [-float(len(t) % 5) + (e or 0) for t in texts]

    out = models.score_candidates(df, images, make, most=150)
    got = {(r.item, r.completion): r.loglik for r in out.collect()}
    assert got == {(i, c): -float(len(t) % 5) + (3 if m == "hot.jpg" else 1 if m else 0) for i, c, t, m in rows}
    calls = out.agg(F.sum("encoded")).first()[0]
    assert calls <= 40 + 3 and models.score_candidates(df.where("image <> 'hot.jpg'"), images, make).agg(F.sum("encoded")).first()[0] == 40
    best = {r.item: r.chosen for r in models.rank_completions(out).collect()}
    assert all(best[i] == max(range(4), key=lambda c: (got[i, c], -c)) for i, _, _, _ in rows)
    with pytest.raises(Exception, match="there is no image 7.jpg"):
        models.score_candidates(df, images.where("image <> '7.jpg'"), make).collect()
    assert models.score_candidates(df.where("false"), images, make).count() == 0


def test_draws_anywhere_in_the_sequence():
    every = np.random.default_rng(11).random(5000)
    at = np.random.default_rng(0).permutation(5000)[:700]
    at = np.concatenate([at, at[:20], np.arange(100, 400)])
    assert (curriculum.draws_at(11, at) == every[at]).all()
    assert len(curriculum.draws_at(11, [])) == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_competence_in_the_generators_sequence(spark, scored, parts):  # noqa: F811
    """The same draws as one generator on the driver, for any number of partitions."""
    tied = scored.withColumn("nll", F.floor(F.col("nll") * 4) / 4)
    want = [r.sample_index for r in curriculum.numpy_order(tied, "perplexity", "competence", 3, 5).orderBy("position").collect()]
    got = [r.sample_index for r in curriculum.competence_sequence(tied.repartition(parts), "perplexity", 3, 5).orderBy("position").collect()]
    assert got == want


def test_images_move_once(spark):
    """Names are matched without content; content comes by the chosen path."""
    files = spark.createDataFrame([(f"/a/b/{i}.jpg", b"x" * i) for i in range(5)] + [("/z/1.jpg", b"other")], "path string, content binary")
    own = spark.createDataFrame([("b/1.jpg", 0), ("1.jpg", 1), ("9.jpg", 2), ("1.jpg", 3)], "image string, k long")
    got = joins.with_images(own, files)
    assert {r.k: r.content and bytes(r.content) for r in got.collect()} == {0: b"x", 1: b"x", 2: None, 3: b"x"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[plan.index("Generate") :].split("Relation")[0].split("LogicalRDD")[0].split("\n")[0]
    assert sum("content" in line and "Aggregate" in line for line in plan.splitlines()) == 0


def test_two_attempts_write_apart(spark, tmp_path):
    assert writers._attempt("a") != writers._attempt("a")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.jpg").write_bytes(b"abc")
    df = spark.createDataFrame([(str(tmp_path / "src" / "1.jpg"), "one.jpg")] * 2, "path string, name string")
    assert writers.copy_images(df, str(tmp_path / "to")).count() == 2
    assert [p.name for p in (tmp_path / "to").iterdir() if not p.name.startswith(".")] == ["one.jpg"]
