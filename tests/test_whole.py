"""Queries that take every row: what they count adds up to the tables."""

from quillstack.operators import results
from quillstack.plans import tables as D
from quillstack.plans.queries import QUERIES
from tests.conftest import SF


def test_duplicate_runs(spark):
    each = D.runs(spark, SF).groupBy("run", "task").count().collect()
    found = QUERIES["duplicate_runs"](spark, SF).collect()
    assert sum(r.n for r in found) == sum(r["count"] for r in each if r["count"] > 1)
    assert sum(r.n for r in found) + sum(r["count"] == 1 for r in each) == D.table(spark, SF, "events").count()


def test_duplicate_pairs(spark):
    data = [("a", "x", p) for p in ("p3", "p1", "p2")] + [("b", "x", "q"), (None, "x", "r"), (None, "x", "r")]
    df = spark.createDataFrame(data, "run string, task string, path string")
    out = results.duplicate_pairs(df, ["run", "task"]).collect()
    assert sorted(map(tuple, out), key=repr) == [("a", "x", 3, "p1", "p2"), (None, "x", 2, "r", "r")]


def test_second_votes_of_every_row(spark):
    v = D.second_votes(spark, SF).join(D.votes(spark, SF).withColumnRenamed("answer", "first"), ["book", "pos"])
    n = D.table(spark, SF, "documents").count()
    assert v.count() == n and 0 < v.where("answer <> first").count() < n


def test_audit_odd_positions(spark, tmp_path):
    # a book with odd positions alone is audited
    spark.createDataFrame([(1, "x" * 18, "b"), (3, "x" * 18, "b")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    from quillstack.plans import queries

    assert [r.book for r in queries.audited(spark, str(tmp_path)).collect()] == ["b"]


def test_no_query_is_vacuous(spark):
    """Checks find what was broken, rules meet what they are for."""
    rules = {r.rule: r.n for r in QUERIES["validate_sequence"](spark, SF).collect()}
    assert rules.keys() == {"range", "length", "permutation"} and all(n > 0 for n in rules.values())
    for name in ("annotation_order", "split_check", "shard_overflow", "repeated_keys", "split_counts", "audit_odd"):
        assert QUERIES[name](spark, SF).count() > 0, name
    flags = QUERIES["quality_flags"](spark, SF).groupBy("marked").count().collect()
    assert {r.marked for r in flags} == {True, False}
    assert {r.n_images for r in QUERIES["text_only_view"](spark, SF).collect()} == {0, 1, 2}
    n = D.table(spark, SF, "documents").count()
    assert 0 < QUERIES["caption_convert"](spark, SF).count() < n
