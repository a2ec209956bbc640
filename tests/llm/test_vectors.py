"""The vector operators against plain versions, over the tables and over awkward rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import SF

from quillstack.llm import hard_negatives, kd_clusters
from quillstack.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block string, whole string, code string, cluster string, pair string"


def awkward(length=64):
    draw = random.Random(3)
    vector = lambda n=length: [draw.gauss(0, 0.13) for _ in range(n)]
    rows = [(i, vector(), i % 4) for i in range(330)]
    rows += [(400, rows[100][1], 0), (500, rows[100][1], 1), (100, rows[100][1], 0), (100, rows[100][1], 0)]  # ties, repeated rows
    rows += [(600, None, 1), (601, vector()[:-1] + [None], 1), (602, vector()[:-1] + [math.nan], 1), (603, [math.inf] + vector()[1:], 1)]
    rows += [(None, vector(), 1), (604, vector(), None), (700, [0.0] * length, 2), (701, [1e30, -1e30] + vector()[2:], 3), (None, None, None)]
    rows += [(i, rows[7][1], 3) for i in range(800, 830)]
    return [r + ("x",) * 6 for r in rows]


@pytest.fixture(scope="module", params=["awkward", "tables", "empty"])
def vectors(request, spark):
    table(spark, SF, "embeddings")
    if request.param == "tables":
        return table(spark, SF, "embeddings")
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()
    return df if request.param == "awkward" else df.where("false")


def whole(vector):
    """The contract's numbers, None if the row takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(min(max(256 * x, -(2.0**27)), 2.0**27)) for x in vector]


def plain_negatives(rows, every=100, n_pos=5, n_neg=10, low=30, high=90):
    own = [(i, (lb + 1) % 10 if i % 7 == 0 else lb, q) for i, lb, v in rows if i is not None and lb is not None and (q := whole(v)) is not None]
    out = []
    for a, (i, label, q) in enumerate(own):
        if i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, o[2], strict=False)), o[0], o[1] == label) for b, o in enumerate(own) if b != a), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2]][:n_pos]:
            hard = [(-t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:n_neg]
            out += [(i, p, k, n, -s, t) for k, (t, n) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(vectors):
    rows = [tuple(r) for r in vectors.select("vec_id", "label", "embedding").collect()]
    got = hard_negatives.mine(vectors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_in_small_blocks(spark):
    """Several anchor blocks, a sample that is smaller than the codebook, vectors of different and odd lengths."""
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(draw.choice((0, 3, 7, 8)))], i % 3) for i in range(120)]
    df = spark.createDataFrame([(i, v, lb) for i, v, lb in rows], "vec_id long, embedding array<double>, label long").repartition(4)
    got = hard_negatives.mine(df, every=5, positives=3, negatives=4, low=10, high=80, block=6, sample=16)
    assert sorted(map(tuple, got.collect())) == plain_negatives([(i, lb, v) for i, v, lb in rows], 5, 3, 4, 10, 80)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.integers(-90, 90, (700, 64))
    books = hard_negatives.fit_codebooks(x[:300])
    codes, residual = hard_negatives.encode(x, books)
    batch = hard_negatives.pa.RecordBatch.from_pydict(
        {"vec_id": np.arange(700), "label": np.arange(700) % 3, "code": [c.tobytes() for c in codes], "residual": residual, "whole": hard_negatives.packed(x)}
    )
    part = hard_negatives.Coded(batch, len(books), 64)
    for i in range(0, 700, 50):
        low, high = part.bounds(x[i], hard_negatives.tables(x, books, i), slice(None))
        true = x @ x[i]
        assert (low <= true).all() and (true <= high).all()
        assert np.median(high - low) < 0.3 * true[i]  # the bounds tell something


def plain_clusters(rows, k=40, rounds=5, length=64):
    own = [(i, q) for i, v in rows if (q := whole(v)) is not None and len(q) == length]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [q for _, q in sorted(own, key=key)[:k]]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, z, strict=True)), n) for n, z in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, q in own:
            members[near(q)[1]].append(q)
        c = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if members[n] else z for n, z in enumerate(c)]
    found = [(i, *near(q)[::-1]) for i, q in own]
    inertia = defaultdict(int)
    for _, n, d in found:
        inertia[n] += d
    shas = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), shas[n]) for i, n, d in found), key=repr)


def test_clusters(vectors):
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    got = kd_clusters.report(vectors)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows)


def test_clusters_with_pruned_and_whole_nodes(spark):
    """Groups far apart in two components: most nodes go whole, ties between equal centroids go to the smaller number."""
    draw = random.Random(2)
    rows = [(i, [draw.gauss(3 * (i % 5), 0.05), draw.gauss(2 * (i % 3), 0.05)]) for i in range(900)]
    rows += [(i, [1.5, 1.0]) for i in range(900, 960)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = kd_clusters.report(df, k=9, rounds=4, length=2, block=128, leaf=8)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 9, 4, 2)
    x = np.array([whole(v) for _, v in rows], np.int64)
    order, nodes = kd_clusters.build_tree(x, 8)
    sums, low, high = kd_clusters.measured(x[order], nodes)
    centroids = np.array([[768 * i, 512 * j] for i in range(5) for j in range(3)], np.int64)
    whole_rows = sum(int((nodes[at, 1] - nodes[at, 0]).sum()) for at, _, one in kd_clusters.filtered(nodes, low, high, centroids) if one)
    assert whole_rows > 600
    assert sorted(order.tolist()) == list(range(len(x))) and (sums[0] == x.sum(0)).all()


def test_domination_is_strict():
    low, high = np.array([[0, 0]]), np.array([[4, 4]])
    centroids = np.array([[2, 2], [2, 2], [90, 90], [-2, 2]])
    assert kd_clusters.dominated(low, high, centroids, np.ones((1, 4), bool)).tolist() == [[True, True, False, True]]
