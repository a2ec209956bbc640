"""Sequence packing against its invariants and a plain best fit; chunking of long books against a plain fold."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quillstack.operators import chunking, packing


def plain_best_fit(samples, tokens, images):
    packs, out = [], [0] * len(samples)
    for i in sorted(range(len(samples)), key=lambda i: (-(samples[i][0] / tokens + samples[i][1] / images), -samples[i][0], i)):
        need, shown = samples[i]
        fits = [(t, m, k) for k, (t, m) in enumerate(packs) if t >= need and m >= shown and t > 0]
        if fits:
            room, left = min(f[:2] for f in fits)
            k = next(k for t, m, k in fits if (t, m) == (room, left))
        else:
            k, (room, left) = len(packs), (tokens, images)
            packs.append(None)
        packs[k] = (room - need, left - shown)
        out[i] = k
    return out, [tokens - t for t, _ in packs]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_by_definition(seed):
    draw = random.Random(seed)
    samples = [(draw.choice((0, 1, 5, 30, 31, 64, 99, 100)), draw.randrange(3)) for _ in range(300)]
    packs, fill = packing.best_fit(samples, 100, 4)
    held = defaultdict(list)
    for s, p in zip(samples, packs, strict=True):
        held[p].append(s)
    assert all(sum(t for t, _ in v) == fill[p] <= 100 and sum(m for _, m in v) <= 4 for p, v in held.items())
    # the same room for every sample as a search of all open packs finds, so the same number of packs and fills
    assert sorted(fill) == sorted(plain_best_fit(samples, 100, 4)[1])


def test_neither_limit_leaves_packs_half_filled():
    """Lengths as texts have them, up to three images each: hardly more packs than the tokens alone ask for."""
    draw = random.Random(9)
    samples = [(min(4096, int(draw.lognormvariate(5.8, 0.9))), draw.randrange(4)) for _ in range(3000)]
    _, fill = packing.best_fit(samples, 4096, 18)
    least = max(sum(t for t, _ in samples) / 4096, sum(m for _, m in samples) / 18)
    assert len(fill) <= 1.02 * least + 1, (len(fill), least)


def plain_rows(n, seed=1):
    draw = random.Random(seed)
    rows = [(i, f"s{i}", draw.choice((40, 90, 300, 700, 1500, 2900, 4096)), draw.randrange(5)) for i in range(n)]
    return rows + [(n, "long", 4097, 0), (n + 1, "many", 5, 9), (n + 2, "none", None, 1), (n + 3, None, 10, 1), (5, "s5", 40, 1), (None, "lost", 40, 1), (n + 4, "empty", 0, 0)]


def test_pack_keeps_limits_and_every_sample(spark):
    rows = plain_rows(3000)
    df = spark.createDataFrame(rows, "position long, id string, n_tokens long, n_images long").repartition(5)
    packed = packing.pack(df, rows=200)
    got = packed.collect()
    assert len(got) == len(rows)
    assert {r.id: r.status for r in got if r.status != "packed"} == {"long": "too_long", "many": "too_many_images", "none": "no_length"}
    assert all((r.pack is not None) == (r.status == "packed") for r in got)
    told = packing.report(packed).first()
    assert told.n_over == 0 and told.fill > 0.9 and told.n_packed == len(rows) - 3
    one_run = packing.report(packing.pack(df, rows=10_000)).first()
    # runs of 200 samples, whose leftovers meet, need hardly more packs than one run of all
    assert told.n_packs <= one_run.n_packs + 3
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == len(rows) - 3


def test_packs_hold_neighbours(spark):
    """Full packs come from one run of the order."""
    df = spark.createDataFrame([(i, str(i), 1024, 0) for i in range(4000)], "position long, id string, n_tokens long, n_images long")
    for r in packing.sequences(packing.pack(df, rows=400)).collect():
        assert max(map(int, r.ids)) - min(map(int, r.ids)) < 400 and r.n_tokens == 4096


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([], "position long, id string, n_tokens long, n_images long")
    assert packing.pack(df).count() == 0
    assert packing.report(packing.pack(df)).first().asDict() == {"n_samples": 0, "n_packed": 0, "n_too_long": 0, "n_too_many_images": 0, "n_no_length": 0, "n_packs": 0, "n_tokens": 0, "n_over": 0, "fill": 0.0}


def plain_chunks(tokens, limit):
    out, s, k = [], 0, 0
    for n in tokens:
        out.append(k)
        s += n
        if s > limit:
            s, k = 0, k + 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_compose_to_the_fold(seed):
    """Whatever the runs, carrying sums from one to the next cuts where one fold over the book cuts."""
    draw = random.Random(seed)
    limit = draw.choice((0, 1, 7, 50))
    tokens = [draw.choice((0, 0, 1, 2, 3, 9, 60)) for _ in range(400)]
    at, carried, closed, got = 0, 0, 0, []
    while at < len(tokens):
        own = np.array(tokens[at : at + draw.choice((1, 3, 20, 90))], np.int64)
        run = chunking.carry_of(own, limit)
        for c in range(limit + 1):  # the function itself, at every sum that can be carried in
            s, cuts = c, 0
            for n in own.tolist():
                s += n
                if s > limit:
                    s, cuts = 0, cuts + 1
            assert run(c) == (s, cuts)
        ends = chunking.cuts_after(np.cumsum(own), 0, -carried, limit)
        k = closed
        for i in range(len(own)):
            got.append(k)
            k += i in ends
        carried, more = run(carried)
        closed += more
        at += len(own)
    assert got == plain_chunks(tokens, limit)


def test_a_long_book_over_many_tasks(spark):
    """One book with nearly all pages: its runs stand in many partitions, and no task has more than its run."""
    n, limit = 60_000, 500
    df = spark.range(n, numPartitions=7).selectExpr("if(id % 5000 = 4999, 'small', 'book') as book", "id as page_idx", "pmod(xxhash64(id), 90) as n_tokens")
    got = chunking.page_numbers(df, limit, run=2000)
    runs = df.repartitionByRange(30, "book", "page_idx").selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(runs) > 20 and max(r["count"] for r in runs) < n / 10
    found = {"book": [], "small": []}
    for r in got.join(df, ["book", "page_idx"]).orderBy("page_idx").collect():
        found[r.book].append((r.chunk, r.n_tokens))
    for rows in found.values():
        assert [c for c, _ in rows] == plain_chunks([t for _, t in rows], limit)


def test_chunk_labels_and_empty_tail(spark):
    pages = [("b", 0, "p0", "x", 3), ("b", 1, "p1", "y", 4), ("b", 2, "p2", "z", None), ("b", 3, "p3", "w", 0), ("c", 0, "q0", "v", 2), (None, 0, "r", "u", 2)]
    df = spark.createDataFrame(pages, "book string, page_idx long, page_number string, text string, n_tokens long")
    got = sorted(map(tuple, chunking.page_chunks(df, 5).collect()))
    assert got == [("b", 0, "p0", "p1", 2, "xy"), ("c", 0, "q0", "q0", 1, "v")]


def test_tree_digest(spark):
    """The same for any partitions, another for another order, text or block size."""
    import hashlib

    from quillstack.operators import artifacts

    rows = [(i, f"t{i % 7}" if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, t string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    blocks = [sha("\n".join(t or "" for _, t in rows[i : i + 30])) for i in range(0, 100, 30)]
    want = (100, 4, sha("\n".join(blocks)))
    assert tuple(artifacts.tree_digest(df, "k", "t", 30).first()) == want == tuple(artifacts.tree_digest(df.repartition(7, "t"), "k", "t", 30).first())
    assert artifacts.tree_digest(df.selectExpr("-k as k", "t"), "k", "t", 30).first().digest != want[2]
    assert tuple(artifacts.tree_digest(df.where("false"), "k", "t").first())[:2] == (0, 0)
