"""Suffix dedup against a plain version that remembers every string of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest
from tests.conftest import SF

from quillstack.llm import cover, suffix_dedup
from quillstack.llm.common import table

SCHEMA = "doc_id long, text string, row string, block string, body string, spans string, size string, start string"


def awkward():
    draw = random.Random(4)
    prose = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    base, passage = prose(3000), prose(260)
    texts = [None, "", "x", base, base, base[:1500] + "!" + base[1500:], prose(700) + passage + prose(99), passage, prose(50) + passage, passage[:100], passage[:99]]
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 5000, "ab" * 400, "é" * 200, prose(40) + "é" * 120, "日本語" * 90, base[::-1] + base]
    texts += [prose(150) + passage[i : i + 120] + prose(30) for i in range(0, 140, 7)]
    rows = [(i, t) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    return [r + ("x",) * 6 for r in [*rows, (None, base), (None, None), (3, base), (3, passage)]]


def plain(rows):
    """Rows in order of id (null first), as given within one id."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        body = (rows[i][1] or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - 99):
            w = body[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        out.append((rows[i][0], len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module", params=["awkward", "tables", "empty"])
def docs(request, spark):
    table(spark, SF, "documents")
    if request.param == "tables":
        return table(spark, SF, "documents")
    df = spark.createDataFrame(awkward(), SCHEMA).coalesce(1)
    return df if request.param == "awkward" else df.where("false")


def check(docs, **settings):
    got = suffix_dedup.report(docs, **settings)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_suffix_dedup(docs):
    check(docs)


def test_small_slices_blocks_and_parts(docs):
    """Documents of several slices, blocks of a few slices, small parts: what is cut apart is judged as one."""
    check(docs, slice_bytes=500, block_bytes=1500, part=2000)


def test_spans_and_kept_bytes(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in suffix_dedup.without_repeats(df).collect():
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and all(s.end - s.start >= 100 for s in r.spans)
        assert len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans)


def test_difference_cover():
    assert {(a - b) % cover.PERIOD for a in cover.COVER for b in cover.COVER} == set(range(cover.PERIOD))
    assert cover.HEAD + cover.PERIOD == cover.LENGTH + 1


def test_classes_of_equal_pairs():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 5, 400).astype(np.uint64) + (rng.integers(0, 3, 400).astype(np.uint64) << np.uint64(60))
    second = rng.integers(0, 3, 400).astype(np.uint32)
    order, new = cover.classes(first, second)
    found = {}
    for i, n in zip(order.tolist(), new.tolist(), strict=True):
        pair = (int(first[i]), int(second[i]))
        assert n == (pair not in found)
        assert n or found[pair] < i
        found[pair] = i
    assert sorted(order.tolist()) == list(range(400))


def test_fingerprints_follow_their_bytes():
    rng = np.random.default_rng(2)
    body = np.frombuffer(rng.bytes(300) * 3, np.uint8)
    a = cover.Prints(body, 1).of(np.arange(600), 100)
    assert (a[:300] == a[300:]).all() and len(np.unique(a[:300])) == 300
