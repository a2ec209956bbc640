"""Edges and covers of small made-up pages, and the gate over their metrics."""

import numpy as np
from pyspark.sql import functions as F

from quillstack.operators import images, pages


def decode(raw):
    return np.frombuffer(raw[2:], np.uint8).reshape(raw[0], raw[1])


def test_edges():
    page = np.zeros((20, 30), np.uint8)
    assert not images.edges(page).any()
    page[:, 15:] = 255
    found = images.edges(page)
    assert found.sum() == 20 and set(np.flatnonzero(found.any(axis=0))) <= {14, 15}  # one column of edge
    assert images.edges(page.T).sum() == 20
    page[:, 15:] = 20  # gradients of 80 are below both limits
    assert not images.edges(page).any()
    page[:, 15:] = 40  # 160: an edge only where it hangs together with a strong one
    assert not images.edges(page).any()
    page[:3, 15:] = 255
    assert images.edges(page)[10:].sum() == 10
    slope = (np.add.outer(np.arange(40), np.arange(40)) > 40).astype(np.uint8) * 255
    assert 35 <= images.edges(slope).sum() <= 85


def test_gray_and_covers():
    colour = np.zeros((4, 4, 3), np.uint8)
    colour[..., 1] = 255
    assert (images.gray(colour) == 150).all()
    page = np.full((40, 40), 200, np.uint8)
    page[18:22, 5:20] = 0
    box = [[5.0, 18.0], [20.0, 18.0], [20.0, 22.0], [5.0, 22.0]]
    assert (images.covered(page, [box]) == 200).all() and (page[18:22, 5:20] == 0).all()
    beyond = [[30.0, 0.0], [60.0, 0.0], [60.0, 5.0], [30.0, 5.0]]
    assert images.covered(page, [beyond])[0, 35] == int(page.mean())


def test_page_metrics(spark):
    text = np.full((60, 60), 255, np.uint8)
    text[20:30:2, 10:40] = 0  # lines of text and nothing else
    drawing = np.kron(np.indices((15, 15)).sum(axis=0) % 2, np.ones((4, 4), int)).astype(np.uint8) * 255
    raw = lambda a: bytes(a.shape) + a.tobytes()
    rows = [("b", "text", raw(text)), ("b", "drawing", raw(drawing)), ("b", "blank", raw(np.full((60, 60), 9, np.uint8))), ("b", "broken", b"\x05\x05x")]
    df = spark.createDataFrame(rows, "book_name string, page_number string, content binary")
    box = [[10.0, 20.0], [40.0, 20.0], [40.0, 30.0], [10.0, 30.0]]
    boxes = spark.createDataFrame([("b", "text", box)], "book_name string, page_number string, bounding_box array<array<double>>")
    metrics = images.page_metrics(df, boxes, decode)
    got = {r.page_number: r for r in metrics.collect()}
    assert got["text"].edge_pixels > 50 and got["text"].masked_edge_pixels == 0 and got["blank"].edge_pixels == 0
    assert got["drawing"].edge_pixels == got["drawing"].masked_edge_pixels > 400 and got["broken"].error.startswith("ValueError") and got["broken"].pixels is None
    gated = pages.gate(pages.text_share(metrics.where("error is null").withColumn("x", F.lit(1)), boxes))
    assert {r.page_number for r in gated.where("retained").collect()} == {"drawing"}
