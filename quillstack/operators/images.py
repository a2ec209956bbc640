"""Metrics of page images: edges before and after the text is covered. One image at a time in a worker, by NumPy.

Pictures are decoded by a function that the caller gives (bytes -> array of height x width, or x 3 colours, of 0 to 255):
no decoder is part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradient sums below the first are no edge, above the second always one, between them if they touch one.
LOW, HIGH = 100, 200
#: Rows above and below a text box that are covered too.
PAD = 12


def gray(image: np.ndarray) -> np.ndarray:
    """One channel of 0 to 255, by the usual weights of red, green and blue."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    r, g, b = (image[..., i].astype(np.int64) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + (1 << 15)) >> 16).astype(np.uint8)


def _near(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """x at the neighbour (dy, dx) of each place, 0 outside."""
    padded = np.pad(x, 1)
    return padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx]


def edges(image: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Canny edges of a gray image: 3 x 3 gradients, their ridges, and what hangs together with a strong one."""
    a = np.pad(image.astype(np.int64), 1, mode="edge")
    rows, cols = a[:-2] + 2 * a[1:-1] + a[2:], a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    dx, dy = rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]
    size = np.abs(dx) + np.abs(dy)
    flat = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx)  # the gradient runs along the row
    steep = np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    same = (dx < 0) == (dy < 0)
    ridge = np.where(flat, (size > _near(size, 0, -1)) & (size >= _near(size, 0, 1)), False)
    ridge |= np.where(steep, (size > _near(size, -1, 0)) & (size >= _near(size, 1, 0)), False)
    slanted = np.where(same, (size > _near(size, -1, -1)) & (size > _near(size, 1, 1)), (size > _near(size, -1, 1)) & (size > _near(size, 1, -1)))
    ridge |= ~flat & ~steep & slanted
    weak, found = ridge & (size > low), ridge & (size > high)
    grown = found
    while grown.any():
        around = np.zeros_like(found)
        for y in (-1, 0, 1):
            for x in (-1, 0, 1):
                around |= _near(grown, y, x)
        grown = around & weak & ~found
        found = found | grown
    return found


def covered(image: np.ndarray, boxes: list, pad: int = PAD) -> np.ndarray:
    """The image with each box, and ``pad`` rows above and below, in the mean colour of the column at the box's right edge.

    A box is four corners (x, y). Where that column lies outside of the image, the page's mean stands in.
    """
    out, h, w = image.copy(), *image.shape[:2]
    for box in boxes:
        (x0, y0), (x2, y2) = box[0], box[2]
        column = image[max(0, int(y0)) : max(0, int(y2)), max(0, int(x2)) : max(0, int(x2) + 1)]
        if column.size:
            mean = column.mean(axis=(0, 1))
            colour = np.rint(mean).astype(int) if image.ndim == 3 else int(mean)
        else:
            colour = image.mean(axis=(0, 1)).astype(int)
        top, bottom = int(min(y0, y2) - pad), int(max(y0, y2) + pad)
        left, right = int(min(x0, x2)), int(max(x0, x2))
        out[max(0, top) : max(0, min(h, bottom + 1)), max(0, left) : max(0, min(w, right + 1))] = colour
    return out


def page_metrics(images: DataFrame, boxes: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """images (book_name, page_number, content), boxes (book_name, page_number, bounding_box) -> height, width, pixels,
    edge_pixels and masked_edge_pixels of every page; ``error`` says why a page could not be read, and it has no numbers."""
    keys = ["book_name", "page_number"]
    own = boxes.groupBy(*keys).agg(F.collect_list("bounding_box").alias("boxes"))
    names = [*keys, "height", "width", "pixels", "edge_pixels", "masked_edge_pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                try:
                    image = decode(batch.column(2)[at].as_py())
                    seen = edges(gray(image)).sum()
                    masked = edges(gray(covered(image, batch.column(3)[at].as_py() or []))).sum()
                    rows.append((*image.shape[:2], image.shape[0] * image.shape[1], int(seen), int(masked), None))
                except Exception as e:  # told in its row
                    rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    rows = images.select(*keys, "content").join(own, keys, "left").select(*(F.col(k).cast("string") for k in keys), "content", "boxes")
    return rows.mapInArrow(run, "book_name string, page_number string, height long, width long, pixels long, edge_pixels long, masked_edge_pixels long, error string")
