"""Page gate on metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_SHARE, EDGE_SHARE, MASKED_EDGE_SHARE = 0.3, 0.2, 0.3


def box_area(box: Column) -> Column:
    """From the corners 0, 1 and 2 of a quad; negative for turned ones."""
    corner = lambda i, j: F.element_at(F.element_at(box, i + 1), j + 1)
    return (corner(1, 0) - corner(0, 0)) * (corner(2, 1) - corner(1, 1))


def text_share(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """pages (book_name, page_number, height, width) with ``text_area``: overlaps count twice, 0 without boxes."""
    areas = boxes.groupBy("book_name", "page_number").agg(F.sum(box_area(F.col("bounding_box"))).alias("area"))
    return pages.join(areas, ["book_name", "page_number"], "left").withColumn("text_area",
        F.coalesce("area", F.lit(0.0)) / (F.col("height") * F.col("width"))).drop("area")


def edge_score(edges: Column, pixels: Column) -> Column:
    """Population deviation of a 0/1 edge image: sqrt(p (1 - p))."""
    p = edges / pixels
    return F.sqrt(p * (1 - p))


def gate(df: DataFrame) -> DataFrame:
    """df with text_area, edge_pixels, masked_edge_pixels, pixels -> with ``retained``."""
    seen = edge_score(F.col("edge_pixels"), F.col("pixels")) >= EDGE_SHARE
    masked = edge_score(F.col("masked_edge_pixels"), F.col("pixels")) >= MASKED_EDGE_SHARE
    return df.withColumn("retained", (F.col("text_area") < TEXT_SHARE) & seen & masked)
