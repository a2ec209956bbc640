"""Connected components of a table of links, by least labels passed along links and shortcuts through labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label): label is the least node of the component.

    Each round is a stored table, and the one before is deleted. Null ends link nothing, repeated links count once; no
    links give no rows.
    """
    links = links.where("a is not null and b is not null")
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")),
        "labels")
    while True:
        heard = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = stored(nearer.join(up, "label", "left").select("node", F.coalesce(F.least("label", "up"), F.col("label")).alias("label"), "old"),
            "labels")
        changed = jumped.where(F.col("label") < F.col("old")).limit(1).count()
        discard(labels)
        labels = jumped
        if not changed:
            discard(edges)
            return labels.select("node", "label")
