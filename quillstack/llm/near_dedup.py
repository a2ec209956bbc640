"""MinHash near-dedup: ProbMinHash signatures, banding, verified probability Jaccard, connected components.

Nodes are distinct texts (by md5), so exact copies cost one row each. Within a bucket (a band's value) every member is
first compared with one leader, the member that meets most others over all its buckets (in a group of copies, the text
they stem from). From then on only pairs of different components matter, in buckets that hold several. There the members
outside the bucket's largest component are held against all of the bucket, in blocks of ``BLOCK`` members against as many:
a block pair is a task's unit, and no pair becomes a row. A pair is left to the first band that it shares, and to
verification only if its signatures agree in a share of registers that a similar pair falls short of once in a million
(``DEVIATIONS`` standard errors; the bands miss 6 in 100,000). Texts join only the members that have such a pair. Within a
block pair the likeliest pairs are verified first, from whole texts, and none that verified links already connect.

Words are runs of digits, letters and non-ASCII characters, lower-cased; shingles are five words, weighted by count.
Texts without words (null ones too) resemble nothing: each such row is a class of its own. A class is named by its least
doc_id; null doc_ids count only where there are no others. Equal rows are copies. No documents give no rows. A very long
text is one row of one task, its signature has the size of any other. Other columns, whatever their names, are never read;
``dedup`` carries them as one struct.

Exact copies meet under their text's hash only after they have been counted within each task, and a text is fetched from
one row of its copies, found by doc_id and hash: a group of copies is never one task's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import byte_texts, discard, pieces, stored
from quillstack.llm.components import components
from quillstack.llm.probminhash import REGISTERS, bands, probability_jaccard, shingles, signature

SIMILAR = 0.8
#: Members and bytes of text of a block, and the standard errors that decide what is verified.
BLOCK, BLOCK_BYTES, DEVIATIONS = 512, 8 << 20, 5


def text_node(text="text"):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, bands and low bytes of the registers (null without words), bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out, low, size = [], [], []
            for text in byte_texts(batch.column(2)):
                elements, weights = shingles(text)
                who = signature(elements, weights) if len(elements) else None
                out.append(bands(who) if who is not None else None)
                low.append(who.astype(np.uint8).tobytes() if who is not None else None)
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(low, pa.binary()),
                pa.array(size, pa.int64())], ["doc_id", "node", "bands", "low", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), text_node().alias("node"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, node binary, bands array<bigint>, low binary, n_bytes long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, similarity) from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in pieces(batches):
            out = []
            leaders = batch.column(1).to_pylist()
            for leader, a, b in zip(leaders, byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True):
                if leader != last:
                    last, kept = leader, shingles(b)
                out.append(probability_jaccard(shingles(a), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def leader_links(members: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between members of the buckets (band, node; n members) and their buckets' leaders."""
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = stored(members.select("band", "node").join(weight, "node"), "weighed")
    # stored, so that the join with a large bucket's members reads two exchanges and can be split
    leaders = stored(weighed.groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("leader")), "leaders")
    asked = weighed.join(leaders, "band").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = stored(verified(asked, texts).where(F.col("similarity") >= similar).select("a", "b"), "leader-links")
    discard(weighed, leaders)
    return links


def block_pairs(tagged: DataFrame) -> DataFrame:
    """Buckets' members (no, band, node, label, n_bytes) -> a row for each block pair (band, lo, hi) that a member is in.

    Blocks below ``p`` hold what is outside the bucket's largest component and meet all blocks; the others meet only those.
    """
    groups = tagged.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n_bytes").alias("bytes"))
    total = groups.groupBy("band").agg(F.max(F.struct("k", "label", "bytes")).alias("main"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    open_ = total.where(F.col("k") > F.col("main.k")).select("band", F.col("main.label").alias("most"),
        blocks(F.col("k") - F.col("main.k"), F.col("bytes") - F.col("main.bytes")).alias("p"),
            blocks(F.col("main.k"), F.col("main.bytes")).alias("q"))
    outer, own = F.col("label") != F.col("most"), F.xxhash64("node")
    placed = tagged.join(open_, "band").withColumn("block",
        F.when(outer, F.pmod(own, F.col("p"))).otherwise(F.col("p") + F.pmod(own, F.col("q"))).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outer, F.col("p") + F.col("q") - 1).otherwise(F.col("p") - 1))))
    return met.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "no", "node", "label", "block")


def likely(rows: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block pair: the rows of likely pairs, likeliest first, their shares of equal registers, and labels as numbers."""
    known: dict[bytes, int] = {}
    label = np.array([known.setdefault(x, len(known)) for x in rows["label"].to_pylist()])
    no, block = rows["no"][0].as_py(), rows["block"].to_numpy()
    low = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint8).reshape(len(label), REGISTERS)
    band = np.array(rows["bands"].to_pylist(), np.int64)
    first, second = np.flatnonzero(block == rows["lo"][0].as_py()), np.flatnonzero(block == rows["hi"][0].as_py())
    least = similar - DEVIATIONS * (similar * (1 - similar) / REGISTERS) ** 0.5
    a, b, share = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in first:
        others = second[label[second] != label[i]]
        if rows["lo"][0] == rows["hi"][0]:
            others = others[others > i]
        equal = (low[others] == low[i]).mean(1)
        others, equal = others[equal >= least], equal[equal >= least]
        here = (band[others] == band[i]).argmax(1) == no
        a.append(np.full(here.sum(), i))
        b.append(others[here])
        share.append(equal[here])
    a, b, share = np.concatenate(a), np.concatenate(b), np.concatenate(share)
    order = np.argsort(-share, kind="stable")
    return a[order], b[order], share[order], label


def block_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that connect what similar pairs of the buckets (no, band, node) connect beyond ``links``."""
    keys = ["band", "lo", "hi"]

    def pick(rows: pa.Table) -> pa.Table:
        a, b, _, _ = likely(rows, similar)
        return rows.take(np.unique(np.concatenate([a, b])))

    def link(rows: pa.Table) -> pa.Table:
        a, b, _, label = likely(rows, similar)
        node, text, seen = rows["node"].to_pylist(), byte_texts(rows["text"].combine_chunks()), {}
        up = list(range(int(label.max()) + 1))
        found: list[tuple[bytes, bytes]] = []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in seen:
                seen[i] = shingles(text[i])
            return seen[i]

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y and probability_jaccard(of(i), of(j)) >= similar:
                up[x] = y
                found.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    sized = members.join(nodes.select("node", "n_bytes"), "node")
    tagged = sized.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    tagged = stored(tagged, "tagged")
    sketched = block_pairs(tagged).join(nodes.select("node", "bands", "low"), "node").select(*keys, "no", "node", "label", "block", "bands", "low")
    picked = stored(sketched.groupBy(*keys).applyInArrow(pick, sketched.schema), "picked")
    found = stored(picked.join(texts, "node").groupBy(*keys).applyInArrow(link, "a binary, b binary"), "block-links")
    discard(tagged, picked)
    return found


def own_id(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, node, class (a node, or null for rows without words) of every document, as a stored table."""
    rows = stored(sketches(docs), "sketches")
    every = rows.where("bands is not null").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("n_bytes").alias("n_bytes"), F.min(own_id(F.col("doc_id"))).alias("rep")
    )
    every = stored(every, "every-node")
    exploded = every.select("node", F.posexplode("bands").alias("no", "value")).select("no", F.xxhash64("no", "value").alias("band"), "node")
    sizes = stored(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    members = stored(exploded.join(sizes, "band").select("no", "band", "node", "n"), "members")
    nodes = stored(every.join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    keyed = docs.select(text_node().alias("node"), own_id(F.col("doc_id")).alias("rep"), F.col("text").cast("string").alias("text"))
    texts = keyed.join(nodes.select("node", "rep"), ["node", "rep"], "left_semi").dropDuplicates(["node", "rep"]).select("node", "text")
    texts = stored(texts, "texts")
    links = leader_links(members, texts, similar)
    more = block_links(members, nodes, texts, links, similar)
    labels = components(links.unionByName(more))
    named = rows.join(labels, "node", "left").select("doc_id", "node", F.when(F.col("bands").isNotNull(), F.coalesce("label", "node")).alias("class"))
    found = stored(named, "classes")
    discard(rows, every, sizes, members, nodes, texts, links, more)
    return found


def report(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, of every document, and the class's size."""
    found = classes(docs, similar)
    names = stored(found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "class-names")
    return found.join(names, "class", "left").select("doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("class_size"))


def dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, that with the least doc_id, and all documents without words."""
    found = classes(docs, similar).where("class is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("node"))
    stay = found.groupBy("class").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("stay_id"), F.col("r.node").alias("stay_node"))
    rows = docs.select(F.struct("*").alias("row"), text_node().alias("node"))
    kept = rows.join(stay, (F.col("node") == F.col("stay_node")) & F.col("row.doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    if found.groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        kept = kept.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "node"])
    wordless = rows.where(~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    return kept.select("row.*").unionByName(wordless.select("row.*"))
