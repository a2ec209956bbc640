"""Line dedup over levelled sorted runs of line hashes.

Every batch of documents gives its lines' keys: md5 of the line stripped at both ends and lower-cased (A-Z). The store is
a set of runs, tables sorted by key, each with the number of documents that hold a key and the largest doc_id.
Batches come in descending order of doc_id, so a key's first entry has its largest doc_id, and a key that has its
``copies`` documents is settled. A new batch is counted to one entry a key, within each task first, so a line of a third
of all documents is a row a task; the entries are merge-anti-joined with the runs' settled keys, and what remains is
added as a run of level 0; a level that has ``fanout`` runs is compacted to one run of the next level. A key's entry is
the sum of its entries in all runs: exact, as batches have no document in common.

A key found in ``copies`` documents or more keeps its lines in the document with the largest doc_id only. Keys of under
``least`` code points are never touched.

Null or empty texts are one empty line. Rows that share a doc_id count as one document and are treated alike; rows
without a doc_id count as one document below all others. No documents give no rows. Other columns, whatever their names,
travel as one struct. A document that loses many different lines looks them up by binary search, so a very long text costs
its lines times the logarithm of the keys it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import BLANKS, ascii_lower, remove_path, scratch_path, stored

LEAST, COPIES, BATCHES, FANOUT = 20, 3, 4, 3
#: Lost keys of a document up to which looking at each beats halving.
FEW = 64
#: Rows without a doc_id count as this one.
NO_ID = -(1 << 63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_hashes(text: Column, least: int = LEAST) -> Column:
    """array<binary>: per line its key's md5, null where the key is too short."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= least, F.unhex(F.md5(key.cast("binary"))))

    return F.transform(split_lines(text), one)


def own_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def batch_entries(lines: DataFrame) -> DataFrame:
    """A batch's run: key, n_docs, max_doc from (doc, key). Pairs are distinct before the keys meet."""
    return lines.groupBy("key", "doc").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("doc").alias("n_docs"), F.max("doc").alias("max_doc"))


def merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


class LineRuns:
    """The store. Runs are tables in the shared folder; ``levels`` lists each level's paths, oldest first."""

    SCHEMA = "key binary, n_docs long, max_doc long"

    def __init__(self, spark: SparkSession, copies: int = COPIES, fanout: int = FANOUT):
        self.spark, self.copies, self.fanout, self.levels = spark, copies, fanout, [[]]

    def run(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(path)

    def entries(self) -> DataFrame:
        """The entries of all runs, a key once a run at most."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def unsettled(self, entries: DataFrame) -> DataFrame:
        """The entries whose key no run has settled: one merge-anti-join a run."""
        for level in self.levels:
            for path in level:
                settled = self.run(path).where(F.col("n_docs") >= self.copies).select("key")
                entries = entries.join(settled.hint("merge"), "key", "left_anti")
        return entries

    def _write(self, entries: DataFrame, level: int) -> None:
        path = scratch_path(self.spark, f"line-run-{level}")
        entries.select(F.col("key"), F.col("n_docs").cast("long"), F.col("max_doc").cast("long")).sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> None:
        """Add the (doc, key) pairs of documents below those of all earlier batches; compact what is full."""
        self._write(self.unsettled(batch_entries(batch)), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(merged(self.spark.read.schema(self.SCHEMA).parquet(*old)), level + 1)
            for path in old:
                remove_path(self.spark, path)
            level += 1


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that part the documents into about even batches; any bounds give the same result."""
    found = docs.agg(F.percentile_approx(own_id(F.col("doc_id")), [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(found or []))


def repeated_lines(docs: DataFrame, least: int = LEAST, copies: int = COPIES, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, dropped): per document the keys that it loses."""
    bounds = batch_bounds(docs, batches)
    doc = own_id(F.col("doc_id"))
    no = sum((F.when(doc > b, 1).otherwise(0) for b in bounds), F.lit(0))
    keys = F.explode(F.array_compact(F.array_distinct(line_hashes(F.col("text"), least))))
    path = scratch_path(docs.sparkSession, "line-keys")
    docs.select(no.cast("int").alias("batch"), doc.alias("doc"), keys.alias("key")).write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema("doc long, key binary, batch int").parquet(path)
    runs = LineRuns(docs.sparkSession, copies, fanout)
    for b in range(len(bounds), -1, -1):
        runs.add(lines.where(F.col("batch") == b).select("doc", "key"))
    # stored: the join then reads two exchanges, and Spark can split the one in which a line of many documents is
    losers = stored(merged(runs.entries()).where(F.col("n_docs") >= copies).select("key", "max_doc"), "repeated-lines")
    lost = lines.join(losers, "key").where(F.col("doc") < F.col("max_doc"))
    return lost.groupBy("doc").agg(F.sort_array(F.collect_set("key")).alias("dropped"))


def is_in(key: Column, ordered: Column) -> Column:
    """Whether the sorted array holds the key, by halves."""
    span = F.struct(F.lit(1).alias("lo"), F.size(ordered).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.element_at(ordered, mid) < key)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered).cast("double"))).cast("int"))
    return F.element_at(ordered, F.aggregate(steps, span, halve)["lo"]) == key


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """docs as ``__row`` with ``__lines`` (count) and ``__kept``, the lines that stay."""
    lost = repeated_lines(docs, **settings)
    rows = docs.select(F.struct("*").alias("__row"), own_id(F.col("doc_id")).alias("doc"))
    text = F.col("__row")["text"].cast("string")
    pairs = F.arrays_zip(split_lines(text).alias("line"), line_hashes(text, settings.get("least", LEAST)).alias("hash"))
    kept = lambda lost: F.transform(F.filter(pairs, lambda p: p["hash"].isNull() | ~lost(p["hash"])), lambda p: p["line"])
    joined, dropped = rows.join(lost, "doc", "left"), F.col("dropped")
    few = F.when(dropped.isNull(), split_lines(text)).when(F.size(dropped) <= FEW, kept(lambda h: F.array_contains(dropped, h)))
    lines = few.otherwise(kept(lambda h: is_in(h, dropped)))
    return joined.select("__row", F.size(split_lines(text)).cast("long").alias("__lines"), lines.alias("__kept"))


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    found = without_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")), **settings)
    return found.select(
        F.col("__row")["doc_id"].alias("doc_id"),
        F.col("__lines").alias("n_lines"),
        (F.col("__lines") - F.size("__kept")).alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, drop_emptied: bool = False, **settings) -> DataFrame:
    """The documents with what lines stay as their text, and n_chars anew if there is such a column.

    ``drop_emptied``: a document goes if it has lost lines and no word is left, as all it said stands in other documents;
    else it stays with what is left. Documents that had no words before stay in either case.
    """
    found = without_repeats(docs, **settings)
    # one value a document, so that what stays of its lines is worked out once for all that follows
    told = F.transform(F.array(F.struct("__lines", "__kept")), lambda s: F.struct((F.size(s["__kept"]) < s["__lines"]).alias("shorter"), F.array_join(s["__kept"], "\n").alias("text")))
    if drop_emptied:
        told = F.filter(told, lambda t: ~t["shorter"] | (F.trim(t["text"], F.lit(BLANKS)) != ""))
    found = found.select("__row", F.explode(told).alias("__left"))
    text = F.when(F.col("__left.shorter"), F.col("__left.text")).otherwise(F.col("__row")["text"])
    changed = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns))
