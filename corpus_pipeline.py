"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, then BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return the
columns of documents. Null and empty texts, repeated rows and empty tables pass every stage; columns beyond those of
documents are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import chunk_codec, decontamination, line_dedup, near_dedup, toxicity
from quillstack.llm.common import discard, stored, table
from quillstack.llm.queries import word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and their labels, doesn't predict toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that later ones repeat; a document of which no word is left goes: others hold it all."""
    return line_dedup.dedup(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; documents without words stay."""
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document that is left."""
    return chunk_codec.round_trip(docs, word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", encode_and_decode),
]

#: The toxicity stage is a trained classifier, near-dedup and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has kept is stored; it is deleted once the next stage's rows are."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir), f"stage-{i}-{name.split()[0]}")
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
