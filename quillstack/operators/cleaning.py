"""The cleaning job from generated chunks to pages: what is unusable goes, originals come back, rules run, chunks join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.operators.chunking import reassemble
from quillstack.operators.joins import with_original


def flagged(chunks: DataFrame) -> DataFrame:
    """chunks with ``unfinished`` and ``marked``: told, never dropped for it."""
    return chunks.withColumns({"unfinished": ~F.col("finish_reason").eqNullSafe("stop"), "marked": T.contains_any(F.col("text"), ("...", "---"))})


def extracted(generated: DataFrame, originals: DataFrame) -> DataFrame:
    """book_name, page_number, chunk_idx, generated_text, finish_reason -> chunks with ``text`` before the rules.

    Answers that say the page is unusable are left out; the text between header and end mark stays; the page's first chunk
    takes the original where the answer says there was nothing to clean. originals: book_name, page_number, text and, if
    pages repeat, ordinal.
    """
    usable = generated.where(T.usable(F.coalesce("generated_text", F.lit(""))))
    chunks = usable.withColumn("text", T.extract_cleaned(F.coalesce("generated_text", F.lit(""))))
    return flagged(with_original(chunks, originals, T.NO_ERRORS))


def clean_library(generated: DataFrame, originals: DataFrame) -> DataFrame:
    """(book_name, page_number, text): the cleaned pages of all books, a page's chunks in order with a blank between."""
    chunks = extracted(generated, originals).withColumn("text", T.clean_page(F.col("text"), F.col("book_name")))
    return reassemble(chunks, ["book_name", "page_number"], "chunk_idx", "text")
