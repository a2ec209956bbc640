"""Generated text to conversation records, and their check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.functions.tokens import with_pair_tokens


def _named(df: DataFrame) -> DataFrame:
    name = F.concat_ws("_", "book_name", "page_number")
    return df.withColumn("id", name).withColumn("image", F.concat(name, F.lit(".jpg")))


def caption_records(responses: DataFrame, patterns: Sequence[str], errors: Sequence[str], instructions: Sequence[str], seed: int = 42) -> DataFrame:
    """book_name, page_number, generated_text -> id, image, instruction, caption."""
    text = T.caption_separators(T.truncate_at(F.col("generated_text"), patterns))
    draw = F.pmod(F.conv(F.substring(T.order_key(seed, "instruct", F.col("id")), 1, 8), 16, 10).cast("bigint"), F.lit(len(instructions))).cast("int")
    kept = _named(responses.where(~T.contains_any(F.col("generated_text"), errors))).withColumn("caption", text).where("caption <> ''")
    return kept.select("id", "image", F.element_at(T.lit_array(instructions), draw + 1).alias("instruction"), "caption")


def dialogue_records(responses: DataFrame, patterns: Sequence[str], errors: Sequence[str], budget: int = 3072, seed: int = 42,
    tokenizer: Broadcast | None = None, overhead: int = 0) -> DataFrame:
    """book_name, page_number, generated_text -> id, image, turns (pairs of user and assistant).

    tokenizer (functions.tokens): what counts against the budget, with ``overhead`` tokens a turn for the chat's marks;
    without it words count.
    """
    text = T.dialogue_separators(T.truncate_at(F.col("generated_text"), patterns))
    bit = F.pmod(F.conv(F.substring(T.order_key(seed, "image", F.col("id")), 1, 8), 16, 10).cast("bigint"), F.lit(2))
    kept = _named(responses.where(~T.contains_any(F.col("generated_text"), errors))).withColumn("turns", T.turn_pairs(T.speaker_turns(text)))
    shown = kept.withColumn("turns", T.without_description(T.with_image_token(F.col("turns"), bit))).where(F.size("turns") > 0)
    if tokenizer is None:
        return shown.select("id", "image", T.fit_pairs(F.col("turns"), budget, overhead).alias("turns"))
    counted = with_pair_tokens(shown.select("id", "image", "turns"), "turns", tokenizer)
    return counted.select("id", "image", T.fit_pairs(F.col("turns"), budget, overhead, F.col("pair_tokens")).alias("turns"))


def conversation(turns: Column) -> Column:
    """array<struct<from,value>> from pairs."""
    each = F.transform(turns,
        lambda p: F.array(F.struct(F.lit("human").alias("from"), p["user"].alias("value")),
            F.struct(F.lit("gpt").alias("from"), p["assistant"].alias("value"))))
    return F.flatten(each)


def turns_of(conversations: Column) -> Column:
    """array<struct<user,assistant>> of array<struct<from,value>>, image tags off; an odd last turn has no partner and is
    left out, roles that don't alternate from human are an error."""
    at = F.floor(F.size(conversations) / 2).cast("int")
    places = F.when(at > 0, F.sequence(F.lit(0), at - 1)).otherwise(F.array().cast("array<int>"))
    said = lambda i, who: F.when(F.get(conversations, i)["from"] == who,
        F.get(conversations, i)["value"]).otherwise(F.raise_error(F.lit(f"a turn is not from {who}")))
    return F.transform(places,
        lambda i: F.struct(T.strip_image_tag(said(i * 2, "human")).alias("user"), T.strip(said(i * 2 + 1, "gpt")).alias("assistant")))


def qa_mismatch(turns: DataFrame, conv: str, role: str, human: str, assistant: str) -> DataFrame:
    """Conversations with unequal numbers of questions and answers."""
    count = lambda who: F.sum((F.col(role) == who).cast("bigint"))
    both = turns.groupBy(conv).agg(count(human).alias("n_questions"), count(assistant).alias("n_answers"))
    return both.where("n_questions <> n_answers").withColumn("more_answers", F.col("n_answers") > F.col("n_questions"))
