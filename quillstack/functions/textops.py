"""Text expressions: Column in, Column out, no UDF. Patterns run in the JVM; order of steps is part of their meaning."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.schemas import BANDS, LABEL_BANDS

# Phrases of unusable pages, patterns deleted one after the other, the phrase of clean pages.
UNUSABLE = (
    "The OCR text provided is unreadable",
    "The provided OCR text is empty.",
    "This text appears to be blank or incomplete. No cleaning was performed.",
    "Text omitted due to missing pages",
    "It is impossible to clean or understand text that only consists of the letters",
    "There seems to be a mistake. This text contains only one word and does not make any sense in the context",
    "It is not clear what the provided OCR text represents as it only contains seemingly random characters",
)
DELETED = (
    r"Digitized by Google",
    r"\(Digitized by Google\)",
    r"The Baldwin Library",
    r"(Printed on title)",
    r"Copyright Moloughlin\n",
    r"COPYRIGHT © ISS9 by D. Lothrop Company.",
    r"\n{5,}",
)
NO_ERRORS = "This text does not contain any OCR errors that require cleaning."
SPEAKERS = "(?i)Individual: |Assistant: |Child: |AI: "


def lit_array(values: Sequence) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip(c: Column) -> Column:
    """White space off both ends, as str.strip() for ASCII and Unicode blanks."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (c.contains(p) for p in phrases), F.lit(False))


def has_vocabulary_word(text: Column, vocabulary: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), lit_array(vocabulary))


def chunk_tokens(tokens: Column, size: int) -> Column:
    """array<array>: slices of `size` tokens; one (possibly empty) chunk if they fit."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1))
    return F.transform(starts, lambda i: F.slice(tokens, i * size + 1, F.lit(size)))


def text_chunks(text: Column, tokens: Column, size: int) -> Column:
    """array<struct<n_tokens,text>>: the text as it is if its tokens fit, else slices of `size` tokens joined by blanks.

    tokens may be any tokenizer's array of strings.
    """
    cut = F.transform(chunk_tokens(tokens, size), lambda w: F.struct(F.size(w).alias("n_tokens"), F.array_join(w, " ").alias("text")))
    return F.when(F.size(tokens) <= size, F.array(F.struct(F.size(tokens).alias("n_tokens"), text.alias("text")))).otherwise(cut)


def fill_prompt(prompt: Sequence[tuple[str, str]], text: Column, hole: str = "<prompt_template>") -> Column:
    """array<struct<role,content>> with the hole filled in every message."""
    return F.array(*(F.struct(F.lit(role).alias("role"), F.replace(F.lit(content), F.lit(hole), text).alias("content")) for role, content in prompt))


#: The marks of chat forms. Of each message what stands before its role, between role and content, and after it;
#: then what opens an answer. A form with ``roles`` has marks of its own before and after each role's content.
CHAT_FORMS = {
    "plain": {"head": "<|", "mid": "|>\n", "tail": "", "between": "\n", "answer": "\n<|assistant|>\n"},
    "chatml": {"head": "<|im_start|>", "mid": "\n", "tail": "<|im_end|>\n", "between": "", "answer": "<|im_start|>assistant\n"},
    "header": {"head": "<|start_header_id|>", "mid": "<|end_header_id|>\n\n", "tail": "<|eot_id|>", "between": "", "answer": "<|start_header_id|>assistant<|end_header_id|>\n\n"},
    "turn": {"head": "<start_of_turn>", "mid": "\n", "tail": "<end_of_turn>\n", "between": "", "answer": "<start_of_turn>model\n", "names": {"assistant": "model"}},
    "inst": {"roles": {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}, "between": "", "answer": ""},
}


def render_chat(messages: Column, form: str = "plain", answer: bool = False) -> Column:
    """array<struct<role,content>> as one text in a form of ``CHAT_FORMS``; ``answer`` opens the assistant's next message.

    A role that a form has no marks for fails. No messages make an empty text; null content counts as empty.
    """
    marks = CHAT_FORMS[form]

    def said(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        if "roles" in marks:
            cases = None
            for role, (head, tail) in marks["roles"].items():
                text = F.concat(F.lit(head), content, F.lit(tail))
                cases = F.when(m["role"] == role, text) if cases is None else cases.when(m["role"] == role, text)
            return cases.otherwise(F.raise_error(F.concat(F.lit(f"{form} has no role "), F.coalesce(m["role"], F.lit("null")))))
        role = m["role"]
        for own, name in marks.get("names", {}).items():
            role = F.when(m["role"] == own, name).otherwise(role)
        return F.concat(F.lit(marks["head"]), role, F.lit(marks["mid"]), content, F.lit(marks["tail"]))

    text = F.array_join(F.transform(messages, said), marks["between"])
    return F.concat(text, F.lit(marks["answer"])) if answer else text


def before(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def usable(text: Column) -> Column:
    return ~contains_any(text, UNUSABLE)


def extract_cleaned(text: Column) -> Column:
    """From the header to the first ===; without a marker the last character goes, as a search that found nothing gives -1."""
    long, short = "Cleaned:\n     ", "Cleaned:\n"
    skip = F.when(text.startswith(long), len(long)).when(text.startswith(short), len(short)).otherwise(0)
    at = F.instr(text, "===")
    end = F.when(at > 0, at - 1).otherwise(F.char_length(text) - 1)
    return F.substring(text, skip + 1, F.greatest(F.lit(0), end - skip))


def delete_patterns(text: Column, patterns: Sequence[str] = DELETED) -> Column:
    return functools.reduce(lambda t, p: F.regexp_replace(t, f"(?iu){p}", ""), patterns, text)


def title_pattern(book: Column) -> Column:
    """A book's name as a pattern at the start of a text: an apostrophe may stand before a word's closing s."""
    return F.concat(F.lit(r"(?iu)\A"), F.regexp_replace(book, r"(?iU)(\w)s\b", "$1'?s"), F.lit("[\n:. ]"))


def clean_page(text: Column, book: Column) -> Column:
    """Blanks off both ends come first, so that a page number after them is at the start."""
    t = delete_patterns(strip(text))
    t = F.regexp_replace(t, r"\n\d+\n", "\n")
    t = F.regexp_replace(t, title_pattern(book), F.lit(""))
    t = F.regexp_replace(t, r"\A\d+[.: \n]", "")
    t = F.regexp_replace(t, r"\d+\.?$", "")
    t = F.regexp_replace(t, r"(?i)\(?Page Number: \d+\)?$", "")
    return strip(t)


def age_label(text: Column) -> Column:
    """The label of an answer, null if there is none; 9-12+ counts as 9-12."""
    found = F.regexp_extract(text, r"(?m)^Age group: ?\n? *?(3-5|6-8|9-12\+?|12\+)", 1)
    return F.when(found == "9-12+", "9-12").otherwise(F.nullif(found, F.lit("")))


def audit_label(text: Column) -> Column:
    found = F.regexp_extract(text, r"(12\+|9-12|6-8|3-5|9\+)", 1)
    return F.when(found == "", "unparsed").otherwise(found)


def book_key(name: Column) -> Column:
    """Base name without one closing .jsonl or .json."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.jsonl?$", "")


def image_candidates(book: Column, page: Column) -> Column:
    stem = F.regexp_replace(page, r"\.[^./]*$", "")
    return F.array(F.concat(book, F.lit("_"), stem, F.lit(".jpg")), F.concat(book, F.lit("/"), stem, F.lit(".jpg")))


def split_key(key: Column, mark: str) -> Column:
    """struct<book, page>: parted at the last mark."""
    pattern = f"(?s)^(.*){re.escape(mark)}([^{re.escape(mark)}]*)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("book"), F.regexp_extract(key, pattern, 2).alias("page"))


def caption_prefix(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\ACertainly! ", ""))


def truncate_at(text: Column, patterns: Sequence[str]) -> Column:
    """Cut before each pattern in turn, in what the patterns before it have left."""
    cut = lambda t, p: F.element_at(F.split(t, F.concat(F.lit(r"(?iu)\Q"), p, F.lit(r"\E")), 2), 1)
    return F.aggregate(lit_array(patterns), text, cut) if patterns else text


def caption_separators(text: Column) -> Column:
    t = strip(F.replace(text, F.lit("\n==="), F.lit("")))
    t = F.when(t.contains("==="), strip(before(t, "==="))).otherwise(t)
    t = strip(F.element_at(F.split(t, "(?iu)\n+Or", 2), 1))
    t = F.replace(t, F.lit("\n==="), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"=+\z", ""), r"-+\z", ""), r"\n+\z", "")


def dialogue_separators(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n===\n\n"), F.lit(" ")), F.lit("\n===\n"), F.lit("\n"))


def speaker_turns(text: Column) -> Column:
    """What follows each speaker's mark; text before the first is left out."""
    parts = F.split(text, SPEAKERS, -1)
    return F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))


def turn_pairs(turns: Column) -> Column:
    """array<struct<user,assistant>> of adjacent turns, an odd last one left out."""
    n = F.floor(F.size(turns) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ended = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(strip(t), F.lit("\n==="), F.lit("")), r"=+\z", ""), r"-+\z", ""),
        r"\n+\z", "")
    return F.transform(at,
        lambda i: F.struct(F.replace(strip(F.element_at(turns, i * 2 + 1)), F.lit("\n==="), F.lit("")).alias("user"),
            ended(F.element_at(turns, i * 2 + 2)).alias("assistant")))


def with_image_token(pairs: Column, bit: Column) -> Column:
    """<image> before (bit 0) or after the first question unless it has one."""

    def one(p: Column, i: Column) -> Column:
        placed = F.when(bit == 0, F.concat(F.lit("<image>\n"), p["user"])).otherwise(F.concat(p["user"], F.lit("\n<image>")))
        return F.struct(F.when((i == 0) & ~p["user"].contains("<image>"), placed).otherwise(p["user"]).alias("user"),
            p["assistant"].alias("assistant"))

    return F.transform(pairs, one)


def without_description(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~(F.lower(p["user"]).contains("the description") | F.lower(p["assistant"]).contains("the description")))


def fit_pairs(pairs: Column, budget: int, overhead: int = 0, counts: Column | None = None) -> Column:
    """The longest prefix of pairs whose tokens (plus overhead a turn) fit; it may be empty.

    counts: array<bigint>, a pair's tokens by a tokenizer; without it words count.
    """
    own = F.transform(pairs, lambda p: word_count(p["user"]) + word_count(p["assistant"])) if counts is None else counts
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(s: Column, cost: Column) -> Column:
        n = s["n"] + cost + 2 * overhead
        fits = s["open"] & (n <= budget)
        return F.struct(n.alias("n"), (s["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    return F.slice(pairs, F.lit(1), F.aggregate(own, start, step)["kept"])


def strip_image_tag(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s*<image>\s*", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def syllable_count(text: Column) -> Column:
    """Groups of vowel letters."""
    return F.regexp_count(F.lower(text), F.lit("[aeiouy]+")).cast("bigint")


def sentence_count(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.regexp_count(text, F.lit("[.!?]+")).cast("bigint"))


def fk_grade(text: Column) -> Column:
    words = F.greatest(F.lit(1).cast("bigint"), word_count(text))
    grade = 0.39 * words / sentence_count(text) + 11.8 * syllable_count(text) / words - 15.59
    return F.floor(grade * 1000 + 0.5) / 1000  # to 3 places, the same steps on every engine


def tokens_or_estimate(n_tokens: Column, n_words: Column) -> Column:
    return F.coalesce(F.nullif(n_tokens, F.lit(0).cast("bigint")), F.floor(n_words * 1.35).cast("bigint"))


def band_ordinal(band: Column, bands: Sequence[str] = BANDS) -> Column:
    return (F.array_position(lit_array(bands), band) - 1).cast("int")


def label_ordinal(label: Column) -> Column:
    return band_ordinal(label, LABEL_BANDS)


def map_roles(speaker: Column) -> Column:
    return F.when(speaker == "human", "user").when(speaker == "gpt", "assistant")


def local_version(version: Column) -> Column:
    return F.substring_index(version, "+", 1)


def order_key(seed: Column | int, epoch: Column | int, id_: Column) -> Column:
    """The hash that stands in for a seeded permutation: alike on every engine and whatever the partitioning."""
    as_text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.md5(F.concat(as_text(seed), F.lit(":"), as_text(epoch), F.lit(":"), as_text(id_)).cast("binary"))


def hash_unit(h: Column) -> Column:
    """[0, 1) from the first 32 bits of a hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
