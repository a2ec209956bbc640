"""Domain constants and schemas. Bands are ordered from youngest to oldest."""

from __future__ import annotations

# The two spellings of the age bands, tasks, scores.
LABEL_BANDS = ("3-5", "6-8", "9-12", "12+")
BANDS = ("3_5", "6_8", "9_12", "12")
TASKS = ("caption", "vqa", "reasoning")
SCORE_FIELDS = ("fk_grade", "nll", "nll_qwen", "nll_gemma")

TURNS = "array<struct<user:string,assistant:string>>"
CONVERSATION = "array<struct<from:string,value:string>>"
OCR_PAGE = "page_number string, text string"
CLEANED_CHUNK = "page_number string, generated_text string, prompt_length int, generated_length int, finish_reason string"
AGE_VOTE = "start_page string, end_page string, age_category string, prompt_length int, generated_length int, finish_reason string"
DESCRIPTION = "book_name string, page_number string, caption string"
MANIFEST = f"id string, image string, texts {TURNS}, task string, age_band string, n_words bigint, fk_grade double"
SCORED = MANIFEST + ", nll double, n_tokens bigint, nll_qwen double, nll_gemma double"
TRAJECTORY = "epochs int, lm_init string, modality string, order string, schedule string, seed int, step bigint, task string, accuracy double"
