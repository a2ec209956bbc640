"""Queries that count in tokens, words of a vocabulary, and log-probabilities of a fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import readability, tokens
from quillstack.functions import textops as T
from quillstack.operators import chunking, ngrams, results
from quillstack.operators.stored import stored
from quillstack.plans import tables as D
from quillstack.plans.registry import query


def word_tokenizer(spark):
    import public_tokenizers

    return tokens.tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))


@query()
def token_chunk_bpe(spark, d):
    """Slices of 512 real tokens; a text whose tokens fit stays as it is."""
    docs = tokens.with_token_chunks(D.table(spark, d, "documents").select("doc_id", "text"), "text", word_tokenizer(spark), 512)
    each = docs.select("doc_id", F.posexplode("chunks").alias("chunk", "part"))
    return each.select("doc_id", "chunk", F.col("part.n_tokens").cast("bigint").alias("n_tokens"), F.md5(F.col("part.text").cast("binary")).alias("digest"))


@query()
def book_chunks_bpe(spark, d):
    """Chunks of pages by real tokens: over 5,000 a chunk is closed."""
    p = D.pages(spark, d).select("book", F.col("page").alias("page_idx"), "page_number", "text")
    # stored, so that texts are encoded once; texts themselves are read again where they meet their chunk
    counted = stored(tokens.with_token_counts(p, "text", word_tokenizer(spark)).select("book", "page_idx", "n_tokens"))
    out = chunking.page_chunks(p.join(counted, ["book", "page_idx"]), 5000)
    return out.select("book", "chunk", "start_page", "end_page", "n_pages", F.md5(F.col("text").cast("binary")).alias("digest"))


def dialogues(spark, d):
    """conv_id and the pairs of a conversation's turns, without what the system says."""
    said = D.table(spark, d, "conversations").where("role <> 'system'")
    turns = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("turns"))
    return turns.select("conv_id", T.turn_pairs(F.col("turns")).alias("pairs"))


@query()
def dialogue_fit_bpe(spark, d):
    """The longest run of a dialogue's first pairs with at most 512 real tokens, 4 a turn for the chat's marks."""
    counted = tokens.with_pair_tokens(dialogues(spark, d), "pairs", word_tokenizer(spark))
    kept = F.size(T.fit_pairs(F.col("pairs"), 512, 4, F.col("pair_tokens")))
    total = F.aggregate(F.slice("pair_tokens", F.lit(1), kept), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return counted.select("conv_id", F.size("pairs").alias("n_pairs"), kept.alias("n_kept"), total.alias("n_tokens"))


@query(r"""WITH t AS (SELECT conv_id, regexp_extract_all(lower(string_agg(text, chr(10) ORDER BY turn)), '[a-z]+') AS w,
  CAST(len(regexp_extract_all(lower(coalesce(arg_min(text, turn), '')), '[a-z]+')) AS BIGINT) AS n_prompt FROM conversations WHERE role <> 'system' GROUP BY conv_id),
e AS (SELECT conv_id, n_prompt, unnest(w) AS w, unnest(list_concat([''], w[:-2])) AS prev, unnest(range(1, len(w) + 1)) AS pos FROM t),
pairs AS (SELECT prev, w, count(*) AS c FROM e GROUP BY ALL),
singles AS (SELECT w, count(*) AS c FROM e GROUP BY ALL),
contexts AS (SELECT prev, count(*) AS c FROM e GROUP BY ALL),
mass AS (SELECT sum(c) AS n, count(*) AS v FROM singles),
p AS (SELECT prev, w, ln((pairs.c + (singles.c + 1.0::DOUBLE) / (n + 1.0::DOUBLE * (v + 1))) / (contexts.c + 1.0::DOUBLE)) AS logp
  FROM pairs JOIN singles USING (w) JOIN contexts USING (prev), mass),
s AS (SELECT conv_id, -sum(logp ORDER BY pos) AS total, count(*) AS n FROM e JOIN p USING (prev, w) WHERE pos <= 256 AND pos > greatest(least(n_prompt, 256), 1) GROUP BY conv_id)
SELECT conv_id, n_prompt, coalesce(n, 0) AS n_scored, CAST(least(len(w), 256) AS BIGINT) AS n_tokens, coalesce(round(total / n, 6), 0.0) AS nll FROM t LEFT JOIN s USING (conv_id)""")
def masked_nll(spark, d):
    """A dialogue's mean NLL under word bigrams fitted on all dialogues, its first turn masked out, 256 tokens at most."""
    said = D.table(spark, d, "conversations").where("role <> 'system'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
    rows = said.groupBy("conv_id").agg(text.alias("full"), F.min_by("text", "turn").alias("prompt"))
    rows = rows.select("conv_id", ngrams.words(F.col("full")).alias("w"), F.size(ngrams.words(F.col("prompt"))).alias("n_prompt"))
    logps = ngrams.token_log_probabilities(rows, "conv_id", "w", ngrams.fit(rows, "w"))
    scored = rows.join(logps, "conv_id").withColumn("s", tokens.masked_nll(F.col("logps"), F.col("n_prompt"), 256))
    return scored.select("conv_id", F.col("n_prompt").cast("bigint").alias("n_prompt"), "s.n_scored", "s.n_tokens", F.round("s.nll", 6).alias("nll"))


@query("""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT DISTINCT doc_id FROM e WHERE length(w) >= 7 AND w IN (SELECT w FROM v WHERE length(w) >= 7)""")
def vocabulary_filter(spark, d):
    """Documents with a word of seven letters or more that a document of good quality has too."""
    docs = D.table(spark, d, "documents")
    good = docs.join(D.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    vocabulary = good.select(F.explode(ngrams.words(F.col("text"))).alias("word")).where("length(word) >= 7").distinct()
    return ngrams.vocabulary_hits(docs, "doc_id", "text", vocabulary)


@query(r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+(?:''[\p{L}]+)*')) AS w FROM benchmark),
dict AS (SELECT w, CAST(greatest(1, len(regexp_extract_all(w, '[aeiou]'))) AS BIGINT) AS s FROM b),
l AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]+(?:''[\p{L}]+)*') AS w, CAST(greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS n_sentences
  FROM documents),
e AS (SELECT doc_id, unnest(w) AS w FROM l),
g AS (SELECT doc_id, w, count(*) AS n FROM e GROUP BY ALL),
y AS (SELECT doc_id, CAST(sum(n * coalesce(s, greatest(1, len(regexp_extract_all(w, '[aeiouyàâäæéèêëîïôöœùûü]+')) - CASE WHEN regexp_matches(w, '[^aeiouy]e$')
  AND NOT regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END))) AS BIGINT) AS n_syllables FROM g LEFT JOIN dict USING (w) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, n_sentences, coalesce(n_syllables, 0) AS n_syllables, CASE WHEN len(w) = 0 THEN 0.0 ELSE
  floor((0.39::DOUBLE * len(w) / n_sentences + 11.8::DOUBLE * n_syllables / len(w) - 15.59::DOUBLE) * 1000 + 0.5) / 1000 END AS fk_grade FROM l LEFT JOIN y USING (doc_id)""")
def dictionary_grade(spark, d):
    """Reading grades with a dictionary table (the benchmark's words, a syllable a vowel), rules for all other words."""
    listed = D.table(spark, d, "benchmark").select(F.explode(readability.word_list(F.col("text"))).alias("word")).distinct()
    dictionary = listed.select("word", F.greatest(F.regexp_count("word", F.lit("[aeiou]")), F.lit(1)).alias("syllables"))
    return readability.grades(D.table(spark, d, "documents"), "doc_id", "text", dictionary)


@query(r"""SELECT doc_id, md5('<|im_start|>system' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10)) AS chatml, md5('<start_of_turn>user' || chr(10) || source || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)
  || text || '<end_of_turn>' || chr(10)) AS turn, md5('<<SYS>>' || chr(10) || source || chr(10) || '<</SYS>>' || chr(10) || chr(10) || '[INST] ' || text || ' [/INST]') AS inst
  FROM documents""")
def chat_forms(spark, d):
    """A text as a question in three chat forms."""
    said = lambda *pairs: F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in pairs))
    asked, told = said(("system", "source"), ("user", "text")), said(("user", "source"), ("assistant", "text"))
    made = {"chatml": T.render_chat(asked, "chatml", True), "turn": T.render_chat(told, "turn"), "inst": T.render_chat(asked, "inst")}
    return D.table(spark, d, "documents").select("doc_id", *(F.md5(c.cast("binary")).alias(n) for n, c in made.items()))


@query(f"""SELECT DISTINCT run, "order", seed FROM ({D.RUN_SQL}) WHERE epochs = 5 AND lm_init = 'smal' AND modality = 'mm' AND regexp_full_match(run, '.*_staged_.*')""")
def filtered_runs(spark, d):
    """Runs by all four filters at once: epochs, initialisation, modality and a pattern of the whole name."""
    runs = results.parse_runs(D.runs(spark, d).select("run").distinct())
    return results.filter_runs(runs, 5, "smal", "mm", ".*_staged_.*").select("run", "order", "seed")
