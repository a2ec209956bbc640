"""Token lengths against the tokenizers library, masked log-probabilities, vocabulary tables and dictionary grades."""

import math
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.functions import readability, tokens
from quillstack.functions import textops as T
from quillstack.operators import chunking, convert, ngrams
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def sent(spark):
    return tokens.tokenizer(spark, PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " ", "naïve café, don't!", "日本語のテキスト", "word " * 1200, "unbelievably" * 300, "<|endoftext|> x"]


def test_counts_and_chunks(spark, library, sent):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + TEXTS
    df = spark.createDataFrame(list(enumerate(docs)), "k long, text string").repartition(4)
    both = tokens.with_token_chunks(tokens.with_token_counts(df, "text", sent), "text", sent, 512)
    for r in both.collect():
        want = ids(library, docs[r.k])
        assert r.n_tokens == len(want)
        if len(want) <= 512:
            assert [tuple(c) for c in r.chunks] == [(len(want), docs[r.k])]
        else:
            parts = [want[i : i + 512] for i in range(0, len(want), 512)]
            assert [tuple(c) for c in r.chunks] == [(len(p), library.decode(p, skip_special_tokens=False)) for p in parts]


def test_book_chunks_by_real_tokens(spark, library, sent):
    pages = [("b", i, f"p{i}", "some unbelievably long words here " * (i % 5)) for i in range(60)]
    df = tokens.with_token_counts(spark.createDataFrame(pages, "book string, page_idx long, page_number string, text string"), "text", sent)
    s, chunk, want = 0, 0, Counter()
    for p in pages:
        want[chunk] += 1
        s += len(ids(library, p[3]))
        if s > 100:
            s, chunk = 0, chunk + 1
    assert {r.chunk: r.n_pages for r in chunking.page_chunks(df, 100).collect()} == dict(want)


def test_dialogues_fit_by_real_tokens(spark, library, sent):
    said = "".join(f"Child: {'why ' * i}unbelievable?\nAssistant: {'because ' * (2 * i)}.\n" for i in range(1, 9))
    df = spark.createDataFrame([("b", "1", said), ("b", "2", "Child: hi\nAI: ho")], "book_name string, page_number string, generated_text string")
    for budget in (10, 60, 150, 10_000):
        got = {r.id: [(p.user, p.assistant) for p in r.turns] for r in convert.dialogue_records(df, [], [], budget, tokenizer=sent, overhead=3).collect()}
        for row, text in (("b_1", said), ("b_2", "Child: hi\nAI: ho")):
            del text
            every = {r.id: [(p.user, p.assistant) for p in r.turns] for r in convert.dialogue_records(df, [], [], 10**9).collect()}[row]
            kept, n = 0, 0
            for u, a in every:
                n += len(ids(library, u)) + len(ids(library, a)) + 6
                if n > budget:
                    break
                kept += 1
            assert got[row] == every[:kept]


def test_a_tokenizer_that_is_too_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "LARGEST", 10)
    (tmp_path / "t.json").write_text("x" * 11)
    with pytest.raises(ValueError, match="too large"):
        tokens.tokenizer(spark, str(tmp_path / "t.json"))


def test_masked_nll(spark):
    cases = [([None, -1.0, -2.0, -4.0], 0, 9), ([-9.0, -1.0, -2.0, -4.0], 2, 9), ([-9.0, -1.0, -2.0, -4.0], 1, 3), ([-9.0, -1.0], 5, 9), ([], 0, 9), ([-3.0], 0, 9), ([-1.0] * 6, 4, 4)]
    for logps, n_prompt, most in cases:
        row = spark.range(1).select(tokens.masked_nll(F.array(*(F.lit(x).cast("double") for x in logps)).cast("array<double>"), F.lit(n_prompt), most).alias("s")).first().s
        held = logps[:most]
        scored = [x for i, x in enumerate(held) if i >= max(1, min(n_prompt, most))]
        assert (row.n_scored, row.n_tokens) == (len(scored), len(held))
        assert row.nll == pytest.approx(-sum(scored) / max(1, len(scored)))


def test_bigram_backend_by_definition(spark):
    train = ["the cat sat on the mat", "the dog sat", "", "a cat"]
    test = ["the cat sat", "a zebra sat on the dog", "", None]
    fit = ngrams.fit(spark.createDataFrame([(t,) for t in train], "t string").select(ngrams.words(F.col("t")).alias("w")), "w")
    seqs = [t.split() for t in train]
    pairs = Counter(p for s in seqs for p in zip(["", *s], s, strict=False))
    single, context = Counter(w for s in seqs for w in s), Counter()
    for (p, _), c in pairs.items():
        context[p] += c
    n, v = sum(single.values()), len(single)
    df = spark.createDataFrame(list(enumerate(test)), "k long, t string").select("k", ngrams.words(F.col("t")).alias("w"))
    got = {r.k: r.logps for r in ngrams.token_log_probabilities(df, "k", "w", fit).collect()}
    for k, t in enumerate(test):
        s = (t or "").split()
        want = [math.log((pairs[p, w] + (single[w] + 1) / (n + v + 1)) / (context[p] + 1)) for p, w in zip(["", *s], s, strict=False)]
        assert got[k] == pytest.approx(want)


def test_vocabulary_table(spark):
    words = spark.range(120_000).selectExpr("concat('W', translate(string(id), '0123456789', 'abcdefghij')) as word")
    rows = [(0, "zzz wbcd zz"), (1, "WA."), (2, "nothing here"), (3, None), (4, ""), (5, "wa wa wb")]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {r.k for r in ngrams.vocabulary_hits(df, "k", "text", words.unionByName(words.limit(1)).union(spark.createDataFrame([(None,)], "word string"))).collect()} == {0, 1, 5}


def test_known_grades(spark):
    """Grades worked out by hand from pronounced syllables."""
    dictionary = [("the", 1), ("cat", 1), ("sat", 1), ("on", 1), ("mat", 1), ("every", 2), ("Every", 3), ("area", 3), ("idea", 3), ("people", 2), ("don't", 1), (None, 4), ("x", None)]
    d = spark.createDataFrame(dictionary, "word string, syllables int")
    texts = [("The cat sat on the mat.", 6, 1, 6), ("Every area! People don't sat on.", 6, 2, 10), ("Stone table made rhythm", 4, 1, 5), ("", 0, 1, 0), (None, 0, 1, 0), ("... 12 ...", 0, 2, 0)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "k long, text string")
    got = {r.k: (r.n_words, r.n_sentences, r.n_syllables, r.fk_grade) for r in readability.grades(df, "k", "text", d).collect()}
    for k, (_, w, s, y) in enumerate(texts):
        grade = math.floor((0.39 * w / s + 11.8 * y / w - 15.59) * 1000 + 0.5) / 1000 if w else 0.0
        assert got[k] == (w, s, y, grade)
    assert got[0][3] == -1.45 and got[1][3] == 5.247


def test_hot_word_is_not_one_task(spark):
    """Both sides of the join by word are exchanged, so that Spark can split the word that stands in every text."""
    from quillstack.operators import scores

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([(i, "the cat") for i in range(50)], "k long, text string")
        plan = scores.unigram_nll(df, "k", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    join = plan[plan.index("SortMergeJoin [w") :]
    assert join.count("Exchange hashpartitioning(w") == 2


def test_chat_forms(spark):
    df = spark.createDataFrame([(0, [("system", "s"), ("user", "u"), ("assistant", None), ("user", "v")]), (1, [])], "k int, m array<struct<role:string,content:string>>")
    made = lambda form, answer=False: {r.k: r.t for r in df.select("k", T.render_chat(F.col("m"), form, answer).alias("t")).collect()}
    assert made("plain") == {0: "<|system|>\ns\n<|user|>\nu\n<|assistant|>\n\n<|user|>\nv", 1: ""}
    assert made("chatml", True)[0].endswith("<|im_start|>user\nv<|im_end|>\n<|im_start|>assistant\n") and made("chatml")[1] == ""
    assert made("header")[0].startswith("<|start_header_id|>system<|end_header_id|>\n\ns<|eot_id|><|start_header_id|>user")
    assert made("turn")[0] == "<start_of_turn>system\ns<end_of_turn>\n<start_of_turn>user\nu<end_of_turn>\n<start_of_turn>model\n<end_of_turn>\n<start_of_turn>user\nv<end_of_turn>\n"
    assert made("inst")[0] == "<<SYS>>\ns\n<</SYS>>\n\n[INST] u [/INST]  </s>[INST] v [/INST]"
    odd = spark.createDataFrame([([("tool", "x")],)], "m array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="inst has no role tool"):
        odd.select(T.render_chat(F.col("m"), "inst")).collect()


def test_buckets_grow_with_rows(spark, monkeypatch):
    """Ranks are the same whatever the number of buckets, and a bucket's rows don't grow with the table."""
    from quillstack.operators import ranking

    assert [ranking.hash_digits(n) for n in (0, 100_000, 10**8, 10**9, 10**13)] == [2, 2, 3, 4, 4]
    df = spark.range(5000).selectExpr("id", "md5(cast(id as string)) as key", "pmod(id, 7) * 1.0 as score")
    want = {r.id: (r.a, r.b) for r in ranking.score_rank(ranking.hash_rank(df, "key", "id", name="a"), "score", "key", "id", "b").collect()}
    monkeypatch.setattr(ranking, "ROWS", 20)
    assert ranking.hash_digits(5000) == 2 and ranking.hash_digits(10**6) == 4
    n, cuts = ranking.quantile_cuts(df, ["score"])
    assert n == 5000 and cuts["score"]
    got = {r.id: (r.a, r.b) for r in ranking.score_rank(ranking.hash_rank(df, "key", "id", name="a", n=10**6), "score", "key", "id", "b").collect()}
    assert got == want


LONG = "x" * 100
WORDS = ["the cat the", "the dog", f"{LONG} the {LONG}", None, "", "... 1", "a b c d e f g the cat", *["the cat"] * 40]


def test_frequent_counts(spark):
    """The frequent words are no more than the limit; a long word is none, whatever its count."""
    from quillstack.operators import lexicon

    counts = spark.createDataFrame([("the", 45), ("cat", 42), (LONG, 44), ("dog", 1), ("a", 1)], "w string, c long")
    for limit in range(6):
        least, mass = lexicon.frequent(counts, "w", "c", limit)
        taken = 0 if least is None else counts.where((F.col("c") >= least) & (F.length("w") <= lexicon.LONGEST)).count()
        assert mass == 133 and taken == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4}[limit]
    assert lexicon.frequent(counts.limit(0), "w", "c") == (None, 0)


@pytest.mark.parametrize("limit", [0, 1, 2, 100])
def test_unigram_nll_whatever_is_frequent(spark, monkeypatch, limit):
    """The same values whether all, some or no words are sent to the workers."""
    from quillstack.operators import scores

    whole = scores.frequent
    monkeypatch.setattr(scores, "frequent", lambda t, w, n: whole(t, w, n, limit))
    words = [[w for w in re.split("[^a-z]+", (t or "").lower()) if w] for t in WORDS]
    c = Counter(w for ws in words for w in ws)
    want = {k: (round(-sum(math.log(c[w] / c.total()) for w in ws) / max(len(ws), 1), 9), len(ws)) for k, ws in enumerate(words)}
    df = spark.createDataFrame(list(enumerate(WORDS)), "k long, text string")
    assert {r.k: (round(r.nll, 9), r.n_tokens) for r in scores.unigram_nll(df, "k", "text").collect()} == want


def frequent_words_stay(made, word):
    """A text's frequent words are summed where it is read: nothing is exchanged by id and word."""
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(rf"Exchange hashpartitioning\(k#\d+L, {word}#", plan)
    assert re.search(rf"BroadcastHashJoin \[{word}#\d+\], \[{word}#\d+\], Inner", plan)


def test_unigram_nll_does_not_shuffle_frequent_words(spark):
    from quillstack.operators import scores

    frequent_words_stay(scores.unigram_nll(spark.createDataFrame([(i, "the cat sat") for i in range(50)], "k long, text string"), "k", "text"), "w")


@pytest.mark.parametrize("limit", [0, 1, 2, 100])
def test_grades_whatever_is_frequent(spark, monkeypatch, limit):
    whole = readability.frequent
    monkeypatch.setattr(readability, "frequent", lambda t, w, n: whole(t, w, n, limit))
    told = {"cat": 7, LONG: 9, "the": 2}
    words = [[w for w in re.split("[^a-z]+", (t or "").lower()) if w] for t in WORDS]
    df = spark.createDataFrame(list(enumerate(WORDS)), "k long, text string")
    made = readability.grades(df, "k", "text", spark.createDataFrame(list(told.items()), "word string, syllables int"))
    assert {r.k: (r.n_words, r.n_syllables) for r in made.collect()} == {k: (len(ws), sum(told.get(w, 1) for w in ws)) for k, ws in enumerate(words)}


def test_grades_do_not_shuffle_frequent_words(spark):
    df = spark.createDataFrame([(i, "the cat sat") for i in range(50)], "k long, text string")
    frequent_words_stay(readability.grades(df, "k", "text", spark.createDataFrame([("the", 1)], "word string, syllables int")), "word")


def test_recurring_words_are_encoded_once(library):
    """Lengths come from the words' own ids, kept between texts; they are the library's."""
    with open(PATH, encoding="utf-8") as f:
        content = f.read()
    texts = ["zqxj wqe", "wqe zqxj, ZQXJ x", "é ́e  z", *TEXTS]
    assert [x.tolist() for x in tokens.encoded(content, texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert {b"zqxj", b"wqe"} <= set(tokens._built(content))
