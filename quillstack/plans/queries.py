"""A query per operator group over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.operators import artifacts, chunking, cleaning, convert, curriculum, joins, labels, manifest, pages, results, scores, validate
from quillstack.operators.ranking import ordered_rank
from quillstack.plans import lengths, packs  # noqa: F401  they add their queries
from quillstack.plans import tables as D
from quillstack.plans.registry import QUERIES, SQL, query
from quillstack.schemas import BANDS, LABEL_BANDS, TASKS


NL = "chr(10)"
VOCABULARY = ("the", "and", "reading", "that")


@query(r"SELECT doc_id, source FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['the', 'and', 'reading', 'that'])")
def ocr_english_filter(spark, d):
    return D.table(spark, d, "documents").where(T.has_vocabulary_word(F.col("text"), VOCABULARY)).select("doc_id", "source")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1,
  CAST(ceil(len(w) / 512.0) AS BIGINT)))) AS i FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(len(w[i * 512 + 1 : i * 512 + 512]) AS BIGINT) AS n_tokens,
  md5(CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[i * 512 + 1 : i * 512 + 512], ' ') END) AS digest FROM c
  JOIN documents USING (doc_id)""")
def token_chunk(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    each = D.table(spark, d, "documents").select("doc_id", F.posexplode(T.text_chunks(F.col("text"), words, 512)).alias("chunk", "part"))
    return each.select("doc_id", "chunk", F.col("part.n_tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.col("part.text").cast("binary")).alias("digest"))


PROMPT = (("user", "Clean this text.\n<prompt_template>==="), ("assistant", "Cleaned:\n"))


@query("""SELECT doc_id, md5('<|user|>' || chr(10) || 'Clean this text.' || chr(10) || text || '===' || chr(10) || '<|assistant|>' || chr(10) || 'Cleaned:' || chr(10)) AS digest FROM documents""")
def prompt_render(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.md5(T.render_chat(T.fill_prompt(PROMPT, F.col("text"))).cast("binary")).alias("digest"))


GENERATED = """SELECT doc_id, source, text, CASE doc_id % 5 WHEN 0 THEN 'Cleaned:' || chr(10) || '     ' || text || '===' || text WHEN 1
  THEN 'Cleaned:' || chr(10) || text WHEN 2 THEN text || '===tail'
  WHEN 3 THEN 'The provided OCR text is empty.' || text ELSE text || '<stop>' || text END AS g FROM documents"""


def generated(spark, d):
    t, nl = F.col("text"), "\n"
    k = F.pmod(F.col("doc_id"), F.lit(5))
    g = (
        F.when(k == 0, F.concat(F.lit("Cleaned:" + nl + "     "), t, F.lit("==="), t))
        .when(k == 1, F.concat(F.lit("Cleaned:" + nl), t))
        .when(k == 2, F.concat(t, F.lit("===tail")))
        .when(k == 3, F.concat(F.lit("The provided OCR text is empty."), t))
        .otherwise(F.concat(t, F.lit("<stop>"), t))
    )
    return D.table(spark, d, "documents").select("doc_id", "source", "text", g.alias("g"))


@query(f"SELECT doc_id, md5(split_part(g, '<stop>', 1)) AS digest FROM ({GENERATED})")
def stop_truncate(spark, d):
    return generated(spark, d).select("doc_id", F.md5(T.before(F.col("g"), "<stop>").cast("binary")).alias("digest"))


@query(f"""WITH u AS (SELECT doc_id, split_part(g, '<stop>', 1) AS t FROM ({GENERATED}) WHERE NOT contains(g, 'The provided OCR text is empty.')),
s AS (SELECT doc_id, t, CASE WHEN starts_with(t, 'Cleaned:' || chr(10) || '     ') THEN 14 WHEN starts_with(t, 'Cleaned:' || chr(10)) THEN 9
  ELSE 0 END AS skip, instr(t, '===') AS spot FROM u)
SELECT doc_id, md5(substr(t, skip + 1, greatest(0, CASE WHEN spot > 0 THEN spot - 1 ELSE length(t) - 1 END - skip))) AS digest FROM s""")
def ocr_extract(spark, d):
    u = generated(spark, d).where(T.usable(F.col("g"))).withColumn("t", T.before(F.col("g"), "<stop>"))
    return u.select("doc_id", F.md5(T.extract_cleaned(F.col("t")).cast("binary")).alias("digest"))


DIRTY = """SELECT doc_id, 'Tales' AS book, CASE doc_id % 4 WHEN 0 THEN 'Tale''s: ' || text || ' 12.' WHEN 1
  THEN chr(10) || '17. ' || text || chr(10) || '23' || chr(10) || 'end (Page Number: 7)' WHEN 2
  THEN 'THE BALDWIN LIBRARY ' || text || ' (Digitized by Google)' ELSE '  ' || text || repeat(chr(10), 6) || 'x ' END AS t FROM documents"""


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, 'Digitized by Google', '', 'gi'), 'The Baldwin Library', '',
  'gi'), '\n{{5,}}', '', 'g') AS t FROM (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM ({DIRTY}))),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\n\d+\n', chr(10), 'g'), '^Tale''?s[\n:. ]', '', 'i'), '^\d+[.: \n]', '') AS t
  FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\d+\.?\n?$', ''), '\(?Page Number: \d+\)?$', '', 'i') AS t FROM b)
SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS digest FROM c""")
def ocr_clean_rules(spark, d):
    k, t = F.pmod(F.col("doc_id"), F.lit(4)), F.col("text")
    dirty = (
        F.when(k == 0, F.concat(F.lit("Tale's: "), t, F.lit(" 12.")))
        .when(k == 1, F.concat(F.lit("\n17. "), t, F.lit("\n23\nend (Page Number: 7)")))
        .when(k == 2, F.concat(F.lit("THE BALDWIN LIBRARY "), t, F.lit(" (Digitized by Google)")))
        .otherwise(F.concat(F.lit("  "), t, F.lit("\n" * 6 + "x ")))
    )
    return D.table(spark, d, "documents").select("doc_id", F.md5(T.clean_page(dirty, F.lit("Tales")).cast("binary")).alias("digest"))


@query("""WITH c AS (SELECT source AS book, doc_id // 3 AS page, doc_id % 3 AS i, CASE WHEN doc_id % 7 = 0
  THEN 'This text does not contain any OCR errors that require cleaning.' ELSE text END AS t, doc_id FROM documents),
j AS (SELECT c.*, t = 'This text does not contain any OCR errors that require cleaning.' AS wants, o.text AS original FROM c LEFT JOIN (SELECT source
  AS book, CASE WHEN doc_id % 3 = 2 THEN -doc_id ELSE doc_id // 3 END AS page, arg_max(text, doc_id) AS text FROM documents GROUP BY ALL) o USING (book, page)),
l AS (SELECT *, min(i) FILTER (WHERE NOT (wants AND original IS NULL)) OVER (PARTITION BY book, page) AS lead FROM j),
k AS (SELECT * FROM l WHERE NOT (wants AND original IS NULL AND (lead IS NULL OR i < lead))),
f AS (SELECT book, page, i, CASE WHEN wants AND i = lead THEN original ELSE t END AS t FROM k)
SELECT book, page, md5(string_agg(t, ' ' ORDER BY i)) AS digest FROM f GROUP BY book, page""")
def chunk_reassemble(spark, d):
    docs = D.table(spark, d, "documents")
    page, i = F.floor(F.col("doc_id") / 3).cast("bigint"), F.pmod(F.col("doc_id"), F.lit(3))
    chunks = docs.select(F.col("source").alias("book_name"), page.alias("page_number"), i.alias("chunk_idx"),
        F.when(F.pmod(F.col("doc_id"), F.lit(7)) == 0, T.NO_ERRORS).otherwise(F.col("text")).alias("text"))
    # a third of the originals are of other pages, so some pages have none
    elsewhere = F.when(i == 2, -F.col("doc_id")).otherwise(page)
    originals = docs.select(F.col("source").alias("book_name"), elsewhere.alias("page_number"), "text", F.col("doc_id").alias("ordinal"))
    out = chunking.reassemble(joins.with_original(chunks, originals, T.NO_ERRORS), ["book_name", "page_number"], "chunk_idx", "text")
    return out.select(F.col("book_name").alias("book"), F.col("page_number").alias("page"), F.md5(F.col("text").cast("binary")).alias("digest"))


JOB = """SELECT source AS book, doc_id // 3 AS page, doc_id AS i, CASE doc_id % 7 WHEN 0
  THEN 'Cleaned:' || chr(10) || 'This text does not contain any OCR errors that require cleaning.===' WHEN 1
  THEN 'The provided OCR text is empty.' || text
  WHEN 2 THEN 'Cleaned:' || chr(10) || '     ' || source || ': ' || text || '===' || text WHEN 3
  THEN chr(10) || '12. ' || text || ' (Page Number: 7)===' WHEN 4 THEN text
  ELSE 'Cleaned:' || chr(10) || text || chr(10) || '23' || chr(10) || 'end 7.===' END AS g FROM documents"""


@query(rf"""WITH u AS (SELECT * FROM ({JOB}) WHERE NOT contains(g, 'The provided OCR text is empty.')),
s AS (SELECT *, CASE WHEN starts_with(g, 'Cleaned:' || chr(10) || '     ') THEN 14 WHEN starts_with(g, 'Cleaned:' || chr(10)) THEN 9 ELSE 0 END
  AS skip, instr(g, '===') AS spot FROM u),
e AS (SELECT book, page, i, substr(g, skip + 1, greatest(0, CASE WHEN spot > 0 THEN spot - 1 ELSE length(g) - 1 END - skip)) AS t FROM s),
o AS (SELECT source AS book, CASE WHEN doc_id % 2 = 1 THEN -doc_id ELSE doc_id // 3 END AS page, arg_max(text, doc_id) AS original FROM documents GROUP BY ALL),
j AS (SELECT e.*, contains(t, 'This text does not contain any OCR errors that require cleaning.') AS wants, original FROM e LEFT JOIN o USING (book,
  page)),
l AS (SELECT *, min(i) FILTER (WHERE NOT (wants AND original IS NULL)) OVER (PARTITION BY book, page) AS lead FROM j),
k AS (SELECT book, page, i, CASE WHEN wants AND i = lead THEN original ELSE t END AS t FROM l WHERE NOT (wants AND original IS NULL AND (lead IS NULL
  OR i < lead))),
a AS (SELECT book, page, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'),
  'Digitized by Google', '', 'gi'), 'The Baldwin Library', '', 'gi'), 'Printed on title', '', 'gi'), '\n{{5,}}', '', 'g') AS t FROM k),
b AS (SELECT book, page, i, regexp_replace(regexp_replace(regexp_replace(t, '\n\d+\n', chr(10), 'g'), '^' || book || '[\n:. ]', '', 'i'),
  '^\d+[.: \n]', '') AS t FROM a),
c AS (SELECT book, page, i, regexp_replace(regexp_replace(t, '\d+\.?\n?$', ''), '\(?Page Number: \d+\)?$', '', 'i') AS t FROM b)
SELECT book, page, md5(string_agg(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' ' ORDER BY i)) AS digest FROM c GROUP BY book, page""")
def clean_library(spark, d):
    docs, text, k = D.table(spark, d, "documents"), F.col("text"), F.pmod(F.col("doc_id"), F.lit(7))
    page = F.floor(F.col("doc_id") / 3).cast("bigint")
    g = (
        F.when(k == 0, F.lit("Cleaned:\n" + T.NO_ERRORS + "==="))
        .when(k == 1, F.concat(F.lit("The provided OCR text is empty."), text))
        .when(k == 2, F.concat(F.lit("Cleaned:\n     "), "source", F.lit(": "), text, F.lit("==="), text))
        .when(k == 3, F.concat(F.lit("\n12. "), text, F.lit(" (Page Number: 7)===")))
        .when(k == 4, text)
        .otherwise(F.concat(F.lit("Cleaned:\n"), text, F.lit("\n23\nend 7.===")))
    )
    rows = docs.select(F.col("source").alias("book_name"), page.alias("page_number"), F.col("doc_id").alias("chunk_idx"), g.alias("generated_text"),
        F.lit("stop").alias("finish_reason"))
    elsewhere = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 1, -F.col("doc_id")).otherwise(page)
    originals = docs.select(F.col("source").alias("book_name"), elsewhere.alias("page_number"), "text", F.col("doc_id").alias("ordinal"))
    out = cleaning.clean_library(rows, originals)
    return out.select(F.col("book_name").alias("book"), F.col("page_number").alias("page"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""WITH RECURSIVE p AS (SELECT book, page_number, text, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n, row_number()
  OVER (PARTITION BY book ORDER BY page) AS r FROM ({D.PAGES})),
f AS (SELECT book, r, page_number, text, n AS s, 0 AS chunk FROM p WHERE r = 1 UNION ALL
  SELECT p.book, p.r, p.page_number, p.text, CASE WHEN f.s > 5000 THEN 0 ELSE f.s END + p.n, f.chunk + CASE WHEN f.s > 5000 THEN 1 ELSE 0 END FROM f
  JOIN p ON p.book = f.book AND p.r = f.r + 1),
g AS (SELECT book, chunk, arg_min(page_number, r) AS first_page, arg_max(page_number, r) AS end_page, count(*) AS n_pages, md5(string_agg(text, ''
  ORDER BY r)) AS digest, max(s) AS mass FROM f GROUP BY book, chunk HAVING max(s) > 0)
SELECT book, CAST(chunk AS INTEGER) AS chunk, coalesce(lag(end_page) OVER (PARTITION BY book ORDER BY chunk), first_page) AS start_page, end_page,
  n_pages, digest FROM g""")
def book_chunks(spark, d):
    p = D.pages(spark, d).select("book", F.col("page").alias("page_idx"), "page_number", "text", T.word_count(F.col("text")).alias("n_tokens"))
    return chunking.page_chunks(p, 5000).select("book", "chunk", "start_page", "end_page", "n_pages",
        F.md5(F.col("text").cast("binary")).alias("digest"))


LABELLED = rf"""SELECT book, pos, answer, CASE r WHEN '9-12+' THEN '9-12' WHEN '' THEN NULL ELSE r END AS label FROM (SELECT *, regexp_extract(answer,
  '(?m)^Age group: ?\n? *?(3-5|6-8|9-12\+?|12\+)', 1) AS r FROM ({D.VOTES}))"""


def labelled(spark, d):
    return D.votes(spark, d).withColumn("label", T.age_label(F.col("answer")))


@query(f"SELECT book, pos, label FROM ({LABELLED})")
def age_extract(spark, d):
    return labelled(spark, d).select("book", "pos", "label")


COUNTS = f"""SELECT book, count(*) FILTER (WHERE label = '3-5') AS n_0, count(*) FILTER (WHERE label = '6-8') AS n_1,
  count(*) FILTER (WHERE label = '9-12') AS n_2, count(*) FILTER (WHERE label = '12+') AS n_3 FROM ({LABELLED}) GROUP BY book"""


@query(COUNTS)
def age_votes(spark, d):
    return labels.vote_counts(labelled(spark, d))


MAJORITY = f"""SELECT book, arg_max(label, n * 10 - o) AS age_group FROM (SELECT book, label, count(*) AS n, list_position(['3-5', '6-8', '9-12',
  '12+'], label) AS o FROM ({LABELLED}) WHERE label IS NOT NULL GROUP BY book, label) GROUP BY book"""


@query(MAJORITY)
def age_majority(spark, d):
    return labels.majority(labelled(spark, d))


@query(f"""SELECT book, t AS top, ties, CASE WHEN t = 0 THEN 'none' WHEN ties = 1 THEN 'single' ELSE 'multiple' END AS kind FROM (SELECT book,
  greatest(n_0, n_1, n_2, n_3) AS t, CAST((n_0 = t)::INT + (n_1 = t)::INT + (n_2 = t)::INT + (n_3 = t)::INT AS BIGINT) AS ties FROM ({COUNTS}))""")
def vote_diagnostics(spark, d):
    return labels.diagnostics(labelled(spark, d))


def described(spark, d):
    """Documents as descriptions; labels of most books under file names; images of labelled documents."""
    docs = D.table(spark, d, "documents")
    desc = docs.select(F.col("doc_id").alias("idx"), F.col("source").alias("book_name"), F.col("doc_id").cast("string").alias("page_number"))
    votes = labels.majority(labelled(spark, d))
    book = F.when(F.col("book") == "src3", "src3-other").otherwise(F.col("book"))  # one label stands under another name
    names = votes.select(F.lit(1).alias("ordinal"), F.concat(F.lit("out/"), book, F.lit(".jsonl")).alias("book_name"), "age_group")
    images = D.table(spark, d, "labels").join(docs.select("doc_id", "source"),
        "doc_id").select(F.concat("source", F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, "/").otherwise("_"), F.col("doc_id").cast("string"),
            F.lit(".jpg")).alias("path"))
    return joins.age_join(desc, names, images)


JOINED = f"""SELECT d.doc_id AS idx, d.source AS book_name, CAST(d.doc_id AS VARCHAR) AS page_number, m.age_group, CASE WHEN m.age_group IS NULL
  THEN 'missing_label' WHEN l.doc_id IS NULL THEN 'missing_image' ELSE 'written' END AS status
FROM documents d LEFT JOIN (SELECT CASE WHEN book = 'src3' THEN 'src3-other' ELSE book END AS book, age_group FROM ({MAJORITY})) m ON m.book = d.source LEFT JOIN (SELECT DISTINCT doc_id
  FROM labels) l ON l.doc_id = d.doc_id"""


@query(f"SELECT idx, book_name, age_group FROM ({JOINED}) WHERE status = 'written'")
def age_join(spark, d):
    return described(spark, d).where("status = 'written'").select("idx", "book_name", "age_group")


@query(f"SELECT status, count(*) AS n FROM ({JOINED}) GROUP BY status")
def age_join_report(spark, d):
    return joins.reject_report(described(spark, d))


@query(f"""SELECT status, place, book_name || '/' || page_number AS example FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY idx)
  AS place FROM ({JOINED}) WHERE status <> 'written') WHERE place <= 10""")
def reject_examples(spark, d):
    return joins.first_rejects(described(spark, d))


@query("""WITH p AS (SELECT doc_id, length(text) AS n, (doc_id % 3) AS boxes FROM documents),
m AS (SELECT doc_id, CASE WHEN boxes = 0 THEN 0.0::DOUBLE ELSE boxes * (n % 40) * 10.0 END / 1000.0::DOUBLE AS text_area, (n % 200) / 400.0::DOUBLE
  AS p, ((n // 7) % 300) / 600.0::DOUBLE AS q FROM p)
SELECT doc_id, round(text_area, 6) AS text_area, text_area < 0.3 AND sqrt(p * (1 - p)) >= 0.2 AND sqrt(q * (1 - q)) >= 0.3 AS retained FROM m""")
def page_gate(spark, d):
    docs = D.table(spark, d, "documents").select("source", "doc_id", F.char_length("text").cast("bigint").alias("n"))
    page = docs.select(F.col("source").alias("book_name"), F.col("doc_id").alias("page_number"), F.lit(25.0).alias("height"),
        F.lit(40.0).alias("width"), "n")
    w = F.pmod(F.col("n"), F.lit(40)).cast("double")
    corner = lambda x, y: F.array(x, y)
    zero, ten = F.lit(0.0), F.lit(10.0)
    box = F.array(corner(zero, zero), corner(w, zero), corner(w, ten), corner(zero, ten))
    boxes = page.select("book_name", "page_number",
        F.explode(F.array_repeat(box, F.pmod(F.col("page_number"), F.lit(3)).cast("int"))).alias("bounding_box"))
    metrics = pages.text_share(page, boxes).select(F.col("page_number").alias("doc_id"), "text_area",
        (F.pmod(F.col("n"), F.lit(200)) / 400.0).alias("edge_pixels"),
            (F.pmod(F.floor(F.col("n") / 7), F.lit(300)) / 600.0).alias("masked_edge_pixels"), F.lit(1.0).alias("pixels"))
    return pages.gate(metrics).select("doc_id", F.round("text_area", 6).alias("text_area"), "retained")


@query("SELECT (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // 300 AS shard, doc_id FROM documents")
def shard_assign(spark, d):
    from quillstack.operators.ranking import hash_rank

    keyed = D.table(spark, d, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("path"))
    return hash_rank(keyed, "path", "doc_id").select(chunking.shard_of(F.col("rank"), 300).alias("shard"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_pending(spark, d):
    return joins.pending(D.table(spark, d, "documents").select("doc_id"), D.table(spark, d, "labels"), ["doc_id"])


@query("SELECT source, doc_id % 50 AS page, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def resume_duplicates(spark, d):
    return joins.duplicates(D.table(spark, d, "documents").select("source", F.pmod(F.col("doc_id"), F.lit(50)).alias("page")), ["source", "page"])


@query(f"""SELECT task, band, CAST(ti * 4 + bi AS INTEGER) AS job, CAST(coalesce(n, 0) AS BIGINT) AS n_rows FROM (SELECT unnest(['caption', 'vqa',
  'reasoning']) AS task, unnest([0, 1, 2]) AS ti), (SELECT unnest(['3_5', '6_8', '9_12', '12']) AS band, unnest([0, 1, 2, 3]) AS bi)
  LEFT JOIN (SELECT age_band AS band, count(*) AS n FROM ({D.RECORDS}) GROUP BY age_band) USING (band)""")
def gen_matrix(spark, d):
    """The twelve jobs, each with the records that it has to answer."""
    tasks = spark.createDataFrame(list(enumerate(TASKS)), "ti int, task string")
    jobs = tasks.crossJoin(spark.createDataFrame(list(enumerate(BANDS)), "bi int, band string"))
    counts = D.records(spark, d).groupBy(F.col("age_band").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(counts, "band", "left").select("task", "band", (F.col("ti") * 4 + F.col("bi")).alias("job"), F.coalesce("n", F.lit(0)).alias("n_rows"))


GRID = """SELECT o AS "order", s AS schedule, e AS epochs, k AS seed FROM (SELECT unnest(['developmental', 'antidevelopmental', 'readability',
  'perplexity', 'random']) AS o), (SELECT unnest(['staged', 'competence']) AS s), (SELECT unnest([5, 10]) AS e), (SELECT unnest([0, 1, 2]) AS k)
  WHERE o <> 'random' OR s = 'staged'
UNION ALL SELECT o, 'staged', 10, k FROM (SELECT unnest(['randomblock', 'qwenppl', 'gemmappl']) AS o), (SELECT unnest([0, 1, 2]) AS k)"""


SPEC = ["order", "schedule", "epochs", "seed"]
RUN_SPECS = f"""SELECT "order", schedule, epochs, seed, count(DISTINCT run) AS n_runs FROM ({D.RUN_SQL}) GROUP BY ALL"""


def run_specs(spark, d):
    """The specifications that the runs in the results name, and how many runs have each."""
    runs = results.parse_runs(D.runs(spark, d).select("run").distinct())
    return runs.groupBy(*SPEC).agg(F.count(F.lit(1)).alias("n_runs"))


@query(f"""SELECT "order", schedule, epochs, seed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs FROM ({GRID}) LEFT JOIN ({RUN_SPECS}) USING ("order",
  schedule, epochs, seed)""")
def order_grid(spark, d):
    """All specifications, with the runs that there are of each."""
    grid = curriculum.order_specs(spark).select(*SPEC).join(run_specs(spark, d), SPEC, "left")
    return grid.select(*SPEC, F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


@query(f"""SELECT "order", schedule, epochs, count(*) AS n_sequences, CAST(sum(CASE WHEN epochs = 10 AND schedule = 'staged' AND "order" IN ('random',
  'developmental', 'perplexity') THEN 2 ELSE 1 END) AS BIGINT) AS n_configurations, CAST(sum(coalesce(n_runs, 0)) AS BIGINT) AS n_runs
  FROM ({GRID}) LEFT JOIN ({RUN_SPECS}) USING ("order", schedule, epochs, seed) GROUP BY ALL""")
def order_coverage(spark, d):
    """How many training configurations the sequences serve: 72 over all rows; and the runs that there are of them."""
    specs = curriculum.order_specs(spark).join(run_specs(spark, d), SPEC, "left")
    return specs.groupBy("order", "schedule", "epochs").agg(F.count(F.lit(1)).alias("n_sequences"),
        F.sum(F.size("modalities")).alias("n_configurations"), F.sum(F.coalesce("n_runs", F.lit(0))).alias("n_runs"))


@query(f"""SELECT coalesce(a."order", b."order") AS "order", coalesce(a.schedule, b.schedule) AS schedule, coalesce(a.epochs, b.epochs) AS epochs,
  coalesce(a.seed, b.seed) AS seed, CASE WHEN b."order" IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM ({GRID}) a FULL JOIN ({RUN_SPECS}) b
  ON a."order" = b."order" AND a.schedule = b.schedule AND a.epochs = b.epochs AND a.seed = b.seed WHERE a."order" IS NULL OR b."order" IS NULL""")
def grid_reconcile(spark, d):
    """Specifications that no run has, and runs that are of none."""
    return joins.reconcile(curriculum.order_specs(spark), run_specs(spark, d), SPEC)


@query("SELECT doc_id FROM documents WHERE NOT contains(text, 'the thnt') AND NOT contains(text, 'xyz')")
def error_filter(spark, d):
    return D.table(spark, d, "documents").where(~T.contains_any(F.col("text"), ("the thnt", "xyz"))).select("doc_id")


CUTS = ("that on", "IS THE", "of a")
CUT_SQL = "{0}"
for _p in ("that on", "is the", "of a"):
    CUT_SQL = f"regexp_split_to_array({CUT_SQL}, '(?i){_p}')[1]"


@query(f"SELECT doc_id, md5({CUT_SQL.format('text')}) AS digest FROM documents")
def pattern_truncate(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.md5(T.truncate_at(F.col("text"), CUTS).cast("binary")).alias("digest"))


INSTRUCTIONS = ("Describe the image.\n<image>", "<image>\nTell what you see.", "Summarize.\n<image>")
UNIT = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


@query(rf"""WITH g AS (SELECT source || '_' || CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 4 WHEN 0
  THEN text || chr(10) || '===' || chr(10) || 'more' WHEN 1 THEN text || chr(10) || 'orange ' || text WHEN 2 THEN text || '======---'
  ELSE ' ===' || text END || CASE WHEN doc_id % 6 = 1 THEN ' I HOPE THIS helps. ' || text ELSE '' END || CASE WHEN doc_id % 9 = 0
  THEN ' ERROR: no image' ELSE '' END AS t FROM documents),
h AS (SELECT id, regexp_split_to_array(regexp_split_to_array(t, '(?i)I hope this')[1], '(?i)is the')[1] AS t FROM g WHERE NOT contains(t,
  'ERROR: no image')),
a AS (SELECT id, regexp_replace(replace(t, chr(10) || '===', ''), '^\s+|\s+$', '', 'g') AS t FROM h), b AS (SELECT id, regexp_replace(split_part(t,
  '===', 1), '^\s+|\s+$', '', 'g') AS t FROM a),
c AS (SELECT id, regexp_replace(regexp_split_to_array(t, '(?i)\n+Or')[1], '^\s+|\s+$', '', 'g') AS t FROM b), e AS (SELECT id,
  regexp_replace(regexp_replace(regexp_replace(t, '=+$', ''), '-+$', ''), '\n+$', '') AS t FROM c)
SELECT id, id || '.jpg' AS image, ['Describe the image.' || chr(10) || '<image>', '<image>' || chr(10) || 'Tell what you see.',
  'Summarize.' || chr(10) || '<image>'][{UNIT.format("'42:instruct:' || id")} % 3 + 1] AS instruction, md5(t) AS digest FROM e WHERE t <> ''""")
def caption_convert(spark, d):
    k, t, m = F.pmod(F.col("doc_id"), F.lit(4)), F.col("text"), lambda n: F.pmod(F.col("doc_id"), F.lit(n))
    g = (
        F.when(k == 0, F.concat(t, F.lit("\n===\nmore")))
        .when(k == 1, F.concat(t, F.lit("\norange "), t))
        .when(k == 2, F.concat(t, F.lit("======---")))
        .otherwise(F.concat(F.lit(" ==="), t))
    )
    tail = F.when(m(6) == 1, F.concat(F.lit(" I HOPE THIS helps. "), t)).otherwise("")
    error = F.when(m(9) == 0, " ERROR: no image").otherwise("")
    rows = D.table(spark, d, "documents").select(F.col("source").alias("book_name"), F.col("doc_id").cast("string").alias("page_number"),
        F.concat(g, tail, error).alias("generated_text"))
    out = convert.caption_records(rows, ("I hope this", "is the"), ("ERROR: no image",), INSTRUCTIONS)
    return out.select("id", "image", "instruction", F.md5(F.col("caption").cast("binary")).alias("digest"))


DIALOGUE = """SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Child: ' WHEN 'assistant' THEN 'AI: ' ELSE 'Note ' END || text || CASE
  WHEN turn % 7 = 2 THEN ' of The Description' ELSE '' END
  || CASE WHEN turn % 3 = 1 THEN chr(10) || '===' || chr(10) || chr(10) WHEN turn % 3 = 2 THEN chr(10) || '===' || chr(10) ELSE chr(10) END, ''
  ORDER BY turn, role, text)
  || CASE WHEN conv_id % 6 = 1 THEN 'STOP HERE Child: x AI: y' ELSE '' END || CASE WHEN conv_id % 11 = 0 THEN 'ERR!' ELSE '' END AS t
  FROM conversations GROUP BY conv_id"""


def dialogue_texts(spark, d):
    mark = F.when(F.col("role") == "user", "Child: ").when(F.col("role") == "assistant", "AI: ").otherwise("Note ")
    m = lambda c, n: F.pmod(F.col(c), F.lit(n))
    end = F.when(m("turn", 3) == 1, "\n===\n\n").when(m("turn", 3) == 2, "\n===\n").otherwise("\n")
    said = F.concat(mark, "text", F.when(m("turn", 7) == 2, " of The Description").otherwise(""), end)
    turns = D.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", said.alias("said"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "said"))), lambda x: x["said"])
    whole = F.concat("t", F.when(m("conv_id", 6) == 1, "STOP HERE Child: x AI: y").otherwise(""), F.when(m("conv_id", 11) == 0, "ERR!").otherwise(""))
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "").alias("t")).withColumn("t", whole)


@query(rf"""WITH h AS (SELECT conv_id, replace(replace(regexp_split_to_array(t, '(?i)stop here')[1], chr(10) || '===' || chr(10) || chr(10), ' '),
  chr(10) || '===' || chr(10), chr(10)) AS t FROM ({DIALOGUE}) WHERE NOT contains(t, 'ERR!')),
s AS (SELECT conv_id, regexp_split_to_array(t, '(?i)Individual: |Assistant: |Child: |AI: ') AS a FROM h),
n AS (SELECT conv_id, a, (len(a) - 1) // 2 AS k FROM s), p AS (SELECT conv_id, unnest(range(0, k)) AS i, a FROM n),
q AS (SELECT conv_id, i, replace(regexp_replace(a[2 * i + 2], '^\s+|\s+$', '', 'g'), chr(10) || '===', '') AS u0,
  regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(a[2 * i + 3], '^\s+|\s+$', '', 'g'), chr(10) || '===', ''), '=+$', ''), '-+$',
  ''), '\n+$', '') AS v FROM p),
r AS (SELECT conv_id, i, CASE WHEN i = 0 AND NOT contains(u0, '<image>') THEN CASE
  WHEN {UNIT.format("'42:image:b_' || CAST(conv_id AS VARCHAR)")} % 2 = 0 THEN '<image>' || chr(10) || u0 ELSE u0 || chr(10) || '<image>' END
  ELSE u0 END AS u, v FROM q),
w AS (SELECT conv_id, i, u, v, sum(len(regexp_extract_all(u, '\S+')) + len(regexp_extract_all(v, '\S+'))) OVER (PARTITION BY conv_id ORDER BY i) AS c
  FROM r WHERE NOT contains(lower(u), 'the description') AND NOT contains(lower(v), 'the description'))
SELECT 'b_' || CAST(conv_id AS VARCHAR) AS id, count(*) FILTER (WHERE c <= 60) AS n_pairs, md5(coalesce(string_agg(u || '|' || v, '#'
  ORDER BY i) FILTER (WHERE c <= 60), '')) AS digest FROM w GROUP BY conv_id""")
def dialogue_convert(spark, d):
    rows = dialogue_texts(spark, d).select(F.lit("b").alias("book_name"), F.col("conv_id").cast("string").alias("page_number"),
        F.col("t").alias("generated_text"))
    out = convert.dialogue_records(rows, ("Stop here",), ("ERR!",), budget=60)
    return out.select("id", F.size("turns").cast("bigint").alias("n_pairs"),
        F.md5(F.array_join(F.transform("turns", lambda p: F.concat_ws("|", p["user"], p["assistant"])), "#").cast("binary")).alias("digest"))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_questions, count(*) FILTER (WHERE role = 'assistant') AS n_answers,
  count(*) FILTER (WHERE role = 'assistant') > count(*) FILTER (WHERE role = 'user') AS more_answers
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') <> count(*) FILTER (WHERE role = 'assistant')""")
def qa_mismatch(spark, d):
    return convert.qa_mismatch(D.table(spark, d, "conversations"), "conv_id", "role", "user", "assistant")


FK = r"""floor((0.39::DOUBLE * greatest(1, len(regexp_extract_all({0}, '\S+'))) / greatest(1, len(regexp_extract_all({0}, '[.!?]+'))) + 11.8::DOUBLE * len(regexp_extract_all(lower({0}), '[aeiouy]+')) / greatest(1, len(regexp_extract_all({0}, '\S+'))) - 15.59::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000"""
MANIFEST = r"""SELECT id, ['3_5', '6_8', '9_12', '12'][conv_id % 4 + 1] AS age_band, joined, CAST(len(regexp_extract_all(joined, '\S+')) AS BIGINT)
  AS n_words FROM (
SELECT conv_id, 'c' || CAST(conv_id AS VARCHAR) AS id, string_agg(u || ' ' || v, ' ' ORDER BY turn) AS joined, bool_and(u <> '' AND v <> '') AS sound
  FROM (
  SELECT a.conv_id, a.turn, regexp_replace(a.t, '^\s+|\s+$', '', 'g') AS u, regexp_replace(b.t, '^\s+|\s+$', '', 'g') AS v
  FROM (SELECT conv_id, turn, min(text) AS t FROM conversations WHERE role = 'user' GROUP BY ALL) a JOIN (SELECT conv_id, turn, min(text) AS t
  FROM conversations WHERE role = 'assistant' GROUP BY ALL) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) GROUP BY conv_id) WHERE sound"""


def manifest_rows(spark, d):
    said = D.table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("t"))
    user = said.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("<image>\n"), "t").alias("u"))
    reply = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("v"))
    pairs = user.join(reply, ["conv_id", "turn"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "u", "v"))).alias("p"))
    turns = F.transform("p", lambda x: F.struct(x["u"].alias("user"), x["v"].alias("assistant")))
    band = F.element_at(T.lit_array(BANDS), (F.pmod(F.col("conv_id"), F.lit(4)) + 1).cast("int"))
    rows = pairs.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("x.jpg").alias("image"), F.lit("vqa").alias("task"),
        band.alias("age_band"), turns.alias("turns"))
    return manifest.manifest(rows)


@query(f"SELECT id, age_band, n_words, {FK.format('joined')} AS fk_grade FROM ({MANIFEST})")
def manifest_build(spark, d):
    return manifest_rows(spark, d).select("id", "age_band", "n_words", "fk_grade")


@query(f"""SELECT b.age_band, count(m.id) AS n_samples, CAST(coalesce(sum(n_words), 0) AS BIGINT) AS words FROM (SELECT unnest(['3_5', '6_8', '9_12',
  '12']) AS age_band) b LEFT JOIN ({MANIFEST}) m USING (age_band) GROUP BY b.age_band""")
def band_words(spark, d):
    return manifest.band_words(manifest_rows(spark, d))


@query(f"SELECT doc_id, {FK.format('text')} AS fk_grade FROM documents")
def fk_grade(spark, d):
    return D.table(spark, d, "documents").select("doc_id", T.fk_grade(F.col("text")).alias("fk_grade"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT w, count(*) AS c FROM w
  GROUP BY w), n AS (SELECT count(*) AS n FROM w),
s AS (SELECT doc_id, avg(-ln(c / n)) AS nll, count(*) AS n_tokens FROM w JOIN c USING (w), n GROUP BY doc_id) SELECT doc_id, round(coalesce(nll, 0.0),
  6) AS nll, coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN s USING (doc_id)""")
def unigram_nll(spark, d):
    return scores.unigram_nll(D.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id",
        F.round("nll", 6).alias("nll"), "n_tokens")


@query(f"SELECT idx, nll, nll_qwen AS nll_alt FROM ({D.RECORDS})")
def merge_scores(spark, d):
    r = D.records(spark, d)
    base = r.select(F.col("idx").alias("manifest_index"), "image", "nll")
    other = r.select(F.col("idx").alias("manifest_index"), "image", F.col("nll_qwen").alias("nll"))
    return joins.merge_scores(base, other, "alt").select(F.col("manifest_index").alias("idx"), "nll", "nll_alt")


RANKS = f"""SELECT row_number() OVER (ORDER BY nll, md5(CAST(idx AS VARCHAR)), idx) - 1 AS ra, row_number() OVER (ORDER BY nll_gemma, md5(CAST(idx
  AS VARCHAR)), idx) - 1 AS rb, count(*) OVER () AS n FROM ({D.RECORDS})"""


@query(f"SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM ({RANKS})")
def teacher_spearman(spark, d):
    return scores.spearman(D.records(spark, d), "idx", "nll", "nll_gemma").select(F.round("rho", 6).alias("rho"), "n")


@query(f"""SELECT round(count(*) FILTER (WHERE ra < n // 4 AND rb < n // 4) / max(n // 4), 6) AS lowest, round(count(*) FILTER (WHERE ra >= n - n // 4
  AND rb >= n - n // 4) / max(n // 4), 6) AS highest FROM ({RANKS})""")
def quartile_overlap(spark, d):
    return scores.quartile_overlap(D.records(spark, d), "idx", "nll", "nll_gemma").select(F.round("lowest", 6).alias("lowest"),
        F.round("highest", 6).alias("highest"))


@query(f"SELECT age_band, round(avg(nll), 6) AS mean_a, round(avg(nll_gemma), 6) AS mean_b, count(*) AS n FROM ({D.RECORDS}) GROUP BY age_band")
def band_means(spark, d):
    return scores.band_means(D.records(spark, d), "nll", "nll_gemma").select("age_band", F.round("mean_a", 6).alias("mean_a"),
        F.round("mean_b", 6).alias("mean_b"), "n")


KEY = "md5('{0}:' || CAST({1} AS VARCHAR) || ':' || id)"
SPLIT = f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {KEY.format(42, 0)}, id) - 1 < floor(0.02 * count(*) OVER ()) THEN 'validation'
  ELSE 'train' END AS split FROM ({D.RECORDS})"""


@query(f"SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS split_index FROM ({SPLIT})")
def split_train_val(spark, d):
    return curriculum.split_records(D.records(spark, d)).select("id", "split", "split_index")


@query(f"""SELECT id, idx AS manifest_index, task || '_' || age_band AS annotation_file, split, row_number() OVER (PARTITION BY split
  ORDER BY idx) - 1 AS split_index FROM ({SPLIT})""")
def sample_mapping(spark, d):
    r = D.records(spark, d)
    place = r.select("id", F.concat_ws("_", "task", "age_band").alias("annotation_file"))
    return curriculum.split_records(r).select("id", "idx", "split", "split_index").join(place, "id").select("id",
        F.col("idx").alias("manifest_index"), "annotation_file", "split", "split_index")


def stage_sql(score: str) -> str:
    return f"""SELECT *, CAST(ntile(4) OVER (ORDER BY {score}, {KEY.format(0, "'tie0'")}, id) AS INTEGER) AS stage FROM ({D.RECORDS})"""


BAND_STAGE = f"SELECT *, CAST(list_position(['3_5', '6_8', '9_12', '12'], age_band) AS INTEGER) AS stage FROM ({D.RECORDS})"


@query(f"SELECT id, stage FROM ({stage_sql('nll')})")
def stage_assign(spark, d):
    return curriculum.stages(D.records(spark, d), "perplexity", 0).select("id", "stage")


@query(f"SELECT id, stage FROM ({BAND_STAGE})")
def stage_assign_bands(spark, d):
    return curriculum.stages(D.records(spark, d), "developmental", 0).select("id", "stage")


EPOCHS = 5


def order_sql(staged: str, epochs: int = EPOCHS, seed: int = 0) -> str:
    return f"""SELECT CAST(e * count(*) OVER (PARTITION BY e) + row_number() OVER (PARTITION BY e ORDER BY stage, {KEY.format(seed, 'e')}, id) - 1
  AS BIGINT) AS position, idx AS sample_index FROM ({staged}), (SELECT unnest(range(0, {epochs})) AS e)"""


RANDOM = order_sql(f"SELECT *, 1 AS stage FROM ({D.RECORDS})")
#: Rows tied at a stage's edge fall anew in every epoch.
STAGED = f"""SELECT CAST(e * count(*) OVER (PARTITION BY e) + row_number() OVER (PARTITION BY e ORDER BY stage, {KEY.format(0, "e")}, id) - 1
  AS BIGINT) AS position, idx AS sample_index FROM (
  SELECT *, ntile(4) OVER (PARTITION BY e ORDER BY nll, {KEY.format(0, "'tie' || e")}, id) AS stage FROM ({D.RECORDS}), (SELECT unnest(range(0,
  {EPOCHS})) AS e))"""


@query(RANDOM)
def order_random(spark, d):
    return curriculum.build_order(D.records(spark, d), "random", None, EPOCHS, 0)


@query(STAGED)
def order_staged(spark, d):
    return curriculum.build_order(D.records(spark, d), "perplexity", "staged", EPOCHS, 0)


@query(order_sql(f"SELECT *, 5 - stage AS stage2 FROM ({BAND_STAGE})").replace("ORDER BY stage,", "ORDER BY stage2,"))
def order_antidevelopmental(spark, d):
    return curriculum.build_order(D.records(spark, d), "antidevelopmental", "staged", EPOCHS, 0)


@query(order_sql(f"""SELECT * EXCLUDE (cum), 1 + (m1 <= cum)::INT + (m1 + m2 <= cum)::INT + (m1 + m2 + m3 <= cum)::INT AS stage FROM (
  SELECT *, sum(t) OVER (ORDER BY {KEY.format(0, -1)}, id) AS cum, coalesce(sum(t) FILTER (WHERE age_band = '3_5') OVER (), 0) AS m1,
  coalesce(sum(t) FILTER (WHERE age_band = '6_8') OVER (), 0) AS m2, coalesce(sum(t) FILTER (WHERE age_band = '9_12') OVER (), 0) AS m3
  FROM (SELECT *, CASE WHEN n_tokens = 0 THEN CAST(floor(n_words * 1.35) AS BIGINT) ELSE n_tokens END AS t FROM ({D.RECORDS})))"""))
def order_randomblock(spark, d):
    return curriculum.build_order(D.records(spark, d), "randomblock", "staged", EPOCHS, 0)


COMPETENCE = f"""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT idx, row_number() OVER (ORDER BY nll, {KEY.format(0, -1)}, id) - 1
  AS rank FROM ({D.RECORDS})),
t AS (SELECT unnest(range(0, n * {EPOCHS})) AS t, n FROM n), dr AS (SELECT t,
  CAST(floor({UNIT.format("'0:draw:' || CAST(t AS VARCHAR)")} / 4294967296.0::DOUBLE * greatest(floor(n * sqrt(t::DOUBLE / (n * {EPOCHS}) * (1 - 0.1::DOUBLE * 0.1::DOUBLE) + 0.1::DOUBLE * 0.1::DOUBLE)), 1)) AS BIGINT) AS rank FROM t)
SELECT t AS position, idx AS sample_index FROM dr JOIN r USING (rank)"""


@query(COMPETENCE)
def order_competence(spark, d):
    return curriculum.build_order(D.records(spark, d), "perplexity", "competence", EPOCHS, 0)


def staged(spark, d):
    r = D.records(spark, d)
    return r, curriculum.build_order(r, "perplexity", "staged", EPOCHS, 0)


@query(f"""SELECT part, round(avg(list_position(['3_5', '6_8', '9_12', '12'], age_band) - 1), 3) AS mean_band FROM (SELECT CAST(ntile(10)
  OVER (ORDER BY position) AS INTEGER) AS part, age_band FROM ({STAGED}) o JOIN ({D.RECORDS}) r ON r.idx = o.sample_index) GROUP BY part""")
def order_summary(spark, d):
    r, o = staged(spark, d)
    return curriculum.summarize(o, r, r.count() * EPOCHS)


@query(f"""WITH o AS ({COMPETENCE}), k AS (SELECT idx, count(o.position) AS k FROM (SELECT doc_id AS idx FROM documents) r LEFT
  JOIN o ON o.sample_index = r.idx GROUP BY idx)
SELECT CAST(sum(k) AS BIGINT) AS draws, count(*) FILTER (WHERE k > 0) AS unique_samples, count(*) FILTER (WHERE k = 0) AS omitted,
  count(*) FILTER (WHERE k > 1) AS repeated, min(k) AS min_exposure, max(k) AS max_exposure FROM k""")
def exposure(spark, d):
    r = D.records(spark, d)
    return curriculum.exposure(curriculum.build_order(r, "perplexity", "competence", EPOCHS, 0), r.count())


#: A sequence with numbers out of range, samples twice in an epoch and draws beyond its length.
UNSOUND = f"""SELECT position, CASE WHEN position % 97 = 5 THEN sample_index + 1 WHEN position % 101 = 7 THEN -1 ELSE sample_index END AS sample_index
  FROM ({RANDOM})
UNION ALL SELECT position + {EPOCHS} * (SELECT count(*) FROM documents), sample_index FROM ({RANDOM}) WHERE sample_index < 3"""


@query(f"""WITH o AS ({UNSOUND}), n AS (SELECT count(*) AS n FROM documents)
SELECT * FROM (SELECT 'range' AS rule, count(*) FILTER (WHERE sample_index < 0 OR sample_index >= n) AS n FROM o, n
UNION ALL SELECT 'length', abs(count(*) - max(n) * {EPOCHS}) FROM o, n
UNION ALL SELECT 'permutation', count(*) FROM (SELECT position // n AS e, sample_index FROM o, n GROUP BY ALL HAVING count(*) > 1)) WHERE n > 0""")
def validate_sequence(spark, d):
    r = D.records(spark, d)
    n, o, at = r.count(), curriculum.build_order(r, "random", None, EPOCHS, 0), F.col("position")
    drawn = F.when(F.pmod(at, F.lit(97)) == 5, F.col("sample_index") + 1).when(F.pmod(at, F.lit(101)) == 7, -1).otherwise(F.col("sample_index"))
    broken = o.select("position",
        drawn.alias("sample_index")).unionByName(o.where("sample_index < 3").select((at + n * EPOCHS).alias("position"), "sample_index"))
    return curriculum.sequence_violations(broken, n, EPOCHS, True)


@query(f"SELECT position, sample_index FROM ({STAGED}) WHERE position % 4 = 1")
def rank_shard(spark, d):
    return curriculum.shard(staged(spark, d)[1], 1, 4)


@query(f"""SELECT s AS total_tokens, CAST(greatest(floor(0.97::DOUBLE * s / 4096), 1) AS BIGINT) AS steps FROM (SELECT CAST(sum({EPOCHS} * (CASE
  WHEN n_tokens = 0 THEN CAST(floor(n_words * 1.35) AS BIGINT) ELSE n_tokens END + 210 + 20)) AS BIGINT) AS s FROM ({D.RECORDS}))""")
def step_budget(spark, d):
    r, o = staged(spark, d)
    return curriculum.step_budget(o, r, 210, 4096)


@query(f"SELECT position, r.id, r.age_band FROM ({STAGED}) o JOIN ({D.RECORDS}) r ON r.idx = o.sample_index")
def ordered_view(spark, d):
    r, o = staged(spark, d)
    return curriculum.ordered_view(o, r).select("position", "id", "age_band")


BROKEN = f"""SELECT CASE WHEN idx % 11 = 0 THEN 'same' ELSE id END AS id, CASE WHEN idx % 13 = 0 THEN 'song' ELSE task END AS task, age_band,
  fk_grade, CASE WHEN idx % 17 = 0 THEN -1.0 ELSE nll END AS nll, n_words, n_tokens FROM ({D.RECORDS})"""


@query(f"""SELECT id, 'task' AS rule FROM ({BROKEN}) WHERE task = 'song' UNION ALL SELECT id, 'nll' FROM ({BROKEN}) WHERE nll < 0 UNION ALL SELECT id,
  'n_words' FROM ({BROKEN}) WHERE n_words <= 0 UNION ALL SELECT id, 'n_tokens' FROM ({BROKEN}) WHERE n_tokens <= 0
UNION ALL SELECT id, 'duplicate' FROM ({BROKEN}) GROUP BY id HAVING count(*) > 1""")
def validate_records(spark, d):
    m = lambda k: F.pmod(F.col("idx"), F.lit(k)) == 0
    r = D.records(spark, d).select(F.when(m(11), "same").otherwise(F.col("id")).alias("id"),
        F.when(m(13), "song").otherwise(F.col("task")).alias("task"), "age_band", "fk_grade",
            F.when(m(17), -1.0).otherwise(F.col("nll")).alias("nll"), "n_words", "n_tokens")
    return validate.record_violations(r, ("fk_grade", "nll"))


@query(f"""WITH a AS (SELECT CASE WHEN idx % 5 = 0 THEN 'other_' || id ELSE id END AS id, CASE WHEN idx % 7 = 0 THEN n_words + 1 ELSE n_words END
  AS n_words, image, CASE WHEN idx % 11 = 0 THEN 'vqa' ELSE task END AS task FROM ({D.RECORDS})), m AS (SELECT id, n_words, image, task
  FROM ({D.RECORDS}))
SELECT coalesce(a.id, m.id) AS id, CASE WHEN m.id IS NULL THEN 'unexpected' WHEN a.id IS NULL THEN 'missing' WHEN a.task <> m.task
  THEN 'task mismatch' ELSE 'n_words mismatch' END AS reason FROM a FULL JOIN m ON a.id = m.id WHERE a.id IS NULL OR m.id IS NULL
  OR a.n_words <> m.n_words OR a.task <> m.task""")
def annotation_diff(spark, d):
    r, m = D.records(spark, d), lambda k: F.pmod(F.col("idx"), F.lit(k)) == 0
    other = F.when(m(5), F.concat(F.lit("other_"), "id")).otherwise(F.col("id"))
    a = r.withColumns({"n_words": F.col("n_words") + m(7).cast("bigint"), "task": F.when(m(11), "vqa").otherwise(F.col("task")), "id": other})
    return validate.annotation_diff(a, r, ["image", "task", "n_words"])


@query(f"""SELECT id, position, manifest_index FROM (SELECT id, CASE WHEN idx % 20 = 3 THEN idx + 1 WHEN idx % 20 = 4 THEN idx - 1 ELSE idx END
  AS position, idx AS manifest_index FROM ({D.RECORDS})) WHERE position <> manifest_index""")
def annotation_order(spark, d):
    """Neighbours that have changed places."""
    r, m = D.records(spark, d), F.pmod(F.col("idx"), F.lit(20))
    a = r.select("id", (F.col("idx") + F.when(m == 3, 1).when(m == 4, -1).otherwise(0)).alias("position"))
    return artifacts.order_violations(a, r.select("id", F.col("idx").alias("manifest_index")))


@query(f"""WITH s AS ({SPLIT}), p AS (SELECT CASE WHEN split = 'train' AND idx % 50 = 0 THEN 'other_' || id ELSE id END AS id FROM s
  UNION ALL SELECT id FROM s WHERE split = 'train' AND idx % 30 = 7)
SELECT coalesce(r.id, p.id) AS id, CASE WHEN r.id IS NULL THEN -count(p.id) ELSE count(p.id) END AS n FROM ({D.RECORDS}) r FULL JOIN p ON r.id = p.id
  GROUP BY r.id, p.id HAVING r.id IS NULL OR count(p.id) <> 1""")
def split_check(spark, d):
    """Records that a broken split has under other names or twice, and ids that are no records."""
    parts = curriculum.split_records(D.records(spark, d))
    m = lambda k: F.pmod(F.col("idx"), F.lit(k))
    in_train = F.col("split") == "train"
    named = parts.withColumn("id", F.when(in_train & (m(50) == 0), F.concat(F.lit("other_"), "id")).otherwise(F.col("id")))
    train = named.where(in_train)
    validation = named.where(~in_train).select("id").unionByName(parts.where(in_train & (m(30) == 7)).select("id"))
    return artifacts.split_violations(D.records(spark, d), {"train": train, "validation": validation})


@query(f"""SELECT split, count(*) AS actual, CAST(CASE split WHEN 'train' THEN 126247 ELSE 2576 END AS BIGINT) AS expected FROM ({SPLIT})
  GROUP BY split""")
def split_counts(spark, d):
    """The released sizes against those of these tables."""
    expected = spark.createDataFrame([("train", 126247), ("validation", 2576)], "split string, n bigint")
    return artifacts.count_violations(curriculum.split_records(D.records(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n")), expected,
        "split")


@query(f"""SELECT DISTINCT run, "order", schedule, epochs, lm_init, modality, seed, run_id FROM ({D.RUN_SQL})""")
def run_parse(spark, d):
    return results.parse_runs(D.runs(spark, d).select("run").distinct())


@query(f"SELECT DISTINCT run FROM ({D.RUNS})")
def run_format(spark, d):
    r = results.parse_runs(D.runs(spark, d).select("run").distinct())
    return r.select(results.run_name(*(F.col(c) for c in results.RUN_FIELDS)).alias("run"))


@query(f"""SELECT 'ep' || epochs || '/' || lm_init || 'lm/' || modality || '/' || "order" || '/' || schedule AS condition, task, round(avg(score), 6)
  AS mean, round(coalesce(stddev_samp(score), 0.0), 6) AS sd, count(*) AS n FROM ({D.RUN_SQL}) GROUP BY ALL""")
def collect_scores(spark, d):
    r = results.parse_runs(D.runs(spark, d)).withColumn("condition", results.condition_label())
    return results.mean_sd(r, ["condition", "task"], "score").select("condition", "task", F.round("mean", 6).alias("mean"),
        F.round("sd", 6).alias("sd"), "n")


@query(f"""SELECT "order", schedule, round(avg(score) FILTER (WHERE task = 'blimp'), 6) AS blimp, round(avg(score) FILTER (WHERE task = 'ewok'), 6)
  AS ewok, round(avg(score) FILTER (WHERE task = 'absent'), 6) AS absent FROM ({D.RUN_SQL}) WHERE epochs = 10 GROUP BY ALL""")
def collect_pivot(spark, d):
    r = results.filter_runs(results.parse_runs(D.runs(spark, d)), epochs=10)
    tasks = ("blimp", "ewok", "absent")
    return results.pivot_means(r, ["order", "schedule"], "task", tasks, "score").select("order", "schedule", *(F.round(t, 6).alias(t) for t in tasks))


@query(f"""SELECT run, task, count(*) AS n, min(path) AS first, (array_agg(path ORDER BY path))[2] AS second FROM ({D.RUNS})
  GROUP BY ALL HAVING count(*) > 1""")
def duplicate_runs(spark, d):
    return results.duplicate_pairs(D.runs(spark, d), ["run", "task"])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run, task ORDER BY event_id) AS p FROM ({D.RUNS}))
SELECT a.run, a.task, a.n, 'f:' || a.first AS first, 'f:' || b.event_id AS again FROM (SELECT run, task, count(*) AS n, min(event_id) AS first FROM r
  GROUP BY ALL HAVING count(*) > 1) a JOIN r b ON a.run = b.run AND a.task = b.task AND b.p = 2""")
def repeated_keys(spark, d):
    lines = D.runs(spark, d).select("run", "task", F.lit("f").alias("file"), F.col("event_id").alias("line"))
    return artifacts.repeated_keys(lines, ["run", "task"])


FULL_TASKS = f"""SELECT *, ['blimp/blimp_filtered', 'blimp/supplement_filtered', 'ewok/ewok_filtered', 'entity_tracking/entity_tracking',
  'comps/comps', 'other/other'][event_id % 6 + 1] AS full_task FROM ({D.RUN_SQL})"""


def full_tasks(spark, d):
    tasks = T.lit_array((*results.REPORTED, "other/other"))
    return results.parse_runs(D.runs(spark, d)).withColumn("full_task", F.element_at(tasks, (F.pmod(F.col("event_id"), F.lit(6)) + 1).cast("int")))


@query(f"""SELECT CASE WHEN full_task = 'blimp/supplement_filtered' THEN 'supplement' ELSE split_part(full_task, '/', 1) END AS label,
  CAST(min(event_id % 6) + 1 AS INTEGER) AS task_order, round(avg(score), 6) AS mean, count(*) AS n FROM ({FULL_TASKS})
  WHERE full_task <> 'other/other' GROUP BY ALL""")
def task_report(spark, d):
    """Reported tasks alone, under their short labels, in the report's order."""
    shown = results.text_tasks(full_tasks(spark, d), "full_task")
    return shown.groupBy("label", "task_order").agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


PANEL_ORDERS = f"""SELECT *, CASE WHEN "order" = 'readability' THEN 'randomblock' ELSE "order" END AS o FROM ({D.RUN_SQL})"""


@query(f"""WITH p AS (SELECT o AS "order", schedule, score, unnest(CASE WHEN o = 'random' THEN ['staged', 'competence'] ELSE [schedule] END) AS panel
  FROM ({PANEL_ORDERS}) WHERE o NOT IN ('random', 'randomblock') OR schedule = 'staged')
SELECT panel, CASE "order" WHEN 'random' THEN 'random' WHEN 'randomblock' THEN 'random-block' ELSE "order" || '/' || substr(schedule, 1, 4) END
  AS label, round(avg(score), 6) AS mean, count(*) AS n FROM p GROUP BY ALL""")
def order_panels(spark, d):
    runs = results.parse_runs(D.runs(spark, d)).withColumn("order", F.when(F.col("order") == "readability", "randomblock").otherwise(F.col("order")))
    shown = results.panels(runs).withColumn("label", results.order_label())
    return shown.groupBy("panel", "label").agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT epochs, "order", schedule, avg(score) AS mean FROM ({D.RUN_SQL}) GROUP BY ALL), b AS (SELECT epochs, avg(score)
  AS baseline FROM ({D.RUN_SQL}) WHERE "order" = 'random' GROUP BY epochs)
SELECT epochs, "order", schedule, round(mean, 6) AS mean, round(baseline, 6) AS baseline FROM m LEFT JOIN b USING (epochs)""")
def random_baseline(spark, d):
    out = results.against_random(results.parse_runs(D.runs(spark, d)), "score")
    return out.select("epochs", "order", "schedule", F.round("mean", 6).alias("mean"), F.round("baseline", 6).alias("baseline"))


@query(f"""SELECT "order", schedule, CAST(replace(step_name, 'step_', '') AS BIGINT) AS step, task, round(avg(score), 6) AS mean,
  round(coalesce(stddev_samp(score), 0.0), 6) AS sd, count(*) AS n FROM ({D.RUN_SQL}) GROUP BY ALL""")
def trajectory(spark, d):
    r = results.parse_runs(D.runs(spark, d)).withColumn("step", results.step_number(F.col("step_name")))
    return results.mean_sd(r, ["order", "schedule", "step", "task"], "score").select("order", "schedule", "step", "task",
        F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"""SELECT run, max('c/' || lpad(replace(step_name, 'step_', ''), 6, '0')) AS path, max(CAST(replace(step_name, 'step_', '') AS BIGINT))
  AS step FROM ({D.RUNS}) GROUP BY run""")
def latest_checkpoint(spark, d):
    r = D.runs(spark, d).withColumn("step", results.step_number(F.col("step_name")))
    return results.latest(r.withColumn("path", F.concat(F.lit("c/"), F.lpad(F.col("step").cast("string"), 6, "0"))), ["run"], "path", "step")


@query(f"""SELECT "order", schedule, round(avg(score), 6) AS mean, CAST(row_number() OVER (ORDER BY round(avg(score), 6) DESC, "order", schedule)
  AS INTEGER) AS place FROM ({D.RUN_SQL}) WHERE epochs = 10 GROUP BY "order", schedule""")
def condition_rank(spark, d):
    r = results.filter_runs(results.parse_runs(D.runs(spark, d)), epochs=10).groupBy("order",
        "schedule").agg(F.round(F.avg("score"), 6).alias("mean"))
    return ordered_rank(r, [-F.col("mean"), F.col("order"), F.col("schedule")], "place").select("order", "schedule", "mean",
        (F.col("place") + 1).cast("int").alias("place"))


AUDIT = rf"""WITH v AS (SELECT book, pos, CASE WHEN r = '' THEN 'unparsed' ELSE r END AS label FROM (SELECT *, regexp_extract(answer,
  '(12\+|9-12|6-8|3-5|9\+)', 1) AS r FROM ({D.SECOND_VOTES}))),
p AS (SELECT book, arg_max(label, n * 1000000000 - first) AS pred FROM (SELECT book, label, count(*) AS n, min(pos) AS first FROM v GROUP BY ALL)
  GROUP BY book), j AS (SELECT p.book, pred, age_group AS gold FROM p LEFT JOIN ({MAJORITY}) m USING (book))"""


def audited(spark, d):
    v = D.second_votes(spark, d).withColumn("label", T.audit_label(F.col("answer")))
    return labels.first_majority(v, "book", "label", "pos").join(labels.majority(labelled(spark, d)).withColumnRenamed("age_group", "gold"), "book",
        "left")


CANON = "('3-5', '6-8', '9-12', '12+')"
ORD = "list_position(['3-5', '6-8', '9-12', '12+'], {0})"


@query(f"""{AUDIT} SELECT count(*) AS n, round(avg((gold = pred)::INT), 6) AS exact,
  round(avg((abs({ORD.format('gold')} - {ORD.format('pred')}) <= 1)::INT), 6) AS adjacent FROM j WHERE gold IN {CANON} AND pred IN {CANON}""")
def audit_agreement(spark, d):
    return labels.agreement(audited(spark, d)).select("n", F.round("exact", 6).alias("exact"), F.round("adjacent", 6).alias("adjacent"))


@query(f"""{AUDIT} SELECT gold, count(*) FILTER (WHERE pred = '3-5') AS pred_0, count(*) FILTER (WHERE pred = '6-8') AS pred_1,
  count(*) FILTER (WHERE pred = '9-12') AS pred_2, count(*) FILTER (WHERE pred = '12+') AS pred_3 FROM j WHERE gold IN {CANON} AND pred IN {CANON}
  GROUP BY gold""")
def audit_confusion(spark, d):
    return labels.confusion(audited(spark, d))


@query(f"{AUDIT} SELECT pred, count(*) AS count FROM j WHERE pred NOT IN {CANON} GROUP BY pred")
def audit_odd(spark, d):
    return labels.odd_predictions(audited(spark, d))


@query("SELECT item_id, md5('q ' || text || '|q ' || reverse(text) || '|q none') AS digest, CAST(3 AS INTEGER) AS n FROM benchmark")
def completion_items(spark, d):
    c = results.candidates(F.lit("q"), F.col("text"), F.array(F.reverse("text"), F.lit("none")))
    return D.table(spark, d, "benchmark").select("item_id", F.md5(F.array_join(c, "|").cast("binary")).alias("digest"), F.size(c).alias("n"))


@query("""SELECT event_type, user_id, arg_max(t, floor(value) * 1000000000000 - event_id) AS best FROM (SELECT *, event_id % 5 AS t FROM events)
  GROUP BY ALL""")
def best_temperature(spark, d):
    e = D.table(spark, d, "events").select("event_type", "user_id", F.pmod(F.col("event_id"), F.lit(5)).alias("temperature"),
        F.floor("value").alias("accuracy"), F.col("event_id").alias("pos"))
    return results.best_temperature(e, ["event_type", "user_id"])


@query(r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def caption_prefix(spark, d):
    t = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.concat(F.lit("Certainly! "), "text")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    return D.table(spark, d, "documents").select("doc_id", F.md5(T.caption_prefix(t).cast("binary")).alias("digest"))


@query("SELECT doc_id, doc_id % 6 = 0 AS unfinished, doc_id % 8 < 2 OR contains(text, '...') OR contains(text, '---') AS marked FROM documents")
def quality_flags(spark, d):
    m = lambda k: F.pmod(F.col("doc_id"), F.lit(k))
    text = F.concat("text", F.when(m(8) == 0, " and so on...").when(m(8) == 1, "---").otherwise(""))
    docs = D.table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(m(6) == 0, "length").otherwise("stop").alias("finish_reason"))
    return cleaning.flagged(docs).select("doc_id", "unfinished", "marked")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS mapped FROM conversations")
def role_map(spark, d):
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return D.table(spark, d, "conversations").select("conv_id", "turn", T.map_roles(speaker).alias("mapped"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN run ELSE 'final' END AS key FROM ({D.RUNS})")
def result_key(spark, d):
    r = D.runs(spark, d)
    path = F.concat_ws("/", F.lit("out"), "run", F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, F.col("step_name")).otherwise("final"))
    return r.select("event_id", results.result_key(path).alias("key"))


@query(f"""SELECT age_band, CAST(sum(CASE WHEN n_tokens = 0 THEN CAST(floor(n_words * 1.35) AS BIGINT) ELSE n_tokens END) AS BIGINT) AS mass
  FROM ({D.RECORDS}) GROUP BY age_band""")
def band_token_mass(spark, d):
    return D.records(spark, d).groupBy("age_band").agg(F.sum(T.tokens_or_estimate(F.col("n_tokens"), F.col("n_words"))).alias("mass"))


PACKAGES = """SELECT split_part(p_type, ' ', 1) || '-' || p_brand AS package, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) AS version,
  p_partkey FROM part"""


@query(f"""SELECT package, expected, nullif(actual, 'none') AS actual FROM (SELECT package, arg_min(version, p_partkey) AS expected,
  CASE WHEN count(*) % 4 = 0 THEN 'none' ELSE arg_max(version, p_partkey) END AS actual FROM ({PACKAGES}) GROUP BY package)
  WHERE actual = 'none' OR actual <> expected""")
def env_diff(spark, d):
    """Pinned versions, the first part of each kind, against those found, the last one: others, or none."""
    part = D.table(spark, d, "part")
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), F.pmod(F.col("p_partkey"), F.lit(3)).cast("string"))
    rows = part.select(F.concat(F.split("p_type", " ")[0], F.lit("-"), "p_brand").alias("package"), version.alias("version"), "p_partkey")
    pins = rows.groupBy("package").agg(F.min_by("version", "p_partkey").alias("expected"))
    found = rows.groupBy("package").agg(F.max_by("version", "p_partkey").alias("last"), F.count(F.lit(1)).alias("n")).where("n % 4 <> 0")
    here = found.select("package", T.local_version(F.concat("last", F.lit("+cu121"))).alias("actual"))
    return pins.join(here, "package", "left").where("actual is null or actual <> expected")


@query(f"SELECT CAST(row_number() OVER (ORDER BY run) - 1 AS INTEGER) AS i, run FROM (SELECT DISTINCT run FROM ({D.RUNS}))")
def job_pick(spark, d):
    return ordered_rank(D.runs(spark, d).select("run").distinct(), [F.col("run")], "i").select(F.col("i").cast("int").alias("i"), "run")


@query("""SELECT 'c' || CAST(conv_id AS VARCHAR) AS id, turn, md5(text) AS digest, CAST(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 + turn % 2 END
  AS INTEGER) AS n_images FROM conversations""")
def text_only_view(spark, d):
    """Every second conversation in its text-only form: the same turns in the same order, no images."""
    c = D.table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "conv_id", "turn", "text",
        F.array_repeat(F.lit("x.jpg"), F.pmod(F.col("turn"), F.lit(2)).cast("int") + 1).alias("images"))
    half = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    both = curriculum.text_only(c.where(half)).unionByName(c.where(~half))
    return both.select("id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("images").alias("n_images"))


@query("""SELECT (SELECT count(*) FROM documents) AS n_inputs, (SELECT count(*) FROM labels) AS n_results, (SELECT count(*)
  FROM labels) > (SELECT count(*) FROM documents) AS too_many""")
def count_guards(spark, d):
    n = D.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_inputs"))
    return n.crossJoin(D.table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n_results"))).withColumn("too_many",
        F.col("n_results") > F.col("n_inputs"))


@query("""SELECT shard, n_inputs, n_outputs FROM (SELECT doc_id % 50 AS shard, count(*) AS n_inputs FROM documents GROUP BY ALL) RIGHT
  JOIN (SELECT doc_id % 50 AS shard, count(*) AS n_outputs FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents
  WHERE doc_id % 50 < 5) GROUP BY ALL) USING (shard) WHERE n_outputs > n_inputs""")
def shard_overflow(spark, d):
    """Shards with more results than inputs: those of which a second run has written a part again."""
    docs = D.table(spark, d, "documents").select(F.pmod(F.col("doc_id"), F.lit(50)).alias("shard"))
    return artifacts.too_many(docs, docs.unionByName(docs.where("shard < 5")), "shard")


@query("""SELECT (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // 300 AS shard FROM documents"""
    .join(["""SELECT shard, count(*) AS n FROM (""", ") GROUP BY shard"]))
def shard_counts(spark, d):
    return shard_assign(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'ids' AS what, sha256(string_agg(id, chr(10) ORDER BY idx)) AS digest FROM ({D.RECORDS})")
def column_digest(spark, d):
    """One digest of all ids in manifest order."""
    return spark.createDataFrame([("ids", artifacts.column_digest(D.records(spark, d).select("idx", "id"), "idx", "id"))],
        "what string, digest string")


@query(f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY idx) - 1 AS place FROM ({D.RECORDS})),
b AS (SELECT place // 256 AS block, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY place)) AS digest FROM r GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_blocks, sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest FROM b""")
def tree_digest(spark, d):
    """One digest of all ids in manifest order, made of blocks' digests."""
    return artifacts.tree_digest(D.records(spark, d), "idx", "id", 256)


FILE_ROWS = r"""SELECT a.conv_id, ['caption', 'vqa', 'reasoning'][a.conv_id % 3 + 1] AS task, ['3_5', '6_8', '9_12', '12'][a.conv_id % 4 + 1] AS band,
  a.turn, regexp_replace(a.t, '^\s+|\s+$', '', 'g') AS u, regexp_replace(b.t, '^\s+|\s+$', '', 'g') AS v
  FROM (SELECT conv_id, turn, min(text) AS t FROM conversations WHERE role = 'user' GROUP BY ALL) a JOIN (SELECT conv_id, turn, min(text) AS t
  FROM conversations WHERE role = 'assistant' GROUP BY ALL) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
FILES = f"""SELECT task || '_' || band || '_' || CAST(conv_id AS VARCHAR) AS id, task, band, conv_id, string_agg(u || ' ' || v, ' ' ORDER BY turn)
  AS joined, bool_and(u <> '' AND v <> '') AND conv_id % 5 <> 0 AS kept FROM ({FILE_ROWS}) GROUP BY conv_id, task, band"""


def file_rows(spark, d):
    """Conversations as the rows of twelve annotation files, and the images that there are."""
    said = D.table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("t"))
    user = said.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("<image>\n"), "t").alias("u"))
    reply = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("v"))
    grouped = user.join(reply, ["conv_id", "turn"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "u", "v"))).alias("p"))
    turns = F.transform("p", lambda x: F.struct(x["u"].alias("user"), x["v"].alias("assistant")))
    pick = lambda values, k: F.element_at(T.lit_array(values), (F.pmod(F.col("conv_id"), F.lit(k)) + 1).cast("int"))
    name = F.concat(pick(TASKS, 3), F.lit("_"), pick(BANDS, 4), F.lit(".json"))
    image = F.concat(F.col("conv_id").cast("string"), F.lit(".jpg"))
    rows = grouped.select(name.alias("file_name"), F.col("conv_id").alias("row"), F.col("conv_id").cast("string").alias("id"), image.alias("image"),
        convert.conversation(turns).alias("conversations"))
    # every fifth image stands under another name, so its row has none
    path = F.when(F.pmod(F.col("row"), F.lit(5)) == 0, F.concat(F.lit("other/"), "image")).otherwise(F.col("image"))
    return rows, rows.select(path.alias("path"))


@query(rf"""SELECT id, row_number() OVER (ORDER BY list_position(['caption', 'vqa', 'reasoning'], task), list_position(['3_5', '6_8', '9_12', '12'],
  band), conv_id) - 1 AS manifest_index, CAST(len(regexp_extract_all(joined, '\S+')) AS BIGINT) AS n_words FROM ({FILES}) WHERE kept""")
def manifest_files(spark, d):
    return manifest.from_rows(*file_rows(spark, d))[0].select("id", "manifest_index", "n_words")


@query(rf"""SELECT count(*) FILTER (WHERE kept) AS n_out, count(*) FILTER (WHERE NOT kept) AS n_skipped,
  CAST(coalesce(sum(len(regexp_extract_all(joined, '\S+'))) FILTER (WHERE kept), 0) AS BIGINT) AS words FROM ({FILES})""")
def manifest_totals(spark, d):
    return manifest.from_rows(*file_rows(spark, d))[1]


@query(r"""SELECT doc_id, md5('q' || chr(10)) AS prompt, md5('q' || chr(10) || text || chr(10) || 'r' || chr(10) || text) AS full FROM documents""")
def scoring_pairs(spark, d):
    """The prompt and the whole text that a teacher scores."""
    pair = lambda q: F.struct(F.lit(q).alias("user"), F.col("text").alias("assistant"))
    docs = D.table(spark, d, "documents").select("doc_id", F.array(pair("q"), pair("r")).alias("texts"))
    return docs.select("doc_id", *manifest.scoring_texts()).select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"),
        F.md5(F.col("full").cast("binary")).alias("full"))


@query(f"""SELECT idx, row_number() OVER (ORDER BY age_ord, idx) - 1 AS manifest_index FROM (SELECT idx, list_position(['3_5', '6_8', '9_12', '12'],
  age_band) AS age_ord FROM ({D.RECORDS}))""")
def manifest_index(spark, d):
    return manifest.indexed(D.records(spark, d), row="idx").select("idx", "manifest_index")


@query(rf"""WITH m AS (SELECT b.age_band, m.words FROM (SELECT unnest(['3_5', '6_8', '9_12', '12']) AS age_band) b LEFT JOIN (
  SELECT age_band, CAST(sum(len(regexp_extract_all(d.text, '\S+'))) AS BIGINT) AS words FROM documents d JOIN (SELECT book, ['3_5', '6_8', '9_12',
  '12'][list_position(['3-5', '6-8', '9-12', '12+'], age_group)] AS age_band FROM ({MAJORITY})) g ON g.book = d.source
  GROUP BY age_band) m USING (age_band))
SELECT age_band, coalesce(words, 0) AS words FROM m""")
def words_by_band(spark, d):
    """The flagship: majority vote of every book, joined to its pages, words by band."""
    band = F.element_at(T.lit_array(BANDS), F.array_position(T.lit_array(LABEL_BANDS), F.col("age_group")).cast("int"))
    books = labels.majority(labelled(spark, d)).select("book", band.alias("age_band"))
    counted = D.pages(spark, d).select("book", T.word_count(F.col("text")).alias("n"))
    sums = counted.groupBy("book").agg(F.sum("n").alias("n")).join(books, "book").groupBy("age_band").agg(F.sum("n").alias("words"))
    return spark.createDataFrame([(b,) for b in BANDS], "age_band string").join(sums, "age_band", "left").select("age_band",
        F.coalesce("words", F.lit(0)).alias("words"))


@query()
def competence_in_sequence(spark, d):
    """An order by competence in the generator's own sequence, every task drawing its part."""
    return curriculum.competence_sequence(D.records(spark, d), "perplexity", 5, 0)



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
