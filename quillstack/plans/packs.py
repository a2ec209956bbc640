"""Queries of sequence packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import textops as T
from quillstack.operators import packing
from quillstack.plans import tables as D
from quillstack.plans.registry import query

SAMPLES = r"""SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.35) AS BIGINT) AS n_tokens,
  CAST(CASE WHEN doc_id % 101 = 0 THEN 6 ELSE doc_id % 4 END AS BIGINT) AS n_images FROM documents"""
STATUS = "CASE WHEN n_tokens > 4096 THEN 'too_long' WHEN n_images > 4 THEN 'too_many_images' ELSE 'packed' END"


def samples(spark, d):
    images = F.when(F.pmod(F.col("doc_id"), F.lit(101)) == 0, 6).otherwise(F.pmod(F.col("doc_id"), F.lit(4)))
    return D.table(spark, d, "documents").select(
        F.col("doc_id").alias("position"), F.col("doc_id").alias("id"), F.floor(T.word_count(F.col("text")) * 1.35).alias("n_tokens"), images.alias("n_images")
    )


@query(f"""SELECT doc_id, n_tokens, n_images, {STATUS} AS status, CAST(CASE WHEN {STATUS} = 'packed' THEN 1 ELSE 0 END AS BIGINT) AS n_packs,
  true AS within FROM ({SAMPLES})""")
def packed_samples(spark, d):
    """Every sample with the number of packs that hold it, and whether its pack keeps both limits."""
    packed = packing.pack(samples(spark, d), rows=2000)
    packs = packing.sequences(packed).select("pack", ((F.col("n_tokens") <= packing.TOKENS) & (F.col("n_images") <= packing.PACK_IMAGES)).alias("kept"))
    each = packed.join(packs, "pack", "left").groupBy(F.col("id").cast("bigint").alias("doc_id"), "n_tokens", "n_images", "status")
    return each.agg(F.countDistinct("pack").alias("n_packs"), F.min(F.coalesce("kept", F.lit(True))).alias("within"))


@query(f"""SELECT count(*) AS n_samples, count(*) FILTER (WHERE s = 'packed') AS n_packed, count(*) FILTER (WHERE s = 'too_long') AS n_too_long,
  count(*) FILTER (WHERE s = 'too_many_images') AS n_too_many_images, CAST(sum(n_tokens) FILTER (WHERE s = 'packed') AS BIGINT) AS n_tokens,
  CAST(0 AS BIGINT) AS n_over, true AS filled FROM (SELECT *, {STATUS} AS s FROM ({SAMPLES}))""")
def packing_report(spark, d):
    """Samples by status, packs over a limit, and whether nine tenths of the room of all packs but one are filled."""
    told = packing.report(packing.pack(samples(spark, d), rows=2000))
    filled = F.col("n_tokens") >= 0.9 * packing.TOKENS * (F.col("n_packs") - 1)
    return told.select("n_samples", "n_packed", "n_too_long", "n_too_many_images", "n_tokens", "n_over", filled.alias("filled"))
