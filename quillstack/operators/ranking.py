"""Global ranks without a single-task window: rows are ranked inside buckets that are themselves in order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should have, and buckets at most: beyond ROWS * MOST rows buckets grow, sorted on disk where need be.
ROWS, MOST = 100_000, 1 << 14


def _ranked(df: DataFrame, bucket: Column, order: Sequence[Column], within: Sequence[str], name: str, counted: DataFrame | None = None) -> DataFrame:
    """counted: a table with the same rows that is cheaper to read; buckets are counted there."""
    keys = [*within, "__bucket"]
    before = Window.partitionBy(*within).orderBy("__bucket") if within else Window.partitionBy(F.lit(0)).orderBy("__bucket")
    counts = (df if counted is None else counted).groupBy(*within, bucket.alias("__bucket")).count()  # a row a bucket
    offsets = counts.select(*keys, (F.sum("count").over(before) - F.col("count")).alias("__offset"))
    own = df.withColumn("__bucket", bucket).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return own.join(offsets, keys).withColumn(name, F.col("__offset") + F.col("__rank").cast("bigint") - 1).drop("__bucket", "__offset", "__rank")


def hash_digits(n: int) -> int:
    """The hex digits of a hash that make buckets of about ``ROWS`` rows of n: two at least, four at most (65,536 buckets)."""
    return min(4, max(2, math.ceil(math.log(max(n, 1) / ROWS, 16)) if n > ROWS else 2))


def hash_rank(df: DataFrame, key: str, tie: str, within: Sequence[str] = (), name: str = "rank", n: int | None = None) -> DataFrame:
    """0-based rank by (key, tie), key being a hex hash: its first digits are the buckets, as many as n rows need.

    n: about the rows of the largest group ``within``; without it all rows are counted.
    """
    digits = hash_digits(df.count() if n is None else n)
    return _ranked(df, F.substring(key, 1, digits), [F.col(key), F.col(tie)], within, name)


def quantile_cuts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, list]]:
    """The number of rows, and per column values that part them into buckets of about ``ROWS``. One job for all columns.

    The cuts are approximate quantiles; they only deal out the work, ranks don't depend on them. Few rows need none.
    """
    n = df.count()
    parts = min(MOST, max(1, math.ceil(n / ROWS)))
    if parts == 1:
        return n, {c: [] for c in columns}
    points = [i / parts for i in range(1, parts)]
    found = df.agg(*(F.percentile_approx(c, points, max(10_000, 20 * parts)) for c in columns)).first()
    return n, {c: sorted(set(found[i] or [])) for i, c in enumerate(columns)}


def cuts_upto(c: Column, cuts: Sequence) -> Column:
    """How many of the sorted cuts are not above the value, by halving."""
    if not cuts:
        return F.lit(0)
    values, span = F.array(*(F.lit(x) for x in cuts)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(values, mid) <= c)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.coalesce(F.aggregate(steps, span, halve)["lo"], F.lit(0))


def score_rank(df: DataFrame, score: str, key: str, tie: str, name: str = "rank", cuts: Sequence | None = None,
    counted: DataFrame | None = None) -> DataFrame:
    """0-based rank by (score, key, tie). Equal scores that fill whole buckets are dealt out again by their hash."""
    cuts = quantile_cuts(df, [score])[1][score] if cuts is None else cuts
    no = cuts_upto(F.col(score), cuts)
    # rows that equal a cut come first in their bucket, so their hash orders them
    on_cut = F.coalesce(F.get(F.array(*(F.lit(x) for x in cuts)), no - 1) == F.col(score), F.lit(False)) if cuts else F.lit(False)
    bucket = F.concat(F.lpad(no.cast("string"), 5, "0"), F.when(on_cut, F.concat(F.lit("0"), F.substring(key, 1, 2))).otherwise(F.lit("1")))
    return _ranked(df, bucket, [F.col(score), F.col(key), F.col(tie)], (), name, counted)


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank by columns, the first of which deals out the rows: a bounded sample of its values gives the cuts."""
    keyed = df.withColumn("__first", order[0])
    parts = min(MOST, max(1, math.ceil(df.count() / ROWS)))
    cuts: list = []
    if parts > 1:  # by hash, so that the sample is the same wherever the rows are
        found = sorted(r[0] for r in keyed.where("__first is not null").select("__first").orderBy(F.xxhash64("__first")).limit(50 * parts).collect())
        cuts = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    bucket = F.lpad(cuts_upto(F.col("__first"), cuts).cast("string"), 5, "0")
    return _ranked(keyed, bucket, list(order), (), name).drop("__first")


def tile(rank: Column, n: Column, tiles: int) -> Column:
    """1-based NTILE from a 0-based rank among n: the first n % tiles tiles have one row more."""
    small, extra = F.floor(n / tiles), n % tiles
    head = extra * (small + 1)
    return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - head) / F.greatest(small, F.lit(1)))).cast("int") + 1


def tile_sizes(n: int, tiles: int) -> list[int]:
    return [n // tiles + (k < n % tiles) for k in range(tiles)]
