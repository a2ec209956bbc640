"""Samples to packs of constant length: as many samples as fit a sequence, with a limit on its images too.

Samples are dealt out in runs of the order they come in, so a pack's samples stand near one another. Within a run they are
placed by best fit, the largest first: length classes tell at once which open pack has the least room that is enough. Packs that
are filled to ``full`` are done; the samples of the others go on to the next round, where the leftovers of neighbouring runs
meet, so that a run's edge leaves no half-filled pack behind. A task holds less than twice ``rows`` samples, whatever their
lengths; the driver sees a count a round.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.ranking import ordered_rank
from quillstack.operators.stored import stored

#: Tokens of a sequence, images of a pack and of a sample, samples of a run, share from which a pack is full.
TOKENS, PACK_IMAGES, SAMPLE_IMAGES, ROWS, FULL = 4096, 18, 4, 50_000, 0.99
#: Rounds in which leftovers of several runs meet.
ROUNDS = 6
PLACED = "position long, id string, n_tokens long, n_images long, run long, pack string, fill double"


class Room:
    """Open packs by the room they have left, tokens and images. A bit a room of tokens tells if there is such a pack."""

    def __init__(self, images: int):
        self.open = [defaultdict(list) for _ in range(images + 1)]
        self.bits = [0] * (images + 1)

    def put(self, tokens: int, images: int, pack: int) -> None:
        self.open[images][tokens].append(pack)
        self.bits[images] |= 1 << tokens

    def take(self, tokens: int, images: int) -> tuple[int, int, int] | None:
        """(tokens, images, pack) of the open pack with the least room that is enough, the fewest images of equals."""
        best = None
        for have in range(images, len(self.bits)):
            beyond = self.bits[have] >> tokens
            if beyond:
                room = tokens + (beyond & -beyond).bit_length() - 1
                if best is None or room < best[0]:
                    best = (room, have)
        if best is None:
            return None
        room, have = best
        pack = self.open[have][room].pop()
        if not self.open[have][room]:
            del self.open[have][room]
            self.bits[have] &= ~(1 << room)
        return room, have, pack


def best_fit(samples: list[tuple[int, int]], tokens: int, images: int) -> tuple[list[int], list[int]]:
    """The pack of every (tokens, images) sample, and every pack's tokens.

    Those that take the largest shares of both limits together come first, so that short samples with many images are placed
    while there are packs with room for images; earlier ones first of equals.
    """
    room, packs, fill = Room(images), [0] * len(samples), []
    share = lambda s: s[0] * max(images, 1) + s[1] * tokens
    for i in sorted(range(len(samples)), key=lambda i: (-share(samples[i]), -samples[i][0], i)):
        need, shown = samples[i]
        found = room.take(need, shown)
        if found is None:
            found = (tokens, images, len(fill))
            fill.append(0)
        free, left, pack = found
        packs[i] = pack
        fill[pack] += need
        if free > need:
            room.put(free - need, left - shown, pack)
    return packs, fill


def _packer(tokens: int, images: int, round_: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("position", "ascending"), ("id", "ascending")])
        run = table["run"][0].as_py()
        packs, fill = best_fit(list(zip(table["n_tokens"].to_pylist(), table["n_images"].to_pylist(), strict=True)), tokens, images)
        named = pa.array([f"{round_}-{run}-{p}" for p in packs], pa.string())
        return table.append_column("pack", named).append_column("fill", pa.array([fill[p] / tokens for p in packs], pa.float64()))

    return pack


def fitting(samples: DataFrame, tokens: int = TOKENS, sample_images: int = SAMPLE_IMAGES, pack_images: int = PACK_IMAGES):
    """Why a sample can't be packed, null if it can: no length, too long, too many images."""
    return (
        F.when(F.col("n_tokens").isNull() | (F.col("n_tokens") < 0) | F.col("n_images").isNull() | (F.col("n_images") < 0), "no_length")
        .when(F.col("n_tokens") > tokens, "too_long")
        .when(F.col("n_images") > min(sample_images, pack_images), "too_many_images")
    )


def dealt(left: DataFrame, rows: int) -> DataFrame:
    """The leftovers with new runs: neighbouring runs together, up to ``rows`` samples. A row a run decides it."""
    counts = left.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    joined = counts.select("run", F.floor((upto - 1) / rows).cast("long").alias("next"))
    return left.drop("pack", "fill").join(joined, "run").drop("run").withColumnRenamed("next", "run")


def pack(
    samples: DataFrame, tokens: int = TOKENS, pack_images: int = PACK_IMAGES, sample_images: int = SAMPLE_IMAGES, rows: int = ROWS, full: float = FULL, rounds: int = ROUNDS
) -> DataFrame:
    """position, id, n_tokens, n_images, status, pack: every sample once; ``pack`` is null unless status is 'packed'.

    samples: position (their order), id, n_tokens, n_images. In a pack the tokens sum to ``tokens`` at most and the images
    to ``pack_images`` at most. Samples that no pack can take keep their row, with the reason as their status. Rows that
    share position and id are samples of their own.
    """
    own = samples.select("position", F.col("id").cast("string").alias("id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_images").cast("long").alias("n_images"))
    told = own.withColumn("status", fitting(own, tokens, sample_images, pack_images))
    fit = told.where("status is null").drop("status")
    ranked = ordered_rank(fit, [F.col("position"), F.col("id")], "rank")
    left = ranked.withColumn("run", F.floor(F.col("rank") / rows).cast("long")).select("position", "id", "n_tokens", "n_images", "run")
    done = []
    for k in range(rounds):
        placed = stored(left.groupBy("run").applyInArrow(_packer(tokens, pack_images, k), PLACED))
        open_, runs = placed.where(F.col("fill") < full), placed.agg(F.countDistinct("run")).first()[0]
        if k + 1 == rounds or runs <= 1:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") >= full))
        left = dealt(open_, rows)
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    packed = packed.select("position", "id", "n_tokens", "n_images", F.lit("packed").alias("status"), "pack")
    return packed.unionByName(told.where("status is not null").withColumn("pack", F.lit(None).cast("string")))


def report(packed: DataFrame, tokens: int = TOKENS, pack_images: int = PACK_IMAGES) -> DataFrame:
    """One row: samples by status, packs, the tokens they hold, packs over a limit, and the share of the room that is filled."""
    packs = packed.where("pack is not null").groupBy("pack").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_images").alias("images"))
    filled = packs.agg(
        F.count(F.lit(1)).alias("n_packs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.count(F.when((F.col("tokens") > tokens) | (F.col("images") > pack_images), 1)).alias("n_over"),
    )
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    names = ("packed", "too_long", "too_many_images", "no_length")
    counted = packed.agg(F.count(F.lit(1)).alias("n_samples"), *(status(s).alias(f"n_{s}") for s in names))
    return counted.join(filled).withColumn("fill", F.col("n_tokens") / F.greatest(F.col("n_packs") * tokens, F.lit(1)))


def sequences(packed: DataFrame) -> DataFrame:
    """pack, n_tokens, n_images, ids: a pack's samples in their order. A pack's rows are bounded by its tokens."""
    order = F.array_sort(F.collect_list(F.struct("position", "id")))
    return packed.where("pack is not null").groupBy("pack").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_images").alias("n_images"), F.transform(order, lambda s: s["id"]).alias("ids")
    )
