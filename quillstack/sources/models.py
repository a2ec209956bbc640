"""Model calls: an iterator over Arrow batches with a backend that is built once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a batch's values (texts, or bytes of images) to as many answers.
Backend = Callable[[list], list[str]]


def by_length(df: DataFrame, length: str, parts: int | None = None) -> DataFrame:
    """Rows of like length together, in parts of about as many rows: a batch wastes little padding."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, F.col(length)).sortWithinPartitions(length)


def generate(prompts: DataFrame, column: str, make_backend: Callable[[], Backend], out: str = "generated_text", batch: int = 5000) -> DataFrame:
    """prompts with the backend's answer and ``error``: a batch that fails is tried row by row, a failing row is told."""
    at = prompts.columns.index(column)
    names = [*prompts.columns, out, "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make_backend()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                texts = part.column(at).to_pylist()
                try:
                    answers, errors = backend(texts), [None] * len(texts)
                except Exception:  # told per row below
                    answers, errors = [], []
                    for t in texts:
                        try:
                            answers += backend([t])
                            errors.append(None)
                        except Exception as e:
                            answers.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names)

    return prompts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + f", {out} string, error string")


#: Candidates that are scored with one encoding of their image.
CANDIDATES = 10_000
ItemModel = tuple[Callable[[bytes], object], Callable[[object, list[str]], list[float]]]


def score_candidates(candidates: DataFrame, images: DataFrame, make_model: Callable[[], ItemModel], most: int = CANDIDATES) -> DataFrame:
    """item, completion, loglik, encoded: every candidate's log-likelihood, each image encoded once for all its candidates.

    candidates: item, completion (its number), text, image (a name, null if there is none); images: image, content, a row a
    name. make_model gives (encode, score): encode makes an embedding of an image's bytes, score the log-likelihoods of
    texts given an embedding (None without image). An image of more than ``most`` candidates is dealt to several tasks and
    encoded once in each; ``encoded`` is 1 in the row of a call, else 0. A candidate whose image is missing fails the job.
    """
    counts = candidates.groupBy("image").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("item", "completion"), F.col("parts")).cast("int")
    same = F.col("image").eqNullSafe(F.col("of"))
    own = candidates.select("item", "completion", "text", "image").join(counts.withColumnRenamed("image", "of"), same).drop("of").withColumn("part", part)
    spread = images.select("image", "content").join(counts, "image").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.coalesce(F.concat(F.lit("="), "image"), F.lit("")).alias("key")
    built: list[ItemModel] = []

    def run(own: pa.Table, shown: pa.Table) -> pa.Table:
        own = own.sort_by([("item", "ascending"), ("completion", "ascending")])
        if not built:
            built.append(make_model())
        encode, score = built[0]
        name = own["key"][0].as_py() if own.num_rows else ""
        if own.num_rows and name and not shown.num_rows:
            raise ValueError(f"there is no image {name[1:]}")
        calls = int(bool(own.num_rows and name))
        embedding = encode(shown["content"][0].as_py()) if calls else None
        logliks = score(embedding, own["text"].to_pylist()) if own.num_rows else []
        encoded = [calls] + [0] * (own.num_rows - 1) if own.num_rows else []
        cells = [own["item"], own["completion"], pa.array(logliks, pa.float64()), pa.array(encoded, pa.int32())]
        return pa.table(cells, ["item", "completion", "loglik", "encoded"])

    left = own.select("item", "completion", "text", key, "part").groupBy("key", "part")
    right = spread.select(key, "part", "content").groupBy("key", "part")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return left.cogroup(right).applyInArrow(run, f"item {kinds['item']}, completion {kinds['completion']}, loglik double, encoded int")


def rank_completions(scores: DataFrame) -> DataFrame:
    """item, completion, loglik -> the completion of the greatest log-likelihood, the least number of equals."""
    return scores.groupBy("item").agg(F.max_by("completion", F.struct(F.col("loglik"), -F.col("completion"))).alias("chosen"))
