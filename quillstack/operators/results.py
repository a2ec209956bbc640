"""Run names, report collation, trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The form of a run's name, the tasks that are reported.
RUN_NAME = r"^tl_(.+)_(staged|competence)_ep(\d+)_([^_]+)lm_([^_]+)_seed(\d+)_(.+)$"
RUN_FIELDS = ("order", "schedule", "epochs", "lm_init", "modality", "seed", "run_id")
CONDITION = ("epochs", "lm_init", "modality", "order", "schedule")
# Tasks in report order, the label that is not what stands before the slash, orders without a schedule, those
# that are staged only, and names in figures.
REPORTED = ("blimp/blimp_filtered", "blimp/supplement_filtered", "ewok/ewok_filtered", "entity_tracking/entity_tracking", "comps/comps")
OVERRIDE = ("blimp/supplement_filtered", "supplement")
FREE = ("random",)
CONTROLS = ("randomblock", "qwenppl", "gemmappl")
NAMES = {"antidevelopmental": "anti-developmental", "randomblock": "random-block", "qwenppl": "perplexity (Qwen3)", "gemmappl": "perplexity (Gemma)"}
ACCURACY = r"### AVERAGE ACCURACY\n([\d.]+)"


def parse_runs(df: DataFrame, name: str = "run") -> DataFrame:
    """The fields of every run name that has the form; others are left out."""
    typed = lambda f, c: c.cast("int") if f in ("epochs", "seed") else c
    return df.where(F.col(name).rlike(RUN_NAME)).select("*",
        *(typed(f, F.regexp_extract(name, RUN_NAME, i + 1)).alias(f) for i, f in enumerate(RUN_FIELDS)))


def run_name(order: Column, schedule: Column, epochs: Column, lm_init: Column, modality: Column, seed: Column, run_id: Column) -> Column:
    return F.format_string("tl_%s_%s_ep%d_%slm_%s_seed%d_%s", order, schedule, epochs, lm_init, modality, seed, run_id)


def filter_runs(df: DataFrame, epochs: int | None = None, lm_init: str | None = None, modality: str | None = None, name_regex: str | None = None,
    name: str = "run") -> DataFrame:
    for c, v in (("epochs", epochs), ("lm_init", lm_init), ("modality", modality)):
        df = df if v is None else df.where(F.col(c) == v)
    return df if name_regex is None else df.where(F.col(name).rlike(rf"\A(?:{name_regex})\z"))


def condition_label() -> Column:
    return F.format_string("ep%d/%slm/%s/%s/%s", *(F.col(c) for c in CONDITION))


def report_accuracy(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, ACCURACY, 1), F.lit("")).cast("double")


def step_number(name: Column) -> Column:
    return F.regexp_replace(name, "^step_", "").cast("bigint")


def result_key(path: Column) -> Column:
    """The leaf, or the directory above it if the leaf is step_N."""
    parts = F.split(path, "/")
    leaf = F.element_at(parts, -1)
    return F.when(leaf.rlike(r"^step_\d+$"), F.element_at(parts, -2)).otherwise(leaf)


def mean_sd(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value) and count."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))


def task_label(task: Column) -> Column:
    """A reported task's short name: what stands before the slash, with one override; null for tasks that are not reported."""
    short = F.when(task == OVERRIDE[0], OVERRIDE[1]).otherwise(F.substring_index(task, "/", 1))
    return F.when(task.isin(*REPORTED), short)


def text_tasks(df: DataFrame, task: str = "task") -> DataFrame:
    """The rows of reported tasks, with ``label`` and ``task_order``, their place in the report."""
    place = F.array_position(F.array(*(F.lit(t) for t in REPORTED)), F.col(task))
    return df.where(F.col(task).isin(*REPORTED)).withColumns({"label": task_label(F.col(task)), "task_order": place.cast("int")})


def panels(df: DataFrame) -> DataFrame:
    """Rows under the ``panel`` (staged, competence) that shows them: an order that has no schedule is staged and stands in
    both panels, controls that are only staged stand there alone, others in that of their schedule."""
    shown = df.where(~F.col("order").isin(*FREE, *CONTROLS) | (F.col("schedule") == "staged"))
    panel = F.when(F.col("order").isin(*FREE), F.array(F.lit("staged"), F.lit("competence"))).otherwise(F.array("schedule"))
    return shown.select("*", F.explode(panel).alias("panel"))


def order_label() -> Column:
    """An order's name in figures; the schedule's first four letters follow unless the order is shown without."""
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), F.col("order")), F.col("order"))
    return F.when(F.col("order").isin(*FREE, *CONTROLS), name).otherwise(F.concat(name, F.lit("/"), F.substring("schedule", 1, 4)))


def against_random(df: DataFrame, value: str) -> DataFrame:
    """(epochs, order, schedule, mean, baseline): condition means beside the mean of the random order of as many epochs."""
    means = df.groupBy("epochs", "order", "schedule").agg(F.avg(value).alias("mean"))
    random = df.where("`order` = 'random'").groupBy("epochs").agg(F.avg(value).alias("baseline"))
    return means.join(random, "epochs", "left").select("epochs", "order", "schedule", "mean", "baseline")


def require_unique(df: DataFrame, by: Sequence[str], path: str = "path") -> None:
    """Fails with the key and both files of a repeated result."""
    found = duplicate_pairs(df, by, path).limit(1).collect()
    if found:
        r = found[0]
        raise ValueError(f"{r.n} results of {'/'.join(str(r[c]) for c in by)}: {r['first']} and {r['second']}")


def pivot_means(df: DataFrame, by: Sequence[str], task: str, tasks: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(F.when(F.col(task) == t, F.col(value))).alias(t) for t in tasks))


def markdown(table: DataFrame, labels: Sequence[str], tasks: Sequence[str], most: int = 10_000) -> list[str]:
    """The collated table as Markdown lines, a dash where a task is missing. One row a condition, ``most`` of them."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} conditions are no table to read")
    lines = ["| condition | " + " | ".join(tasks) + " |", "|" + "---|" * (len(tasks) + 1)]
    for r in table.orderBy(*labels).collect():
        lines.append("| " + "/".join(str(r[c]) for c in labels) + " | " + " | ".join("—" if r[t] is None else f"{r[t]:.2f}" for t in tasks) + " |")
    return lines


def duplicate_pairs(df: DataFrame, by: Sequence[str], path: str = "path") -> DataFrame:
    """(by, n, first, second): groups of more than one row with their two least paths. No state grows with a group."""
    least = df.select(*by, path, F.row_number().over(Window.partitionBy(*by).orderBy(path)).alias("place")).where("place <= 2")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    both = counts.withColumn(path, F.lit(None).cast("string")).unionByName(least.select(*by, F.lit(0).cast("bigint").alias("n"), path))
    return both.groupBy(*by).agg(F.sum("n").alias("n"), F.min(path).alias("first"), F.max(path).alias("second")).where("n > 1")


def best_temperature(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos, temperature, accuracy): the temperature of the greatest accuracy, the first of equals."""
    return df.groupBy(*by).agg(F.max_by("temperature", F.struct(F.col("accuracy"), -F.col("pos"))).alias("best"))


def latest(df: DataFrame, by: Sequence[str], path: str, step: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(path, step).alias(path), F.max(step).alias(step))


def candidates(question: Column, target: Column, distractors: Column) -> Column:
    """The target's completion first, then the distractors'."""
    return F.concat(F.array(F.concat_ws(" ", question, target)), F.transform(distractors, lambda d: F.concat_ws(" ", question, d)))
