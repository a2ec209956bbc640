"""Constraints as tables of violations, and the step that fails a job on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.schemas import BANDS, SCORE_FIELDS, TASKS


def record_violations(records: DataFrame, scores: tuple[str, ...] = SCORE_FIELDS) -> DataFrame:
    """(id, rule) of missing, empty or duplicate ids, unknown tasks or bands, unsound scores and counts."""
    rules: list[tuple[str, Column]] = [
        ("id", F.col("id").isNull() | (F.col("id") == "")),
        ("task", F.col("task").isNull() | ~F.col("task").isin(*TASKS)),
        ("band", F.col("age_band").isNull() | ~F.col("age_band").isin(*BANDS)),
    ]
    for s in scores:
        c = F.col(s)
        rules.append((s, c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | ((c < 0) if s.startswith("nll") else F.lit(False))))
    rules += [(c, F.col(c).isNull() | (F.col(c) <= 0)) for c in ("n_words", "n_tokens")]
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)), lambda r: r.isNotNull())
    single = records.select("id", F.explode(broken).alias("rule"))
    twice = records.where("id <> ''").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("rule"))
    return single.unionByName(twice)


def conversation_violations(df: DataFrame) -> DataFrame:
    """(id, rule): conversations that are empty or odd, whose roles don't alternate from human, or with an empty text."""
    c = F.col("conversations")
    n = F.size(c)
    roles = F.forall(F.transform(c, lambda t, i: t["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda ok: ok)
    rule = F.when((n <= 0) | (n % 2 == 1), "length").when(~roles, "roles").when(F.exists(c, lambda t: F.trim(t["value"]) == ""), "empty")
    return df.select("id", rule.alias("rule")).where("rule is not null")


def annotation_diff(annotations: DataFrame, manifest: DataFrame, fields: list[str]) -> DataFrame:
    """(id, reason): unexpected, missing or the first field that differs, over a full outer join by id."""
    a = annotations.select(F.col("id"), F.lit(1).alias("a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    m = manifest.select(F.col("id"), F.lit(1).alias("m"), *(F.col(f).alias(f"m_{f}") for f in fields))
    reason = F.when(F.col("m").isNull(), "unexpected").when(F.col("a").isNull(), "missing")
    for f in fields:
        reason = reason.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"m_{f}")), f"{f} mismatch")
    return a.join(m, "id", "full_outer").select("id", reason.alias("reason")).where("reason is not null")


def require_none(violations: DataFrame, what: str) -> None:
    """Fails with the first few violations."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in found))


def finite(c: Column, name: str) -> Column:
    """The value, or an error for NaN and infinities: no sink writes them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(c)
