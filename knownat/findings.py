"""One schema for everything an operator objects to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities, mildest first.
SEVERITIES = ["pass", "warning", "quarantine", "blocking"]
STOPPING = ["quarantine", "blocking"]

COLUMNS = ["source", "severity", "rule_id", "subject", "date", "observed", "threshold", "evidence"]


class BlockingFindings(ValueError):
    """Raised in strict mode when a stopping finding exists."""


def findings(
    df: DataFrame,
    *,
    source: str,
    severity: str | Column,
    rule: str | Column,
    subject: Column | None = None,
    date: Column | None = None,
    observed: Column | None = None,
    threshold: Column | None = None,
    evidence: Column | None = None,
) -> DataFrame:
    """Project rows to the findings schema."""

    def text(value: Column | None, kind: str = "string") -> Column:
        return F.lit(None).cast(kind) if value is None else value.cast(kind)

    return df.select(
        F.lit(source).alias("source"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"),
        text(subject).alias("subject"),
        text(date, "date").alias("date"),
        text(observed).alias("observed"),
        text(threshold).alias("threshold"),
        (F.lit(None).cast("array<string>") if evidence is None else evidence).alias("evidence"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def explode_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One row per failed check of a row, in one pass: column ``rule_id`` names the check."""
    named = [F.when(condition, F.lit(rule)) for rule, condition in reasons.items()]
    return df.withColumn("rule_id", F.explode(F.array_compact(F.array(*named))))


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first check that fails, else null."""
    return F.coalesce(*[F.when(condition, F.lit(rule)) for rule, condition in reasons.items()])


def require_clean(found: DataFrame) -> None:
    """Strict mode: stop when a quarantine or blocking finding exists."""
    worst = found.filter(F.col("severity").isin(STOPPING)).limit(1).select("rule_id", "subject").take(1)
    if worst:
        raise BlockingFindings(f"{worst[0]['rule_id']}: {worst[0]['subject']}")
