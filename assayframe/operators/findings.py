"""Expectations against observations, and the verdict over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finding classes and statuses.
REPRODUCE, DOCUMENTED = "reproduce", "documented"
REPRODUCED, FAILED, MISSING = "reproduced", "FAILED", "MISSING"

EXPECTATIONS = "finding_id string, population string, cls string, number double, text string, tolerance double"


def observations(*parts: DataFrame) -> DataFrame:
    """Union of ``finding_id, number, text`` frames, one per section."""
    return reduce(DataFrame.unionByName, parts)


def observed_numbers(one_row: DataFrame, names: dict[str, str]) -> DataFrame:
    """Turn the columns of a one-row frame into observations."""
    rows = [
        F.struct(F.lit(finding).alias("finding_id"), F.col(column).cast("double").alias("number"), F.lit(None).cast("string").alias("text"))
        for finding, column in names.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))


def observed_rows(df: DataFrame, prefix: str, name: str, value: str) -> DataFrame:
    """Turn a table with one named number per row into observations."""
    return df.select(
        F.concat(F.lit(prefix), F.col(name).cast("string")).alias("finding_id"), F.col(value).cast("double").alias("number"),
        F.lit(None).cast("string").alias("text"),
    )


def evaluate_findings(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of every expectation; an unknown class fails the job.

    ``reproduce`` needs the exact value, ``documented`` a number within the
    tolerance (inclusive) or any non-empty text.
    """
    seen = observed.select("finding_id", F.col("number").alias("seen"), F.col("text").alias("seen_text"))
    joined = expected.join(seen, "finding_id", "left")
    absent = F.col("seen").isNull() & F.col("seen_text").isNull()
    exact = F.coalesce(F.col("seen") == F.col("number"), F.col("seen_text") == F.col("text"), F.lit(False))
    gap_ok = F.abs(F.col("seen") - F.col("number")) <= F.col("tolerance")
    accepted = F.coalesce(gap_ok, F.length("seen_text") > 0, F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("unknown finding class: "), F.coalesce("cls", F.lit("NULL")))).cast("string")
    status = (
        F.when(absent, MISSING)
        .when(F.col("cls") == REPRODUCE, F.when(exact, REPRODUCED).otherwise(FAILED))
        .when(F.col("cls") == DOCUMENTED, F.when(accepted, DOCUMENTED).otherwise(FAILED))
        .otherwise(unknown)
    )
    return joined.select(
        "finding_id", "population", "cls", F.col("number").alias("expected"), F.col("seen").alias("observed"), "tolerance",
        status.alias("status"),
    )


def failing() -> Column:
    return F.col("status").isin(FAILED, MISSING)


def verdict(findings: DataFrame) -> DataFrame:
    """One row: findings per status and whether the whole report fails."""
    return findings.agg(
        F.count("*").alias("n_findings"),
        F.count_if(F.col("status") == FAILED).alias("n_failed"),
        F.count_if(F.col("status") == MISSING).alias("n_missing"),
        F.coalesce(F.bool_or(failing()), F.lit(False)).alias("fails"),
    )


def unnamed_populations(counts: DataFrame, populations: DataFrame) -> DataFrame:
    """Published counts whose population is missing or not a known one."""
    return counts.join(populations.select("population"), "population", "left_anti")
