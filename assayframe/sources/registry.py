"""The property registry: a small, fixed dimension that describes each measured column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.columns import case

# The roles and unit states a registry may use.
ROLES = ("objective", "constraint", "intermediate", "validator")
UNIT_STATUSES = ("verified", "unverified")

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("unit", T.StringType()),
        T.StructField("unit_status", T.StringType()),
        T.StructField("unit_note", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("keep_flag", T.BooleanType()),
        T.StructField("ladder", T.ArrayType(T.DoubleType())),
    ]
)


class Property(NamedTuple):
    """One registry entry."""

    key: str
    column: str
    unit: str
    role: str
    low: float
    high: float
    keep_flag: bool | None = None
    ladder: tuple[float, ...] | None = None
    unit_status: str = "verified"
    unit_note: str | None = None


class Registry:
    """Lookups over the entries; ``frame`` turns them into a DataFrame."""

    def __init__(self, entries: Sequence[Property]) -> None:
        self.entries = tuple(entries)

    def by_key(self, key: str) -> Property:
        return next(entry for entry in self.entries if entry.key == key)

    def by_column(self, column: str) -> Property:
        return next(entry for entry in self.entries if entry.column == column)

    def by_role(self, role: str) -> tuple[Property, ...]:
        return tuple(entry for entry in self.entries if entry.role == role)

    def columns(self) -> list[str]:
        return [entry.column for entry in self.entries]

    def objective(self) -> Property:
        """The single objective; any other number of objectives is an error."""
        found = self.by_role("objective")
        if len(found) != 1:
            raise ValueError(f"a registry needs exactly one objective, this one has {len(found)}")
        return found[0]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (e.key, e.column, e.unit, e.unit_status, e.unit_note, e.role, float(e.low), float(e.high),
             e.keep_flag, list(e.ladder) if e.ladder else None)
            for e in self.entries
        ]
        return spark.createDataFrame(rows, REGISTRY_SCHEMA)

    def pick(self, key: Column, suffix: str = "") -> Column:
        """The value of the registered column that ``key`` names, NULL for any other key."""
        return case((key == entry.key, F.col(entry.column + suffix)) for entry in self.entries)


def registry_violations(registry: DataFrame, expected_keys: Sequence[str]) -> DataFrame:
    """Rows ``(key, rule)`` for every broken registry rule."""
    expected = registry.sparkSession.createDataFrame([(key,) for key in expected_keys], "key string")
    rules = {
        "range must be an ordered pair": F.col("low").isNull() | F.col("high").isNull() | (F.col("low") > F.col("high")),
        "role is not known": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)),
        "unit status is not known": ~F.coalesce(F.col("unit_status").isin(*UNIT_STATUSES), F.lit(False)),
        "unverified unit needs a note": (F.col("unit_status") == "unverified")
        & (F.coalesce(F.length("unit_note"), F.lit(0)) == 0),
        "ladder rungs must be positive and distinct": F.exists("ladder", lambda rung: rung <= 0)
        | (F.size(F.array_distinct("ladder")) != F.size("ladder")),
        "column is not an identifier": ~F.coalesce(F.col("column").rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False)),
    }
    broken = registry.select(
        "key", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))).alias("rule")
    )
    missing = expected.join(registry, "key", "left_anti").select("key", F.lit("key is missing").alias("rule"))
    extra = registry.join(expected, "key", "left_anti").select("key", F.lit("key is not expected").alias("rule"))
    repeated = registry.groupBy("key").count().where("count > 1").select("key", F.lit("key repeats").alias("rule"))
    return broken.unionByName(missing).unionByName(extra).unionByName(repeated)
