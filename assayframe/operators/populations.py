"""Reference populations: who belongs, and the values the evaluator serves for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators.candidates import Key, key_columns
from assayframe.operators.filters import core_triple, passes_flag
from assayframe.operators.metrics import population_order
from assayframe.sources.registry import Registry

# The two populations every run is reported against.
FLAGGED, UNFLAGGED = "flagged", "triple"


def population_members(rows: DataFrame, registry: Registry, triple: Sequence[str], flag: str, *, key: Key = "candidate_id") -> DataFrame:
    """Candidates with at least one row in the core triple, and those with one that also passes the flag.

    One pass: a candidate's two memberships are two map-side combined flags.
    """
    inside = core_triple(registry, triple)
    kept = rows.where(inside).groupBy(*key_columns(key)).agg(F.bool_or(passes_flag(registry, flag)).alias("_passes"))
    names = F.when(F.col("_passes"), F.array(F.lit(FLAGGED), F.lit(UNFLAGGED))).otherwise(F.array(F.lit(UNFLAGGED)))
    return kept.select(F.explode(names).alias("population"), *key_columns(key))


def capture(
    rows: DataFrame, candidates: DataFrame, registry: Registry, triple: Sequence[str], flag: str, constraints: Sequence[str],
    *, key: Key = "candidate_id", rows_bound: int | None = None,
) -> DataFrame:
    """Both populations as ordered records ``population, objective, <constraint>…, n, pos``.

    Membership comes from the filtered rows, values from all rows of a member:
    a candidate belongs because one of its rows qualifies and is reported with
    the median the evaluator serves.
    """
    members = population_members(rows, registry, triple, flag, key=key)
    served = candidates.select(
        *key_columns(key), F.col(f"{registry.objective().column}_median").alias("objective"),
        *[F.col(f"{registry.by_key(name).column}_median").alias(name) for name in constraints],
    )
    valued = members.join(served, key_columns(key), "left")
    return population_order(valued, ["population"], list(constraints), rows_bound=rows_bound)
