"""Row predicates and the count ladders built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.columns import in_range
from assayframe.sources.registry import Property, Registry


def in_property_range(entry: Property, suffix: str = "") -> Column:
    """Inclusive physical range of a registered column; missing is outside."""
    return in_range(entry.column + suffix, F.lit(entry.low), F.lit(entry.high))


def core_triple(registry: Registry, triple: Sequence[str], suffix: str = "") -> Column:
    """First property present, second and third in range."""
    first, second, third = (registry.by_key(key) for key in triple)
    present = F.col(first.column + suffix).isNotNull()
    return present & in_property_range(second, suffix) & in_property_range(third, suffix)


def passes_flag(registry: Registry, flag: str) -> Column:
    """The flag equals the value the single objective keeps; no filter lets all pass."""
    keep = registry.objective().keep_flag
    if keep is None:
        return F.lit(True)
    return F.coalesce(F.col(flag) == F.lit(keep), F.lit(False))


def count_steps(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows passing each named condition, from one pass: ``position, step, n_rows``."""
    counted = df.agg(*[F.count_if(test).alias(f"s{i}") for i, test in enumerate(steps.values())])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n_rows"))
            for i, name in enumerate(steps)
        ]
    )
    return counted.select(F.inline(rows))


def triple_ladder(df: DataFrame, registry: Registry, triple: Sequence[str]) -> DataFrame:
    """The five cumulative steps from all rows to the core triple."""
    first, second, third = (registry.by_key(key) for key in triple)
    has_first = F.col(first.column).isNotNull()
    ranged = has_first & in_property_range(second)
    return count_steps(
        df,
        {
            "all rows": F.lit(True),
            f"{first.key} present": has_first,
            f"{second.key} present": has_first & F.col(second.column).isNotNull(),
            f"{second.key} in range": ranged,
            f"{third.key} in range": ranged & in_property_range(third),
        },
    )


def ceiling_ladder(df: DataFrame, registry: Registry, triple: Sequence[str], ceilings: Sequence[float]) -> DataFrame:
    """Rows with the second property below each alternative ceiling, the rest of the triple kept."""
    first, second, third = (registry.by_key(key) for key in triple)
    base = F.col(first.column).isNotNull() & in_property_range(third)
    steps = {f"{second.key} present": base & F.col(second.column).isNotNull()}
    steps |= {f"{second.key} <= {ceiling:g}": base & (F.col(second.column) <= F.lit(ceiling)) for ceiling in ceilings}
    return count_steps(df, steps)


def rung_ladder(df: DataFrame, mask: Column, error: str, entry: Property) -> DataFrame:
    """Rows inside ``mask`` with an error at or below each rung of the entry's ladder."""
    rungs = entry.ladder or ()
    if not rungs:
        return df.sparkSession.createDataFrame([], "rung double, n_rows bigint")
    counted = df.where(mask).agg(*[F.count_if(F.col(error) <= F.lit(r)).alias(f"r{i}") for i, r in enumerate(rungs)])
    rows = [F.struct(F.lit(float(r)).alias("rung"), F.col(f"r{i}").alias("n_rows")) for i, r in enumerate(rungs)]
    return counted.select(F.inline(F.array(*rows)))


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag true, false and missing."""
    return df.agg(
        F.count_if(F.col(flag)).alias("n_true"),
        F.count_if(~F.col(flag)).alias("n_false"),
        F.count_if(F.col(flag).isNull()).alias("n_missing"),
    )


def holds(constraints: Column, values: Column) -> Column:
    """Every ``(property, op, value)`` of an array holds over a property-to-value map; missing fails."""

    def test(rule: Column) -> Column:
        value = F.try_element_at(values, rule["property"])
        met = F.when(rule["op"] == "<=", value <= rule["value"]).when(rule["op"] == ">=", value >= rule["value"])
        return F.coalesce(met, F.lit(False))

    return F.forall(constraints, test)


def holds_all(constraints: Sequence[tuple[str, str, float]], suffix: str = "") -> Column:
    """The same conjunction when the constraints are known while planning: plain, pushable comparisons."""
    met = F.lit(True)
    for column, op, bound in constraints:
        if op not in ("<=", ">="):
            raise ValueError(f"unknown operator {op!r}")
        value = F.col(column + suffix)
        test = value <= F.lit(bound) if op == "<=" else value >= F.lit(bound)
        met = met & F.coalesce(test, F.lit(False))
    return met
