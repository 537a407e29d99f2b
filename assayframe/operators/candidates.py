"""The candidate table and everything measured on replicates of a candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.columns import content_id
from assayframe.operators.filters import core_triple
from assayframe.operators.scale import chunked_quantiles, fits_one_map, group_quantiles, split_by_group_size
from assayframe.sources.registry import Registry
from assayframe.sources.storage import cut_lineage

MIN_REPLICATES = 2

Key = str | Sequence[str]


def key_columns(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_candidate_id(candidates: DataFrame, structure_key: str, label: str) -> DataFrame:
    """Add the content id to a table grouped by its natural key."""
    return candidates.withColumn("candidate_id", content_id(structure_key, label))


def build_candidates(
    rows: DataFrame, properties: Sequence[str], *, key: Key = "candidate_id", carry: Sequence[str] = (),
    rows_bound: int | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """One row per candidate: exact median, non-null count, min, max and sample std per property.

    ``key`` may be the natural key (structure key and label), which spares a
    hash per row; ``with_candidate_id`` then adds the id once per candidate.

    Everything but the median combines on the map side.  The medians of small
    candidates, which a count tells from large ones, are taken in the same pass;
    a candidate with a third of all rows is ranked in chunks over many tasks.
    """
    plain = [F.count("*").alias("n_rows")]
    for name in properties:
        plain += [
            F.count(name).alias(f"{name}_n"),
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
            F.stddev_samp(name).alias(f"{name}_std"),
        ]
    plain += [F.min(name).alias(name) for name in carry]
    if not properties:
        return rows.groupBy(*key_columns(key)).agg(*plain)
    wanted = {f"{name}_median": (name, 0.5) for name in properties}
    medians = [F.median(name).alias(f"{name}_median") for name in properties]
    if fits_one_map(rows_bound):
        return rows.groupBy(*key_columns(key)).agg(*medians, *plain)
    parts = []
    calm, hot = split_by_group_size(rows, key_columns(key), hot_rows)
    if calm is not None:
        parts.append(calm.groupBy(*key_columns(key)).agg(*medians, *plain))
    if hot is not None:
        ranked = chunked_quantiles(hot, key_columns(key), wanted).withColumnsRenamed({name: f"_of_{name}" for name in key_columns(key)})
        same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in key_columns(key)]
        parts.append(hot.groupBy(*key_columns(key)).agg(*plain).join(ranked, same, "left").drop(*[f"_of_{name}" for name in key_columns(key)]))
    return reduce(DataFrame.unionByName, parts)


def replicate_structure(candidates: DataFrame) -> DataFrame:
    """Candidates, those with several rows, the rows in them and the largest."""
    several = F.col("n_rows") >= MIN_REPLICATES
    return candidates.agg(
        F.count("*").alias("n_candidates"),
        F.count_if(several).alias("n_multi_row"),
        F.coalesce(F.sum(F.when(several, F.col("n_rows"))), F.lit(0)).alias("rows_in_multi_row"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("max_rows"),
    )


def size_histogram(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("n_rows").agg(F.count("*").alias("n_candidates")).orderBy("n_rows")


def noise_floor(
    candidates: DataFrame, properties: Sequence[str], *, rows_bound: int | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Per property, over candidates with two or more values: typical absolute and relative spread.

    A zero median drops a candidate from the relative figures only.
    """
    long = candidates.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("property"),
                        F.col(f"{name}_n").alias("n"),
                        F.col(f"{name}_std").alias("abs_std"),
                        F.abs(f"{name}_median").alias("scale"),
                    )
                    for name in properties
                ]
            )
        )
    )
    replicated = long.where(F.col("n") >= MIN_REPLICATES).select(
        "property", "abs_std", F.when(F.col("scale") > 0, F.col("abs_std") / F.col("scale")).alias("rel_std")
    )
    if fits_one_map(rows_bound):
        return replicated.groupBy("property").agg(
            F.count("*").alias("n_groups"),
            F.median("abs_std").alias("median_abs_std"),
            F.median("rel_std").alias("median_rel_std"),
            F.percentile("rel_std", F.lit(0.9)).alias("p90_rel_std"),
        )
    # Several passes follow over a narrow table that is costly to derive.
    replicated = cut_lineage(replicated)
    groups = replicated.groupBy("property").agg(F.count("*").alias("n_groups"))
    floors = group_quantiles(
        replicated, ["property"],
        {"median_abs_std": ("abs_std", 0.5), "median_rel_std": ("rel_std", 0.5), "p90_rel_std": ("rel_std", 0.9)},
        hot_rows=hot_rows,
    )
    return groups.join(floors, "property", "left")


def noise_floor_on_rows(
    rows: DataFrame, mask: Column, properties: Sequence[str], *, key: Key = "candidate_id", rows_bound: int | None = None
) -> DataFrame:
    """Filter rows, group, then take the floor."""
    candidates = build_candidates(rows.where(mask), properties, key=key, rows_bound=rows_bound)
    return noise_floor(candidates, properties, rows_bound=rows_bound)


def _constant(column: str) -> Column:
    """The column has one value in the group, NULL counting as a value."""
    present = F.count(column)
    return (present == 0) | ((present == F.count("*")) & (F.min(column) == F.max(column)))


def version_split(rows: DataFrame, versions: Sequence[str], *, key: Key = "candidate_id") -> DataFrame:
    """Replicated candidates measured under one version of every column, and under several.

    Group sizes and versions come from the same map-side combined pass; the
    single-row candidates drop out of its result, not of a second scan.
    """
    same = F.lit(True)
    for column in versions:
        if column in rows.columns:
            same = same & _constant(column)
    groups = rows.groupBy(*key_columns(key)).agg(F.count("*").alias("n_rows"), same.alias("same"))
    return groups.where(F.col("n_rows") >= MIN_REPLICATES).agg(
        F.count_if("same").alias("same_version"), F.count_if(~F.col("same")).alias("cross_version")
    )


def rows_of_replicated(rows: DataFrame, candidates: DataFrame, *, key: Key = "candidate_id") -> DataFrame:
    """Rows of candidates that have several."""
    several = candidates.where(F.col("n_rows") >= MIN_REPLICATES).select(*key_columns(key))
    return rows.join(several, key_columns(key), "left_semi")


def candidate_population(
    rows: DataFrame, registry: Registry, triple: Sequence[str], order: str, *, key: Key = "candidate_id",
    carry: Sequence[str] = (), rows_bound: int | None = None,
) -> DataFrame:
    """Candidates of the core triple; the two orders give different populations."""
    columns = registry.columns()
    if order == "filter_then_median":
        kept = rows.where(core_triple(registry, triple))
        return build_candidates(kept, columns, key=key, carry=carry, rows_bound=rows_bound)
    if order == "median_then_filter":
        table = build_candidates(rows, columns, key=key, carry=carry, rows_bound=rows_bound)
        return table.where(core_triple(registry, triple, "_median"))
    raise ValueError(f"unknown order {order!r}")
