"""Profiles of a measurement table: coverage, ranges, correlations, quantile windows, feasible sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.columns import case, in_range, percent, unpivot
from assayframe.operators.filters import in_property_range
from assayframe.operators.scale import chunk_of, cut_points, fits_one_task, percentile_pays, quantiles, running
from assayframe.sources.registry import Property, Registry
from assayframe.sources.storage import cut_lineage


def coverage(df: DataFrame, registry: Registry) -> DataFrame:
    """Non-null rows and share per property, from one pass."""
    counted = df.agg(F.count("*").alias("_all"), *[F.count(e.column).alias(f"_{i}") for i, e in enumerate(registry.entries)])
    rows = [F.struct(F.lit(e.key).alias("property"), F.col(f"_{i}").alias("n_rows")) for i, e in enumerate(registry.entries)]
    return counted.select("_all", F.inline(F.array(*rows))).select(
        "property", "n_rows", percent(F.col("n_rows"), F.col("_all")).alias("pct")
    )


def range_audit(df: DataFrame, registry: Registry) -> DataFrame:
    """Rows inside, outside and missing per property, from one pass."""
    tests = []
    for i, entry in enumerate(registry.entries):
        inside = in_property_range(entry)
        tests += [
            F.count_if(inside).alias(f"in{i}"),
            F.count_if(F.col(entry.column).isNotNull() & ~inside).alias(f"out{i}"),
            F.count_if(F.col(entry.column).isNull()).alias(f"no{i}"),
        ]
    rows = [
        F.struct(
            F.lit(entry.key).alias("property"), F.col(f"in{i}").alias("inside"),
            F.col(f"out{i}").alias("outside"), F.col(f"no{i}").alias("missing"),
        )
        for i, entry in enumerate(registry.entries)
    ]
    return df.agg(*tests).select(F.inline(F.array(*rows)))


def range_audit_long(df: DataFrame, registry_frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same audit for a registry that is only known as a table: unpivot, join, count.

    The registry has a fixed handful of rows, so its broadcast never grows with the data.
    """
    long = unpivot(df, [], list(columns), "column", "value")
    joined = long.join(F.broadcast(registry_frame.select("key", "column", "low", "high")), "column")
    inside = in_range("value", F.col("low"), F.col("high"))
    return joined.groupBy(F.col("key").alias("property")).agg(
        F.count_if(inside).alias("inside"),
        F.count_if(F.col("value").isNotNull() & ~inside).alias("outside"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )


def window_audit(df: DataFrame, entry: Property) -> DataFrame:
    """Non-null rows of one property, inside and outside its range."""
    inside = in_property_range(entry)
    return df.agg(
        F.count(entry.column).alias("present"),
        F.count_if(inside).alias("inside"),
        F.count_if(F.col(entry.column).isNotNull() & ~inside).alias("outside"),
    )


def with_square(df: DataFrame, columns: Sequence[str], source: str, name: str) -> DataFrame:
    """A narrow projection plus the square of one column."""
    return df.select(*columns).withColumn(name, F.col(source) * F.col(source))


def identity_residual(df: DataFrame, left: str, static: str, index: str, *, rows_bound: int | None = None) -> DataFrame:
    """Largest and median ``abs(left - (static - 1 + index^2))`` over rows with all three columns."""
    complete = df.select(left, static, index).dropna(subset=[left, static, index])
    square = F.col(index) * F.col(index)
    residual = complete.select(F.abs(F.col(left) - (F.col(static) - F.lit(1.0) + square)).alias("residual"))
    largest = residual.agg(F.count("*").alias("n_rows"), F.max("residual").alias("max_residual"))
    return beside(largest, quantiles(residual, {"median_residual": ("residual", 0.5)}, rows_bound=rows_bound))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row (an equi-join on a constant, one row each)."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def column_minimum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("minimum"))


def violation_share(df: DataFrame, mask: Column, value: str, root: str) -> DataFrame:
    """Rows inside ``mask`` with ``value < root^2``, the rows carrying both, and the percentage."""
    square = F.col(root) * F.col(root)
    both = F.col(value).isNotNull() & square.isNotNull()
    counted = df.where(mask).agg(
        F.count_if(both & (F.col(value) < square)).alias("violations"), F.count_if(both).alias("population")
    )
    return counted.withColumn("pct", percent(F.col("violations"), F.col("population")))


def _average_ranks(counted: DataFrame, side: str, columns: Sequence[str], cuts: Mapping[str, list]) -> DataFrame:
    """Average rank of every distinct value of ``side`` within its pair, in chunks of the pair's column."""
    entries = counted.groupBy("pair", side).agg(F.sum("c").alias("_n"))
    chunk = case((F.col("pair") == i, chunk_of(F.col(side), cuts[column])) for i, column in enumerate(columns))
    ranked = running(entries, ["pair"], [side], {"_upto": ("sum", F.col("_n"))}, chunk=chunk)
    return ranked.select("pair", side, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"r{side}"))


def rank_correlation(
    df: DataFrame, mask: Column, pairs: Sequence[tuple[str, str]], *, rows_bound: int | None = None
) -> DataFrame:
    """Spearman correlation per column pair over complete rows inside ``mask``.

    All pairs unfold from one scan and collapse to distinct value pairs with a
    count before they are ranked; the Pearson sums of the ranks combine on the
    map side.
    """
    kept = df.where(mask)
    number = lambda name: F.col(name).cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), number(left).alias("x"), number(right).alias("y")) for i, (left, right) in enumerate(pairs)])
    counted = kept.select(F.inline(cells)).dropna().groupBy("pair", "x", "y").agg(F.count("*").alias("c"))
    if fits_one_task(rows_bound):
        ranks = {}
        for side in ("x", "y"):
            upto = F.sum("c").over(Window.partitionBy("pair").orderBy(side).rangeBetween(Window.unboundedPreceding, Window.currentRow))
            ranks[f"r{side}"] = upto - (F.sum("c").over(Window.partitionBy("pair", side)) - 1) / 2
        ranked = counted.withColumns(ranks)
    else:
        counted = cut_lineage(counted)  # read by both rankings and the sums
        columns = sorted({name for pair in pairs for name in pair})
        cuts = cut_points(kept.select(*[number(name).alias(name) for name in columns]), columns)
        rx, ry = (_average_ranks(counted, side, [pair[i] for pair in pairs], cuts) for i, side in enumerate(("x", "y")))
        ranked = counted.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
    sums = ranked.groupBy("pair").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("yy"),
    )
    # The mean of average ranks is exactly (n + 1) / 2.
    shift = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    spread = F.sqrt((F.col("xx") - shift) * (F.col("yy") - shift))
    names = df.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "pair int, left_column string, right_column string")
    return names.join(sums, "pair", "left").select(
        "left_column", "right_column", F.when(spread > 0, (F.col("xy") - shift) / spread).alias("spearman")
    )


def quantile_window(
    df: DataFrame, mask: Column, high: tuple[str, float], low: tuple[str, float], *, rows_bound: int | None = None
) -> DataFrame:
    """Rows inside ``mask`` at or above a quantile of one column and at or below a quantile of another."""
    kept = df.where(mask)
    bounds = quantiles(kept, {"high_cut": high, "low_cut": low}, rows_bound=rows_bound)
    joined = kept.select(high[0], low[0], F.lit(1).alias("_one")).join(
        F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one"  # exactly one row
    )
    inside = (F.col(high[0]) >= F.col("high_cut")) & (F.col(low[0]) <= F.col("low_cut"))
    counted = joined.agg(F.count_if(inside).alias("n_rows"), F.count("*").alias("population"))
    return counted.withColumn("pct", percent(F.col("n_rows"), F.col("population")))


def descriptives(df: DataFrame, column: str, *, rows_bound: int | None = None) -> DataFrame:
    """Median, 95th and 99th percentile and maximum of the rows that carry the column."""
    wanted = {"median": (column, 0.5), "p95": (column, 0.95), "p99": (column, 0.99)}
    present = df.select(column).where(F.col(column).isNotNull())
    return beside(quantiles(present, wanted, rows_bound=rows_bound), present.agg(F.max(column).alias("maximum")))


def population_medians(df: DataFrame, mask: Column, column: str, *, rows_bound: int | None = None) -> DataFrame:
    """Median of a column over all rows and over the rows inside ``mask``."""
    both = df.select(F.col(column).alias("all_rows"), F.when(mask, F.col(column)).alias("masked_rows"))
    return quantiles(
        both, {"median_all": ("all_rows", 0.5), "median_masked": ("masked_rows", 0.5)}, rows_bound=rows_bound
    )


def feasible_set(
    candidates: DataFrame, limited: str, required: str, minimum: float, *, q: float = 0.25, rows_bound: int | None = None
) -> DataFrame:
    """Candidates at or below a quantile of one median and at or above a minimum of another."""
    narrow = candidates.select(F.col(limited).alias("limited"), F.col(required).alias("required"))
    if not percentile_pays(rows_bound):
        narrow = cut_lineage(narrow)  # two columns of a table that is costly to derive, read several times
    bound = quantiles(narrow, {"quantile_cut": ("limited", q)}, rows_bound=rows_bound)
    joined = narrow.withColumn("_one", F.lit(1)).join(F.broadcast(bound.withColumn("_one", F.lit(1))), "_one")
    inside = (F.col("limited") <= F.col("quantile_cut")) & (F.col("required") >= F.lit(minimum))
    counted = joined.agg(
        F.max("quantile_cut").alias("quantile_cut"), F.count_if(inside).alias("n_feasible"), F.count("*").alias("n_population")
    )
    return counted.withColumn("pct", percent(F.col("n_feasible"), F.col("n_population")))


def feasible_rows(df: DataFrame, mask: Column, limited: str, cut: float, required: str, minimum: float) -> DataFrame:
    """Rows inside ``mask`` under a ceiling of one column and over a floor of another."""
    inside = (F.col(limited) <= F.lit(cut)) & (F.col(required) >= F.lit(minimum))
    return df.where(mask).agg(F.count_if(inside).alias("n_rows"))


def distinct_battery(df: DataFrame, columns: Sequence[str], claimed: int | None = None) -> DataFrame:
    """Distinct count of each present column and of the rows, and whether it equals a claimed number."""
    present = [name for name in columns if name in df.columns]
    counted = df.agg(F.count("*").alias("rows"), *[F.count_distinct(name).alias(f"d_{name}") for name in present])
    rows = [F.struct(F.lit("rows").alias("quantity"), F.col("rows").alias("n"))]
    rows += [F.struct(F.lit(f"distinct {name}").alias("quantity"), F.col(f"d_{name}").alias("n")) for name in present]
    battery = counted.select(F.inline(F.array(*rows)))
    return battery if claimed is None else battery.withColumn("matches_claim", F.col("n") == F.lit(claimed))
