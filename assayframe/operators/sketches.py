"""Distinct counts and quantiles from stored, mergeable sketches: approximations, under names of their own.

Sketches are built once per group (a day, say) and stored; any coarser group is
answered by merging them, without reading the rows again.  New days are appended
as new rows.  The exact operators are ``profile.distinct_battery`` and
``scale.quantiles``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes of the sketches: 2^14 registers, and the accuracy parameter of the quantiles.
LG_REGISTERS, QUANTILE_SIZE = 14, 800
# Three standard errors of a merged distinct count, as a share of it; and of a rank, as a share of all rows.
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LG_REGISTERS)
RANK_ERROR = 0.01


def build_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, column, n, distinct_sketch, quantile_sketch): one row per group and column; missing values take no part.

    Rows are combined on the map side, so what is shuffled is a few kilobytes per
    task, group and column.  Quantiles are of the values as doubles.
    """
    value = F.col("_v.value")
    measured = [F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("value")) for name in columns]
    long = df.select(*by, F.explode(F.array(*measured)).alias("_v")).where(value.isNotNull() & ~F.isnan(value))
    return long.groupBy(*by, F.col("_v.column").alias("column")).agg(
        F.count("*").alias("n"),
        # 0.0 is added so that -0.0 counts as 0.0.
        F.hll_sketch_agg(F.xxhash64(value + F.lit(0.0)), LG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(value, QUANTILE_SIZE).alias("quantile_sketch"),
    )


def roll_up(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch", QUANTILE_SIZE).alias("quantile_sketch")
    )


def approx_distinct() -> Column:
    """The distinct count that a row's sketch stands for, within ``DISTINCT_ERROR`` of it."""
    return F.hll_sketch_estimate("distinct_sketch")


def approx_quantile(q: float) -> Column:
    """A value whose rank is within ``RANK_ERROR`` of ``q``."""
    return F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))
