"""Stored sketches against exact counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(int(day), float(v) if v > 0.02 else None, float(int(v * 40_000))) for day, v in zip(rng.integers(0, 30, 40_000), rng.random(40_000), strict=True)]
    return spark.createDataFrame(data, "day int, v double, w double").repartition(6).cache()


def test_rolled_up_sketches_are_within_their_errors(spark, rows, tmp_path):
    daily = sketches.build_sketches(rows, ["v", "w"], ["day"])
    daily.write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    merged = sketches.roll_up(stored).select("column", "n", sketches.approx_distinct().alias("d"), *[sketches.approx_quantile(q).alias(f"q{q}") for q in (0.1, 0.5, 0.9)])
    for row in merged.collect():
        values = np.sort(np.array([r[0] for r in rows.select(row["column"]).where(F.col(row["column"]).isNotNull()).collect()]))
        assert row["n"] == len(values)
        distinct = len(np.unique(values))
        assert abs(row["d"] - distinct) <= distinct * sketches.DISTINCT_ERROR
        for q in (0.1, 0.5, 0.9):
            low, high = np.searchsorted(values, row[f"q{q}"], "left") / len(values), np.searchsorted(values, row[f"q{q}"], "right") / len(values)
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR


def test_appended_days_and_coarser_groups(spark, rows):
    early, late = sketches.build_sketches(rows.where("day < 20"), ["w"], ["day"]), sketches.build_sketches(rows.where("day >= 20"), ["w"], ["day"])
    both = early.unionByName(late)
    halves = sketches.roll_up(both.withColumn("half", F.floor(F.col("day") / 15)), ["half"])
    assert halves.agg(F.sum("n")).first()[0] == rows.count()
    whole = sketches.roll_up(both).select(sketches.approx_distinct()).first()[0]
    distinct = rows.select("w").distinct().count()
    assert abs(whole - distinct) <= distinct * sketches.DISTINCT_ERROR


def test_missing_values_and_empty_tables(spark):
    table = spark.createDataFrame([(1, None), (1, float("nan")), (2, -0.0), (2, 0.0)], "day int, v double")
    got = sketches.build_sketches(table, ["v"], ["day"]).select("day", "n", sketches.approx_distinct(), sketches.approx_quantile(0.5)).collect()
    assert [tuple(row) for row in got] == [(2, 2, 1, 0.0)]
    assert sketches.roll_up(sketches.build_sketches(table.limit(0), ["v"], ["day"])).count() == 0
