"""What must hold as tables grow: which rows may move, and how often."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from assayframe.operators import lookups, metrics, scale
from assayframe.plans.tables import SERVED
from assayframe.sources import measurements, runlogs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def set_to(spark, **settings):
    """Settings of the session for a while; keyword settings use ``__`` for the dots."""
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def large_joins(spark):
    """No side of a join is taken for small unless the code says so."""
    with set_to(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        yield


def test_hits_do_not_gather_a_population(spark, large_joins):
    picks = spark.range(40).select(
        (F.col("id") % 4).alias("run_id"), F.lit(1).alias("iteration"), F.lit("b").alias("beam"), F.col("id").alias("candidate_id"),
        F.col("id").cast("double").alias("objective"), F.lit(True).alias("feasible"), F.when(F.col("id") >= 0, "all").alias("population"),
    )
    marks = spark.createDataFrame([("all", 20.0, 36.0), ("none", 0.0, 0.0)], "population string, top10 double, top1 double")
    found = metrics.hits(picks, marks, ["population"], F.lit(1.0))
    assert "SortMergeJoin" not in plan_of(found) and "BroadcastHashJoin" in plan_of(found)
    assert rows_of(found.orderBy("run_id").select("run_id", "hits_top10", "hits_top1")) == [(run, 5, 1) for run in range(4)]


def test_row_index_moves_no_row(spark, tmp_path, large_joins):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    indexed = measurements.with_row_index(spark.read.parquet(str(tmp_path / "t")))
    assert "SortMergeJoin" not in plan_of(indexed) and "BroadcastHashJoin" in plan_of(indexed)
    assert sorted(row["row_index"] for row in indexed.collect()) == list(range(100))


def test_log_lines_are_numbered_where_they_are_read(spark, tmp_path, large_joins):
    spark.range(0, 500, 1, 3).selectExpr("concat('line ', id) AS value").write.text(str(tmp_path / "log"))
    with set_to(spark, spark__sql__files__maxPartitionBytes="600", spark__sql__files__openCostInBytes="1"):
        lines = runlogs.read_log_lines(spark, str(tmp_path / "log"))
        assert "SortMergeJoin" not in plan_of(lines) and "BroadcastHashJoin" in plan_of(lines)
        found = {(row["file"].rsplit("/", 1)[1], row["line"]): row["value"] for row in lines.collect()}
    files = sorted((tmp_path / "log").glob("part-*"))
    assert found == {(file.name, n): text for file in files for n, text in enumerate(file.read_text().splitlines(), 1)}


def _asked(spark):
    """Lookups of 40 requests; one candidate is in every request, some come twice in one."""
    rows = [
        (seq % 3, seq, entry, at, candidate, prop)
        for seq in range(40) for entry, candidate in enumerate((0, seq % 7, seq % 2)) for at, prop in enumerate(("retail", "size", "weight"))
    ]
    return spark.createDataFrame(rows, "run_id long, request_seq long, entry_pos int, prop_pos int, candidate_id long, property string")


def test_few_lookups_a_candidate_need_no_second_shuffle(spark, large_joins):
    parts = spark.range(6).selectExpr(
        "id AS candidate_id", "IF(id = 2, NULL, id * 1.5D) AS retail_median", "2L AS retail_n", "0.5D AS retail_std",
        "id * 2D AS size_median", "1L AS size_n", "0D AS size_std",
    )
    asked = _asked(spark)
    by_candidate = lookups.evaluate(asked.repartition(4, "candidate_id"), parts, SERVED, candidate_bound=300)
    counted = lookups.evaluate(asked, parts, SERVED, hot_rows=2)
    assert "Exchange hashpartitioning(run_id" not in plan_of(by_candidate)
    assert sorted(map(str, rows_of(by_candidate))) == sorted(map(str, rows_of(counted)))


@pytest.mark.parametrize("hot", [2, 10, 1_000])
def test_running_by_size(spark, monkeypatch, hot):
    monkeypatch.setattr(scale, "HOT_ROWS", hot)
    rows = spark.range(60).selectExpr("IF(id % 3 = 0, 0, id % 20) AS key", "id AS at")
    found = scale.running_by_size(rows, ["key"], ["at"], {"place": ("sum", F.lit(1))}, chunk=F.floor(F.col("at") / 7), rows_bound=None)
    if hot == 1_000:
        assert "Join" not in plan_of(found)  # no key is large, so nothing is stitched together
    expected, seen = set(), {}
    for at in range(60):
        key = 0 if at % 3 == 0 else at % 20
        seen[key] = seen.get(key, 0) + 1
        expected.add((key, at, seen[key]))
    assert set(rows_of(found.select("key", "at", "place"))) == expected
