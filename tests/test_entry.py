"""The driver contract: registered names, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from assayframe.operators import scale

SF_DIR = Path(driver.SMOKE_DIR)
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_names():
    assert driver.FLAGSHIP in QUERIES
    assert set(ORACLES) <= set(QUERIES)
    assert {name for name in set(QUERIES) - set(ORACLES) if name != "pipeline" and not name.startswith("op")} == set()


def test_entry(spark):
    assert driver.entry(spark).count() == 4


def compare(spark, db, name):
    df = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
    assert got == expected
    assert not any(isinstance(v, float) and math.isnan(v) for row in got for v in row)


@pytest.mark.parametrize("name", [name for name in ORACLES if not name.startswith("op")])
def test_query_agrees_with_sql(spark, db, name):
    compare(spark, db, name)


LARGE = [
    "candidate_build", "noise_floor", "feasible_set", "rank_correlation", "quantile_window", "population_capture", "evaluate_cached_charged",
    "budget_cutoff", "budget_greedy", "run_metrics", "log_lifecycle", "replay_conformance", "topk_thresholds",
]
NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
}


@pytest.mark.parametrize("name", LARGE)
def test_the_ways_for_large_tables_agree_too(spark, db, monkeypatch, name):
    """Every size limit shrunk below the tables, no automatic broadcast, skewed joins split."""
    for limit, value in {"TASK_ROWS": 2_000, "HOT_ROWS": 500, "PERCENTILE_ROWS": 500, "POSITION_WIDTH": 1_000}.items():
        monkeypatch.setattr(scale, limit, value)
    before = {key: spark.conf.get(key, None) for key in NO_BROADCAST}
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    try:
        compare(spark, db, name)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_the_report_builds_its_candidates_once(spark, monkeypatch):
    """One table of all candidates serves two sections; the feasible ones are another population."""
    from assayframe.operators import candidates

    built, real = [], candidates.build_candidates
    monkeypatch.setattr(candidates, "build_candidates", lambda rows, properties, **how: built.append(tuple(properties)) or real(rows, properties, **how))
    QUERIES["validation_report"](spark, str(SF_DIR))
    assert len(built) == 2 and all(built)
