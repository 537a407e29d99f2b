"""Tables in buckets of their key."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from assayframe.plans import lookup, tables
from assayframe.sources.bucketed import write_bucketed


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exchanges_above(plan: str, relation: str) -> int:
    """Shuffles between the join and the scan of ``relation`` in a plan printed as a tree."""
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if relation in line and "Scan" in line)
    depth, count = len(lines[scan]) - len(lines[scan].lstrip(" :+-*(0123456789)")), 0
    for line in reversed(lines[:scan]):
        here = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if here < depth:
            depth = here
            if "Join" in line:
                return count
            count += "Exchange" in line
    raise AssertionError(plan)


@pytest.mark.skipif(not Path(driver.SMOKE_DIR).is_dir(), reason="the given tables are not here")
def test_a_request_batch_shuffles_only_itself(spark, no_broadcast, tmp_path):
    asked = tables.lookups(spark, driver.SMOKE_DIR, 1_000_000)
    plain = tables.candidates(spark, driver.SMOKE_DIR)
    held = write_bucketed(plain, str(tmp_path / "table"), "candidate_id", 4, name="bucketed_test")
    answered = lookup.answered_status(asked, held)
    assert exchanges_above(answered._jdf.queryExecution().executedPlan().toString(), "bucketed_test") == 0
    assert exchanges_above(lookup.answered_status(asked, plain)._jdf.queryExecution().executedPlan().toString(), "part.parquet") == 1
    key = lambda row: repr(row)
    assert sorted(answered.collect(), key=key) == sorted(lookup.answered_status(asked, plain).collect(), key=key)


def test_one_file_per_bucket(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    held = write_bucketed(rows.repartition(7), str(tmp_path / "ids"), "id", 5)
    assert len(list((tmp_path / "ids").glob("*.parquet"))) == 5
    assert held.agg(F.sum("v")).first()[0] == 999_000
