"""Comparing stored tables by trees of digests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import digests

SPEC = "k long, part string, value double, note string, n long"


def rows(count=3000):
    rng = random.Random(4)
    return [(i, "ab"[i % 2] if i % 50 else None, rng.random() if i % 7 else None, f"note {i % 11}" if i % 13 else None, i % 5) for i in range(count)]


def compared(spark, tmp_path, one, other, tolerance=0.0, leaf_rows=20):
    shape = digests.Shape.for_rows(len(one), leaf_rows)
    here = digests.store(spark.createDataFrame(one, SPEC).repartition(3), ["k", "part"], str(tmp_path / "one"), shape)
    there = digests.store(spark.createDataFrame(other, SPEC).repartition(5), ["k", "part"], str(tmp_path / "other"), shape)
    found = digests.differences(spark, here, there, ["k", "part"], tolerance=tolerance)
    return sorted((tuple(row) for row in found.collect()), key=repr), digests.differing_leaves(spark, here, there), here


def test_equal_tables_differ_nowhere_and_stop_at_the_root(spark, tmp_path):
    data = rows()
    found, leaves, here = compared(spark, tmp_path, data, data[::-1])
    assert (found, leaves.count()) == ([], 0)
    assert digests.read_level(spark, here.path, 0).select("n").first()[0] == len(data)
    assert here.shape.levels() == [0, 4, 8]


def test_planted_differences_are_found_and_little_else_is_read(spark, tmp_path):
    data = rows()
    other = [list(row) for row in data]
    other[17][2] = 5.5
    other[400][3], other[400][4] = None, 77
    other[1300][2] = (other[1300][2] or 0) + 1e-12
    lost, new = data[900], (10**12, "z", 1.0, "new", 1)
    del other[900]
    found, leaves, here = compared(spark, tmp_path, data, [tuple(row) for row in other] + [new], tolerance=1e-9)
    assert found == sorted(
        [
            (17, "b", "value", str(data[17][2]), "5.5"), (400, None, "note", data[400][3], None), (400, None, "n", str(data[400][4]), "77"),
            (900, None, "(row)", None, None), (10**12, "z", "(row)", None, None),
        ], key=repr,
    )
    assert lost[0] == 900
    assert leaves.count() == 5
    doubt = digests.rows_in_doubt(here, leaves)
    assert doubt.count() < 5 * 60
    # Only the folders of these leaves are opened, and the list of leaves reaches the row groups.
    doubt.collect()
    plan = doubt._jdf.queryExecution().executedPlan().toString()
    assert "_folder" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "In(_slot" in plan.split("PushedFilters: ")[1]


def test_shifted_keys_differ_in_every_row(spark, tmp_path):
    data = rows(300)
    shifted = [(k + 1_000_000, *rest) for k, *rest in data]
    found, _, _ = compared(spark, tmp_path, data, shifted)
    assert len(found) == 600
    assert {row[2] for row in found} == {"(row)"}


@pytest.mark.parametrize("leaf_rows", [1, 1_000_000])
def test_repeated_keys_are_bags(spark, tmp_path, leaf_rows):
    one = [(1, "a", 1.0, "x", 1)] * 1000 + [(2, "a", 1.0, "x", 1), (2, "a", 2.0, "x", 1)] + [(3, None, None, None, None)] * 2
    other = [(1, "a", 1.0, "x", 1)] * 998 + [(2, "a", 2.0, "x", 1), (2, "a", 1.5, "x", 1)] + [(3, None, None, None, None)] * 3 + [(4, "a", -0.0, "", 0)]
    found, _, _ = compared(spark, tmp_path, [*one, (4, "a", 0.0, "", 0)], other, leaf_rows=leaf_rows)
    assert found == sorted(
        [(1, "a", "(row)", None, None)] * 2 + [(2, "a", "value", "1.0", "1.5"), (3, None, "(row)", None, None)], key=repr
    )


def test_an_empty_side(spark, tmp_path):
    found, _, _ = compared(spark, tmp_path, rows(40), [])
    assert len(found) == 40


def test_neighbouring_columns_do_not_run_together(spark, tmp_path):
    found, _, _ = compared(spark, tmp_path, [(1, "a", None, "1:2", 3)], [(1, "a", None, "1", 23)])
    assert [row[2] for row in found] == ["n", "note"]


def test_content_of_other_types_counts(spark, tmp_path):
    one = spark.range(20).select("id", F.array("id").alias("list"), F.struct("id").alias("s"), F.to_date(F.lit("2024-01-01")).alias("day"), F.lit(b"x").alias("raw"))
    other = one.withColumn("list", F.when(F.col("id") == 3, F.array(F.lit(9).cast("long"))).otherwise(F.col("list")))
    here = digests.store(one, ["id"], str(tmp_path / "a"))
    there = digests.store(other, ["id"], str(tmp_path / "b"), here.shape)
    found = digests.differences(spark, here, there, ["id"]).collect()
    assert [(row["id"], row["column"]) for row in found] == [(3, "list")]


def test_stored_metrics_are_not_written_twice(spark, monkeypatch):
    """What is stored for the comparison comes from a written table: it is counted, and written only where it is stored."""
    from assayframe.plans import growing

    labels, real = [], digests.write_shared
    monkeypatch.setattr(digests, "write_shared", lambda df, label: labels.append(label) or real(df, label))
    growing.stored_metric_differences(spark, "/root/testdata/sf0.001")
    assert labels and "digest-rows" not in labels


def test_rows_in_doubt_move_without_a_hash(spark, tmp_path):
    """Plain rows are their own content: equal ones cancel by their values, NaN, NULL and both zeros too."""
    nan = float("nan")
    one = [(i, "a", 0.0, None, None) for i in range(50)] + [(60, "a", nan, "x", 1), (61, None, -0.0, "", 0), (62, "a", 1.0, "x", 1), (62, "a", 1.0, "x", 1)]
    other = [(i, "a", -0.0, None, None) for i in range(50)] + [(60, "a", nan, "x", 1), (61, None, 0.0, "", 0), (62, "a", 1.0, "x", 1), (63, "a", nan, "x", 1)]
    shape = digests.Shape(0, 0)
    here = digests.store(spark.createDataFrame(one, SPEC), ["k", "part"], str(tmp_path / "one"), shape)
    there = digests.store(spark.createDataFrame(other, SPEC), ["k", "part"], str(tmp_path / "other"), shape)
    found = digests.differences(spark, here, there, ["k", "part"])
    assert sorted(tuple(row) for row in found.collect()) == [(62, "a", "(row)", None, None), (63, "a", "(row)", None, None)]
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()
