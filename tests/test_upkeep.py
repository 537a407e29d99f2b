"""A candidate table under appends equals one built at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import upkeep
from assayframe.operators.candidates import build_candidates
from assayframe.operators.identity import resolve_labels

SPEC = "k string, label string, a double, b double"
NAMES = ["a", "b"]


def rows():
    rng = random.Random(11)
    return [
        (f"k{rng.randrange(40)}" if rng.random() < 0.7 else "hot", rng.choice(["x", "y", None, "X ", "unknown"]) if rng.random() < 0.5 else None,
         rng.choice([1.0, 2.0, rng.random(), None]), rng.choice([None, 5.0, rng.random()]))
        for _ in range(900)
    ]


def rebuilt(spark, data):
    table = resolve_labels(spark.createDataFrame(data, SPEC).where("k IS NOT NULL"), "k", "label")
    return shown(build_candidates(table, NAMES, key=["k", "resolved_label"], rows_bound=10_000).withColumnRenamed("k", "key"))


def shown(table):
    columns = sorted(table.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in table.select(*columns).collect()), key=repr)


def append(spark, path, data, batch, bound=10_000):
    return upkeep.append_rows(spark.createDataFrame(data, SPEC), NAMES, path, key="k", label="label", batch=batch, rows_bound=bound)


def test_a_build_and_three_appends_equal_the_rebuild(spark, tmp_path):
    data, path = rows(), str(tmp_path / "table")
    for number, (start, end) in enumerate([(0, 600), (600, 610), (610, 611), (611, 900)]):
        append(spark, path, data[start:end], f"b{number}")
    assert shown(upkeep.read_candidates(spark, path)) == rebuilt(spark, data)


def test_the_way_for_hot_candidates(spark, tmp_path, tiny_tasks):
    data, path = rows()[:150], str(tmp_path / "table")
    append(spark, path, data[:100], "one", bound=None)
    append(spark, path, data[100:], "two", bound=None)
    assert shown(upkeep.read_candidates(spark, path)) == rebuilt(spark, data)


def test_a_new_label_takes_back_a_resolution(spark, tmp_path):
    path = str(tmp_path / "table")
    append(spark, path, [("k", None, 1.0, None), ("k", "x", 3.0, None), ("other", None, 7.0, None)], "one")
    first = {row["resolved_label"]: row["a_n"] for row in upkeep.read_candidates(spark, path).where("key = 'k'").collect()}
    assert first == {"x": 2}
    append(spark, path, [("k", "y", 9.0, None)], "two")
    second = {row["resolved_label"]: row["a_n"] for row in upkeep.read_candidates(spark, path).where("key = 'k'").collect()}
    assert second == {"x": 1, "y": 1, "unknown": 1}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path, monkeypatch):
    data, path = rows(), str(tmp_path / "table")
    first = append(spark, path, data, "one")
    assert len(first.buckets) > 20
    read = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **how: read.extend(paths) or real(self, *paths, **how))
    second = append(spark, path, [("k1", "x", 1.0, 1.0), (None, "x", 1.0, 1.0)], "two")
    assert len(second.buckets) == 1
    old = [name for name in read if f"/{first.folder}/" in name]
    assert {name.rsplit("/", 1)[1] for name in old} == {f"_bucket={second.buckets[0]}"}
    assert {p.name for p in (tmp_path / "table" / second.folder / "candidates").glob("_bucket=*")} == {f"_bucket={second.buckets[0]}"}


def test_a_batch_counts_once_and_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no rows"):
        upkeep.read_candidates(spark, path)
    one = append(spark, path, [("k", "x", 1.0, None)], "one")
    assert append(spark, path, [("k", "x", 1.0, None)], "one") == one
    stale = upkeep.generations(spark, path)
    append(spark, path, [("k", "x", 2.0, None)], "two")
    with monkeypatch.context() as late:  # a writer that began before the second append
        late.setattr(upkeep, "generations", lambda *_: stale)
        with pytest.raises(upkeep.Conflict):
            append(spark, path, [("k", "x", 3.0, None)], "three")
    append(spark, path, [], "nothing")
    got = upkeep.read_candidates(spark, path).select("n_rows", "a_n", F.col("a_max")).collect()
    assert [tuple(row) for row in got] == [(2, 2, 2.0)]


def test_small_candidates_of_a_large_table_take_one_pass(spark, tmp_path, monkeypatch):
    """Without a bound of the rows the evidence tells that no key is large; nothing is counted or joined for the medians."""
    from assayframe.operators import candidates

    monkeypatch.setattr(candidates, "split_by_group_size", lambda *_, **__: pytest.fail("small candidates were counted again"))
    data, path = rows(), str(tmp_path / "table")
    append(spark, path, data[:600], "one", bound=None)
    append(spark, path, data[600:], "two", bound=None)
    assert shown(upkeep.read_candidates(spark, path)) == rebuilt(spark, data)
