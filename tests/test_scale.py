"""Chunked order statistics against brute force, with tasks so small that every group is hot."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayframe.operators import profile, scale

QUICK = settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "cold"]), st.one_of(st.none(), st.integers(-4, 9).map(lambda n: n / 2))),
    min_size=1, max_size=40,
)


def frame(spark, rows):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i long, k string, v double")


@QUICK
@given(rows=VALUES)
def test_group_quantiles(spark, tiny_tasks, rows):
    wanted = {"m": ("v", 0.5), "p": ("v", 0.9), "z": ("v", 0.0)}
    found = scale.group_quantiles(frame(spark, rows), ["k"], wanted).collect()
    got = {r["k"]: r for r in found if r["m"] is not None}
    expected = pd.DataFrame(rows, columns=["k", "v"]).astype({"v": float}).dropna().groupby("k")["v"]
    assert set(got) == set(expected.groups)
    for key, values in expected:
        for name, (_, q) in wanted.items():
            assert got[key][name] == pytest.approx(values.quantile(q))


@QUICK
@given(rows=VALUES)
def test_quantiles(spark, tiny_tasks, rows):
    got = scale.quantiles(frame(spark, rows), {"m": ("v", 0.5), "p": ("v", 0.95)}).first()
    values = pd.Series([v for _, v in rows], dtype=float).dropna()
    for name, q in (("m", 0.5), ("p", 0.95)):
        assert got[name] == (None if values.empty else pytest.approx(values.quantile(q)))


def test_ordered_bits_follow_the_values():
    values = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    bits = scale.ordered_bits(values)
    assert bits[4] == bits[5]
    assert (np.sort(bits) == bits).all()
    assert [scale.value_of_bits(int(b)) for b in bits] == values.tolist()


def test_ranks_of_all_columns_in_four_scans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = {
        "close": 1.0 + rng.integers(0, 4000, 3000) * 2.0**-52,  # only the last bits differ
        "wide": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), "same": np.full(3000, -7.25), "whole": rng.integers(-5, 5, 3000).astype(float),
    }
    frame = pd.DataFrame(data).assign(empty=None)
    frame.loc[::7, "wide"] = None
    table = spark.createDataFrame([tuple(None if x is None or x != x else float(x) for x in row) for row in frame.itertuples(index=False)],
                                  ", ".join(f"{name} double" for name in frame.columns)).repartition(5)
    scans = []
    real = scale._histogram
    monkeypatch.setattr(scale, "_histogram", lambda *args: scans.append(1) or real(*args))
    monkeypatch.setattr(scale, "HELD_BINS", 100)
    found = scale.values_at_ranks(table, {name: lambda n: {0, n // 3, n // 2, n - 1} for name in frame.columns})
    assert len(scans) <= 4
    for name in data:
        values = np.sort(frame[name].dropna().to_numpy(dtype=float))
        assert found[name] == {rank: values[rank] for rank in (0, len(values) // 3, len(values) // 2, len(values) - 1)}, name
    assert found["empty"] == {}
    assert scale.values_at_ranks(table.limit(0), {"wide": lambda n: {0}}) == {"wide": {}}


@pytest.mark.parametrize("most", [0, 1, 100], ids=["all chunked", "too many", "split"])
def test_hot_and_calm_groups_together(spark, tiny_tasks, monkeypatch, most):
    monkeypatch.setattr(scale, "MOST_HOT_GROUPS", most)
    rows = [("hot", float(i * i % 13)) for i in range(40)] + [(None, float(i % 5)) for i in range(9)] + [("calm", 2.0), ("calm", 5.0), ("empty", None)]
    wanted = {"m": ("v", 0.5), "p": ("v", 0.9)}
    got = {r["k"]: (r["m"], r["p"]) for r in scale.group_quantiles(frame(spark, rows), ["k"], wanted).collect() if r["m"] is not None}
    plain = {r["k"]: (r["m"], r["p"]) for r in scale.group_quantiles(frame(spark, rows), ["k"], wanted, rows_bound=1).collect() if r["m"] is not None}
    expected = pd.DataFrame(rows, columns=["k", "v"]).dropna(subset=["v"]).groupby("k", dropna=False)["v"]
    for key, values in expected:
        key = None if pd.isna(key) else key
        for found in (got, plain):
            assert found[key] == pytest.approx((values.quantile(0.5), values.quantile(0.9)))


def test_quantiles_of_one_dominant_value(spark, tiny_tasks):
    rows = [("a", 7.0)] * 50 + [("a", float(i)) for i in range(20)]
    got = scale.quantiles(frame(spark, rows), {"m": ("v", 0.5), "top": ("v", 1.0)}).first()
    assert (got["m"], got["top"]) == (7.0, 19.0)


@QUICK
@given(rows=VALUES, inclusive=st.booleans())
def test_running(spark, tiny_tasks, rows, inclusive):
    df = frame(spark, rows).withColumn("v", F.coalesce("v", F.lit(1.0)))
    measures = {"total": ("sum", F.col("v")), "high": ("max", F.col("v")), "low": ("min", F.col("v"))}
    chunked = scale.running(df, ["k"], ["i"], measures, chunk=scale.position_chunk("i"), inclusive=inclusive, totals=["total"])
    plain = scale.running(df, ["k"], ["i"], measures, chunk=None, inclusive=inclusive, totals=["total"])
    columns = ["i", "k", "total", "high", "low", "total_all"]
    assert sorted(chunked.select(*columns).collect()) == sorted(plain.select(*columns).collect())


def test_running_keeps_null_keys(spark, tiny_tasks):
    df = frame(spark, [(None, 1.0)] * 9 + [("a", 1.0)] * 5)
    got = scale.running(df, ["k"], ["i"], {"n": ("sum", F.lit(1))}, chunk=scale.position_chunk("i"), totals=["n"])
    assert sorted((r["i"], r["n"], r["n_all"]) for r in got.collect()) == [(i, i + 1, 9) for i in range(9)] + [(9 + i, i + 1, 5) for i in range(5)]


@QUICK
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=3, max_size=40))
def test_rank_correlation(spark, tiny_tasks, rows):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    got = profile.rank_correlation(df, F.lit(True), [("a", "b")]).first()["spearman"]
    data = pd.DataFrame(rows, columns=["a", "b"])
    if data["a"].nunique() < 2 or data["b"].nunique() < 2:
        assert got is None
    else:
        assert got == pytest.approx(np.corrcoef(data["a"].rank(), data["b"].rank())[0, 1])


def test_rank_correlation_drops_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (None, 9.0), (5.0, 0.5)], "a double, b double")
    assert profile.rank_correlation(df, F.lit(True), [("a", "b")], rows_bound=10).first()["spearman"] == pytest.approx(-1.0)


def test_descriptives_both_ways(spark, tiny_tasks):
    df = frame(spark, [("a", float(i * i % 37)) for i in range(60)] + [("a", None)])
    chunked = profile.descriptives(df, "v").first()
    scale.PERCENTILE_ROWS = 1_000
    assert chunked == profile.descriptives(df, "v", rows_bound=100).first()


def test_cuts_change_nothing(spark):
    """Any cut points give the same chunked result; only the spread of the work depends on them."""
    df = frame(spark, [("a", float(i % 11)) for i in range(50)])
    results = []
    for points in ([], [3.0], [0.0, 1.0, 5.0, 10.0], [i / 999 for i in range(9990)]):
        entries = df.groupBy("k", "v").count()
        chunk = scale.chunk_of(F.col("v"), points)
        ran = scale.running(entries, ["k"], ["v"], {"n": ("sum", F.col("count"))}, chunk=chunk)
        results.append(sorted(ran.select("v", "n").collect()))
    assert all(result == results[0] for result in results)


@pytest.mark.parametrize("branches", [2, 1024])
def test_clustered_values_fill_no_chunk_beyond_twice_the_limit(spark, monkeypatch, branches):
    monkeypatch.setattr(scale, "TASK_ROWS", 200)
    monkeypatch.setattr(scale, "MOST_BRANCHES", branches)
    df = spark.range(40_000).select((F.col("id") % 50 * 1000 + F.col("id") / 1e6).alias("v"))  # fifty narrow clusters
    points = scale.cut_points(df, ["v"])["v"]
    sizes = df.groupBy(scale.chunk_of(F.col("v"), points).alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rows = sizes.orderBy("c").collect()
    assert max(r["n"] for r in rows) <= 400 and sum(r["n"] for r in rows) == 40_000
    assert all(a["high"] < b["low"] for a, b in zip(rows, rows[1:], strict=False))


def test_chunks_of_a_group_move_once(spark, monkeypatch):
    """Counts per chunk are brought together by one shuffle, and a key without ties needs its one chunk only."""
    monkeypatch.setattr(scale, "MIN_PIECES", 4)
    rows = [(k, float(v)) for k in (None, "a", "b") for v in range(101)] + [("b", -0.0)] * 60 + [("nan", float("nan"))] * 3 + [("nan", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    counts = scale._chunk_counts(df, ["k"], ["v"], {"v": [25.0, 50.0, 75.0]})
    ranked = counts.groupBy("_k0").agg(F.sum("_n"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1
    got = {row["k"]: (row["m"], row["p"]) for row in scale.chunked_quantiles(df, ["k"], {"m": ("v", 0.5), "p": ("v", 0.99)}).collect()}
    assert {k: got[k] for k in (None, "a", "b")} == {None: (50.0, 99.0), "a": (50.0, 99.0), "b": (20.0, pytest.approx(98.4))}
    assert all(np.isnan(x) for x in got["nan"])


def test_columns_that_are_never_null_in_one_share_only(spark, tiny_tasks):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5.0), ("b", 4.0, 7.0)], "k string, v double, w double").select("k", F.lit("x").alias("p"), F.coalesce("v", F.lit(0.0)).alias("v"), "w")
    got = scale.chunked_quantiles(df, ["k", "p"], {"m": ("v", 0.5), "n": ("w", 0.5)}).collect()
    assert sorted(tuple(row) for row in got) == [("a", "x", 1.5, 5.0), ("b", "x", 4.0, 7.0)]


def test_group_sizes_are_bounded_before_groups_are_counted(spark, monkeypatch):
    """If no bucket of groups is larger than a large group, groups are not counted; else they are told apart as ever."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("k"), "id")
    cuts, real = [], scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", lambda df: cuts.append(1) or real(df))
    monkeypatch.setattr(scale, "SIZE_BUCKETS", 1 << 14, raising=False)
    split = scale.split_by_group_size(rows, ["k"], 200)
    assert (split.calm.count(), split.hot, cuts) == (3000, None, [])
    hot = rows.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("k"), "id"))
    split = scale.split_by_group_size(hot, ["k"], 200)
    assert (split.calm.count(), split.hot.count(), cuts) == (3000, 500, [1])
