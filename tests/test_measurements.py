"""The invented rows: identity, filters, candidates and profiles against hand-derived values."""

from __future__ import annotations

import pytest
from conftest import CORE, EXTRA_ROWS, REGISTRY, ROWS, lookup_canonical, rows_of, source_frame
from pyspark.sql import functions as F

from assayframe.functions.columns import content_id
from assayframe.operators import candidates as cand
from assayframe.operators import filters, identity, profile
from assayframe.sources.measurements import load_accounting

A, B, C = CORE
COLUMNS = REGISTRY.columns()
# The ids of the candidates, first 16 hex digits of the hash of key|label.
IDS = {
    "*CC*|none": "7ec8cb49ff317efc", "*CC(*)C|isotactic": "d751b16095852737", "*CC(*)C|atactic": "c3da5668f5a82772",
    "*CC(*)c1ccccc1|atactic": "b3a635a55e1a6645", "*CO*|none": "81b997b85ccd2069", "*CC(*)F|none": "d24805b4ce4c381c",
    "*CC(*)Cl|atactic": "e46d685d3399e6b4",
}


@pytest.fixture(scope="module", params=[1_000, None], ids=["one-task", "chunked"])
def table(request, in_scope):
    return cand.build_candidates(in_scope, COLUMNS, carry=["structure_key", "resolved_label"], rows_bound=request.param).cache()


def test_content_ids(spark):
    keys = spark.createDataFrame([(*pair.split("|"), found) for pair, found in IDS.items()], "key string, label string, found string")
    assert keys.where(content_id("key", "label") != F.col("found")).count() == 0


def test_unknown_label_spelling(spark):
    rows = spark.createDataFrame([("k", None), ("k", ""), ("k", "unknown")], "key string, label string")
    assert rows.select(content_id("key", "label").alias("i")).distinct().count() == 1


def test_scope_and_identity(source, in_scope):
    canonical = identity.with_structure_key(source, "raw", canonical=lookup_canonical, expensive=True)
    assert rows_of(load_accounting(canonical, "second", "structure_key")) == [(14, 1, 1, 12, True)]
    assert in_scope.count() == 12
    assert in_scope.select("candidate_id").distinct().count() == 8
    assert rows_of(identity.raw_merges(in_scope, "raw", "structure_key")) == [(8, 7, 1)]
    assert source.select("raw").distinct().count() == 10


def test_twin_resolution(source, in_scope):
    resolved = in_scope.where("row_index = 5").select("resolved_label").first()[0]
    assert resolved == "none"
    expected = {"none": 1, "(empty rows)": 1, "(keys with several labels)": 1}
    assert dict(rows_of(identity.label_resolution_audit(in_scope, key="structure_key", label="label"))) == expected
    rejoined = identity.with_source_label(in_scope.drop("label"), source, index="row_index", label="label")
    assert dict(rows_of(identity.label_resolution_audit(rejoined, key="structure_key", label="source_label"))) == expected


def test_resolution_keeps_unknown_without_a_single_label(spark):
    rows = spark.createDataFrame(
        [("a", "x"), ("a", None), ("b", None), ("c", "x"), ("c", "y"), ("c", "")], "key string, label string"
    )
    for scan_again in (True, False):
        got = identity.resolve_labels(rows, "key", "label", scan_again=scan_again).groupBy("key", "resolved_label").count()
        assert set(rows_of(got)) == {("a", "x", 2), ("b", "unknown", 1), ("c", "x", 1), ("c", "y", 1), ("c", "unknown", 1)}


def test_multi_label_keys(source, in_scope):
    assert rows_of(identity.multi_label_keys(source, "raw", "label")) == [(2, 1, 1)]
    before = in_scope.select("structure_key", "label")
    assert rows_of(identity.multi_label_keys(before, "structure_key", "label")) == [(2, 1, 1)]
    assert rows_of(identity.multi_label_keys(in_scope, "structure_key", "resolved_label")) == [(1, 1, 0)]
    assert rows_of(identity.unknown_twin_keys(source, "raw", "label")) == [("*CC*",)]
    labels = {key: list(found) for key, found in rows_of(identity.observed_labels(in_scope, "structure_key", "label"))}
    assert labels["*CC(*)C"] == ["atactic", "isotactic"] and labels["*CC*"] == ["none"]


def test_label_frequency(source):
    assert rows_of(identity.label_frequency(source, "label")) == [("none", 8), ("atactic", 4), ("isotactic", 1), ("unknown", 1)]


def test_ladders(source, in_scope):
    assert [n for *_, n in rows_of(filters.triple_ladder(source, REGISTRY, CORE))] == [14, 13, 13, 12, 10]
    assert [n for *_, n in rows_of(filters.ceiling_ladder(source, REGISTRY, CORE, (10.0, 50.0, 100.0)))] == [11, 10, 11, 11]
    triple = filters.core_triple(REGISTRY, CORE)
    assert in_scope.where(triple).count() == 8
    rungs = filters.rung_ladder(in_scope, triple, "tg_rmse", REGISTRY.by_key("tg"))
    assert rows_of(rungs) == [(0.05, 5), (0.1, 7), (0.2, 8), (0.5, 8), (1.0, 8)]
    assert filters.rung_ladder(in_scope, triple, "tg_rmse", REGISTRY.by_key("rg")).count() == 0
    assert rows_of(profile.window_audit(source, REGISTRY.by_key("tg"))) == [(13, 12, 1)]
    assert rows_of(filters.flag_counts(source, "flag")) == [(12, 1, 1)]


def test_flag_needs_one_objective(source):
    keep = filters.passes_flag(REGISTRY, "flag")
    assert source.where(keep).count() == 12
    from assayframe.sources.registry import Registry

    with pytest.raises(ValueError, match="exactly one objective"):
        filters.passes_flag(Registry(REGISTRY.entries[1:]), "flag")


def test_range_audits_agree(spark, source):
    wide = set(rows_of(profile.range_audit(source, REGISTRY)))
    long = set(rows_of(profile.range_audit_long(source, REGISTRY.frame(spark), COLUMNS)))
    assert wide == long
    assert ("dielectric_const_dc", 13, 1, 0) in wide and ("tg", 12, 1, 1) in wide
    shares = {name: (n, pct) for name, n, pct in rows_of(profile.coverage(source, REGISTRY))}
    assert shares[A] == (13, 92.86) and shares["rg"] == (14, 100.0)


def test_candidates(table):
    rows = {row["candidate_id"]: row for row in table.collect()}
    assert len(rows) == 8
    first = rows[IDS["*CC*|none"]]
    assert (first["n_rows"], first[f"{A}_n"], first["structure_key"], first["resolved_label"]) == (4, 4, "*CC*", "none")
    assert first[f"{A}_median"] == pytest.approx(0.315)
    assert first[f"{A}_std"] == pytest.approx(0.0170783, abs=1e-7)
    assert (first["tg_median"], first["tg_min"], first["tg_max"]) == (262.5, 250.0, 270.0)
    single = rows[IDS["*CC(*)C|isotactic"]]
    assert single[f"{A}_std"] is None and single[f"{A}_median"] == pytest.approx(0.2)
    absent = rows[IDS["*CO*|none"]]
    assert absent[f"{A}_median"] is None and absent[f"{A}_n"] == 0 and absent["dielectric_const_dc_median"] == pytest.approx(3.1)


def test_replicates(in_scope, table):
    assert rows_of(cand.replicate_structure(table)) == [(8, 2, 6, 4)]
    assert rows_of(cand.size_histogram(table)) == [(1, 6), (2, 1), (4, 1)]
    assert cand.rows_of_replicated(in_scope, table).count() == 6
    versioned = in_scope.withColumns({"forcefield": F.lit("f"), "version": F.lit(None).cast("string")})
    assert rows_of(cand.version_split(versioned, ["forcefield", "version", "not there"])) == [(2, 0)]
    mixed = in_scope.withColumn("version", F.when(F.col("row_index") == 0, "v1"))
    assert rows_of(cand.version_split(mixed, ["version"])) == [(1, 1)]


@pytest.mark.parametrize("bound", [1_000, None])
def test_noise_floor(table, bound):
    floors = {row["property"]: row for row in cand.noise_floor(table, COLUMNS, rows_bound=bound).collect()}
    a = floors[A]
    assert a["n_groups"] == 2
    assert a["median_rel_std"] == pytest.approx(0.049918, abs=1e-6)
    assert a["median_abs_std"] == pytest.approx(0.0120747, abs=1e-7)
    assert a["p90_rel_std"] == pytest.approx(0.05336, abs=1e-5)


@pytest.mark.parametrize("bound", [1_000, None])
def test_feasible_set(in_scope, bound):
    population = cand.candidate_population(in_scope, REGISTRY, CORE, "filter_then_median", rows_bound=bound)
    got = profile.feasible_set(population, "dielectric_const_dc_median", "tg_median", 400.0, rows_bound=bound).first()
    assert got["quantile_cut"] == pytest.approx(2.2375) and (got["n_feasible"], got["n_population"], got["pct"]) == (1, 4, 25.0)


def test_filter_and_group_do_not_commute(spark):
    rows = source_frame(spark, ROWS + [("*CC(*)C(=O)OC", None, "atactic", 0.19, 2.5, 1.49, 390.0, 0.05, True)])
    keyed = identity.with_identity(rows, raw="raw", second="second", label="label", canonical=lookup_canonical, expensive=True)
    sizes = [
        cand.candidate_population(keyed, REGISTRY, CORE, order, rows_bound=100).count()
        for order in ("filter_then_median", "median_then_filter")
    ]
    assert sizes == [5, 5]
    kept = [
        cand.candidate_population(keyed, REGISTRY, CORE, order, rows_bound=100).agg(F.sum("n_rows")).first()[0]
        for order in ("filter_then_median", "median_then_filter")
    ]
    assert kept == [9, 10]
    with pytest.raises(ValueError, match="unknown order"):
        cand.candidate_population(keyed, REGISTRY, CORE, "sideways")


def test_population_rows(spark):
    rows = source_frame(spark, ROWS + EXTRA_ROWS)
    keyed = identity.with_identity(rows, raw="raw", second="second", label="label", canonical=lookup_canonical, expensive=True)
    assert keyed.count() == 14
    table = cand.build_candidates(keyed, COLUMNS, rows_bound=100)
    assert table.count() == 9
    isotactic = table.where(F.col("candidate_id") == IDS["*CC(*)C|isotactic"]).first()
    assert isotactic[f"{A}_median"] == pytest.approx(0.23) and isotactic["tg_median"] == 445.0
    assert isotactic["dielectric_const_dc_median"] == pytest.approx(2.22)
    triple, flag = filters.core_triple(REGISTRY, CORE), filters.passes_flag(REGISTRY, "flag")
    unflagged = {r[0] for r in keyed.where(triple).select("candidate_id").distinct().collect()}
    flagged = {r[0] for r in keyed.where(triple & flag).select("candidate_id").distinct().collect()}
    assert unflagged - flagged == {IDS["*CC(*)Cl|atactic"]}


def test_identity_residual_and_violations(source):
    got = profile.identity_residual(source, "dielectric_const_dc", "static", "refractive_index", rows_bound=100).first()
    assert got["n_rows"] == 14 and got["max_residual"] < 1e-12 and got["median_residual"] < 1e-12
    triple = filters.core_triple(REGISTRY, CORE)
    assert rows_of(profile.violation_share(source, triple, "static", "refractive_index")) == [(10, 10, 100.0)]
    assert rows_of(profile.violation_share(source, F.lit(False), "static", "refractive_index")) == [(0, 0, 0.0)]
    assert rows_of(profile.violation_share(source, triple, "dielectric_const_dc", "refractive_index")) == [(0, 10, 0.0)]
    square = profile.with_square(source, ["refractive_index"], "refractive_index", "square")
    assert square.columns == ["refractive_index", "square"]
    assert profile.column_minimum(source, "static").first()[0] == pytest.approx(2.3 + 1 - 2.25)


def test_distinct_battery_tolerates_a_missing_column(source):
    got = dict((name, (n, hit)) for name, n, hit in rows_of(profile.distinct_battery(source, ["raw", "not there"], 10)))
    assert got == {"rows": (14, False), "distinct raw": (10, True)}


def test_constraints_over_a_map(spark):
    rows = spark.sql(
        """SELECT id, m, array(named_struct('property','b','op','<=','value',2.6D), named_struct('property','c','op','>=','value',400D)) AS k
        FROM VALUES (1, map('b', 2.6D, 'c', 400D)), (2, map('b', 2.61D, 'c', 400D)), (3, map('b', 2D)), (4, map('b', CAST(NULL AS DOUBLE), 'c', 500D)) t(id, m)"""
    )
    assert rows_of(rows.where(filters.holds(F.col("k"), F.col("m"))).select("id")) == [(1,)]
    wide = rows.select("id", F.col("m")["b"].alias("b"), F.try_element_at("m", F.lit("c")).alias("c"))
    assert rows_of(wide.where(filters.holds_all([("b", "<=", 2.6), ("c", ">=", 400.0)])).select("id")) == [(1,)]
