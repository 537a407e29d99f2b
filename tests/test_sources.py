"""Scans, sinks, provenance, manifests, caches and documents."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from conftest import CORE, REGISTRY, rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayframe.operators import candidates as cand
from assayframe.operators import lookups as ops
from assayframe.sources import caches, manifest, measurements, registry, runlogs

A, B, C = CORE
DECLARED = {"a": "double", "flag": "boolean"}


def write(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def test_csv_scan(spark, tmp_path):
    path = write(tmp_path / "rows.csv", "key,a,flag,chain\nx,1.5,true,007\ny,NaN,,1e3\nz,,false,\n")
    df = measurements.read_measurements_csv(spark, path, DECLARED, ["key", "a"])
    assert dict(df.dtypes) == {"key": "string", "a": "double", "flag": "boolean", "chain": "string"}
    assert rows_of(df.orderBy("key")) == [("x", 1.5, True, "007"), ("y", None, None, "1e3"), ("z", None, False, None)]
    with pytest.raises(measurements.SourceError, match="lacks the columns b, c"):
        measurements.read_measurements_csv(spark, path, DECLARED, ["c", "a", "b"])


def test_malformed_number_fails(spark, tmp_path):
    path = write(tmp_path / "rows.csv", "key,a\nx,abc\n")
    with pytest.raises(Exception, match="abc"):
        measurements.read_measurements_csv(spark, path, DECLARED, ["key"]).collect()


def test_row_index_is_contiguous(spark, tmp_path):
    spark.range(100).repartition(7).write.parquet(str(tmp_path / "t"))
    df = measurements.with_row_index(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r["row_index"] for r in df.collect()) == list(range(100))


def test_table_round_trip_and_guard(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("x", "1.5"), ("y", None)], "key string, a string")
    measurements.write_table(df, path, {"a": "double"}, {"snapshot": "s@1", "source_rows": "2"})
    back = measurements.read_table(spark, path, snapshot="s@1")
    assert sorted(rows_of(back)) == [("x", 1.5), ("y", None)]
    assert measurements.provenance_of(back)["source_rows"] == "2"
    assert measurements.read_table(spark, path, ["a", "not there"], snapshot="s@1").columns == ["a"]
    with pytest.raises(measurements.SourceError, match="snapshot is 's@1', expected 's@2'"):
        measurements.read_table(spark, path, snapshot="s@2")
    assert rows_of(spark.read.parquet(f"{path}.provenance")) == [("s@1", "2")]


def test_strict_cast_fails_the_job(spark):
    df = spark.createDataFrame([("abc",)], "a string")
    with pytest.raises(PySparkException, match="column a does not hold double"):
        measurements.cast_declared(df, {"a": "double"}).collect()


def test_pruned_and_pushed_scan(spark, tmp_path):
    spark.range(10).select("id", F.lit(1.0).alias("a"), F.lit("x").alias("b")).write.parquet(str(tmp_path / "t"))
    df = measurements.read_table(spark, str(tmp_path / "t"), ["id", "a"], where="a > 0").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,0.0)" in plan and "struct<id:bigint,a:double>" in plan


def test_manifest_audit(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("good.csv", "wrong.csv"):
        (folder / name).write_text(name)
    sha = {name: hashlib.sha256(name.encode()).hexdigest() for name in ("good.csv", "wrong.csv")}
    lines = [
        "# revision: abc123", "", f"{sha['good.csv']}  8  good.csv", f"{'0' * 64}  9  wrong.csv", f"{'0' * 64}  5  absent file.csv",
    ]
    text = spark.read.text(write(tmp_path / "MANIFEST", "\n".join(lines)))
    audited = manifest.audit_files(manifest.parse_manifest(text), manifest.file_hashes(spark, str(folder)))
    assert dict(rows_of(audited.select("name", "status"))) == {"good.csv": "verified", "wrong.csv": "mismatch", "absent file.csv": "absent"}
    assert manifest.manifest_revision(text).first()[0] == "abc123"
    for bad in ("abc  8  x", f"{'0' * 64}  eight  x", f"{'0' * 64}  0  x", f"{'0' * 64}  8"):
        with pytest.raises(PySparkException, match="malformed manifest line"):
            manifest.parse_manifest(spark.createDataFrame([(bad,)], "value string")).collect()


@pytest.fixture(scope="module")
def table(in_scope):
    return cand.build_candidates(in_scope, REGISTRY.columns(), rows_bound=1_000).cache()


def test_cache_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "cache")
    looked = spark.createDataFrame(
        [("r", 0, i, 0, cid, key) for i, (cid, key) in enumerate([("7ec8cb49ff317efc", A), ("81b997b85ccd2069", A), ("7ec8cb49ff317efc", "nope")])],
        "run_id string, request_seq long, entry_pos long, prop_pos long, candidate_id string, property string",
    )
    results = ops.evaluate(looked, table, REGISTRY, rows_bound=10, backend="table", source="s@1", tier="simulated")
    caches.append_cache(results, path)
    caches.append_cache(results.where("status = 'ok'").withColumn("value", F.lit(9.0)), path + "/more")
    back = caches.read_cache(spark, path)
    assert sorted(rows_of(back.select("candidate_id", "property", "result.status", "result.cached"))) == [
        ("7ec8cb49ff317efc", A, "ok", False), ("81b997b85ccd2069", A, "missing", False),
    ]
    preloaded = back.select(F.lit("r").alias("run_id"), "candidate_id", "property")
    again = ops.evaluate(looked, table, REGISTRY, preloaded=preloaded, backend="table", source="s@1", tier="simulated")
    assert again.agg(F.sum("evals"), F.count_if("cached")).first() == (0, 2)


def test_last_cache_line_wins_and_bad_lines_are_named(spark, tmp_path):
    def line(value):
        result = {"status": "ok", "value": value, "cached": False, "cost": {"evals": 1, "cpu_hours": 0.0}}
        return json.dumps({"key": ["a", "p", "table", "s"], "result": result})

    path = write(tmp_path / "c.jsonl", line(1.0) + "\n\n" + line(2.0) + "\n")
    assert caches.read_cache(spark, path).select("result.value").first()[0] == 2.0
    bad = write(tmp_path / "d.jsonl", line(1.0) + "\n" + line(2.0)[:-3] + "\n")
    with pytest.raises(PySparkException, match="d.jsonl:2: malformed cache line"):
        caches.read_cache(spark, bad).collect()


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None, 0.5), (2, "a", 3, None)], "iteration int, beam string, hits int, frac double").coalesce(1)
    runlogs.write_results_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines() == ["iteration,beam,hits,frac", "1,b,,0.5", "2,a,3,"]
    runlogs.write_json(df, str(tmp_path / "json"))
    lines = next((tmp_path / "json").glob("part-*")).read_text().splitlines()
    assert lines[0] == '{"beam":"b","frac":0.5,"hits":null,"iteration":1}'
    with pytest.raises(PySparkException, match="non-finite number in frac"):
        runlogs.write_results_csv(df.withColumn("frac", F.lit(float("inf"))), str(tmp_path / "bad"))


def test_json_documents(spark, tmp_path):
    write(tmp_path / "r.json", json.dumps({"run_id": "r", "iteration": 1, "batch": [{"candidate_id": "c", "properties": ["x", "y"]}]}, indent=1))
    got = runlogs.read_json_documents(spark, str(tmp_path / "r.json"), runlogs.REQUEST)
    looked = ops.explode_requests(got.withColumn("request_seq", F.lit(0)))
    assert [(r["prop_pos"], r["property"]) for r in looked.collect()] == [(0, "x"), (1, "y")]
    bad = write(tmp_path / "bad.json", '{"run_id": "r", "run_id": "s"}')
    with pytest.raises(PySparkException, match="not a strict JSON document"):
        runlogs.read_json_documents(spark, bad, runlogs.REQUEST).collect()


def test_registry(spark):
    assert REGISTRY.by_column("Rg").key == "rg"
    assert [e.key for e in REGISTRY.by_role("constraint")] == ["dielectric_const_dc", "tg"]
    keys = [e.key for e in REGISTRY.entries]
    frame = REGISTRY.frame(spark)
    assert registry.registry_violations(frame, keys).count() == 0
    broken = registry.Registry([
        registry.Property("tg", "1tg", "K", "wish", 9.0, 1.0, ladder=(0.1, 0.1, -1.0), unit_status="unverified"),
        registry.Property("tg", "tg", "K", "constraint", 1.0, 9.0, unit_status="guess"),
        registry.Property("odd", "odd", "K", "validator", 1.0, 9.0),
    ]).frame(spark)
    assert set(rows_of(registry.registry_violations(broken, ["tg", "rg"]))) == {
        ("tg", "range must be an ordered pair"), ("tg", "role is not known"), ("tg", "unverified unit needs a note"),
        ("tg", "ladder rungs must be positive and distinct"), ("tg", "column is not an identifier"), ("tg", "unit status is not known"),
        ("tg", "key repeats"), ("rg", "key is missing"), ("odd", "key is not expected"),
    }


def test_nan_is_missing_at_the_parquet_scan(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").write.parquet(str(tmp_path / "nan"))
    row = measurements.read_table(spark, str(tmp_path / "nan")).agg(F.count("v").alias("n"), F.median("v").alias("m"), F.max("v").alias("x")).first()
    assert tuple(row) == (1, 1.0, 1.0)


def test_row_index_follows_the_source(spark, tmp_path):
    for part, size in (("a", 5), ("b", 300), ("c", 7)):  # the largest file is packed first, but counts second
        spark.range(size).select(F.lit(part).alias("p"), "id").coalesce(1).write.parquet(str(tmp_path / "t" / f"{part}"))
    df = measurements.with_row_index(spark.read.parquet(*[str(tmp_path / "t" / part) for part in "cab"]))
    rows = sorted((r["row_index"], r["p"], r["id"]) for r in df.collect())
    assert [r[1:] for r in rows] == [("a", i) for i in range(5)] + [("b", i) for i in range(300)] + [("c", i) for i in range(7)]
    assert [r[0] for r in rows] == list(range(312))
    spark.range(50).selectExpr("cast(id as string) as v").coalesce(1).write.text(str(tmp_path / "lines"))
    text = measurements.with_row_index(spark.read.text(str(tmp_path / "lines")))
    assert all(r["row_index"] == int(r["value"]) for r in text.collect())
