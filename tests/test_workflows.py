"""The three workflows end to end: load, answer requests, replay; and the captured populations."""

from __future__ import annotations

import json

import pytest
from conftest import CORE, EXTRA_ROWS, PLAN, REGISTRY, ROWS, RUN, golden_records, lookup_canonical, rows_of, source_frame
from pyspark.sql import functions as F

from assayframe.operators import populations
from assayframe.plans import workflows
from assayframe.sources import caches, measurements, runlogs

A, B, C = CORE
FACTS = {"snapshot": "invented@1", "source_sha256": "ab" * 32}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("load"))
    source = source_frame(spark, ROWS + EXTRA_ROWS)
    accounting = workflows.load_source(
        source, out, REGISTRY, raw="raw", second="second", label="label", facts=FACTS, canonical=lookup_canonical, expensive=True,
        rows_bound=100,
    )
    return out, accounting


def test_load(spark, loaded):
    out, accounting = loaded
    assert rows_of(accounting) == [(16, 1, 1, 14, True)]
    table = measurements.read_table(spark, f"{out}/candidates", **FACTS)
    assert table.count() == 9 and len(table.columns) == 9 * 5 + 4
    assert measurements.provenance_of(table)["in_scope_rows"] == "14"
    with pytest.raises(measurements.SourceError):
        measurements.read_table(spark, f"{out}/rows", snapshot="other@1")


def test_load_needs_its_columns(spark, tmp_path):
    with pytest.raises(measurements.SourceError, match="lacks the columns Rg"):
        workflows.load_source(source_frame(spark, ROWS).drop("Rg"), str(tmp_path), REGISTRY, raw="raw", second="second", label="label", facts=FACTS)


@pytest.mark.parametrize("bound", [100, None])
def test_captured_populations(spark, loaded, tiny_tasks, bound):
    from assayframe.operators import scale

    if bound:
        scale.TASK_ROWS = 1_000
    out, _ = loaded
    rows, table = (measurements.read_table(spark, f"{out}/{name}", **FACTS) for name in ("rows", "candidates"))
    members = populations.population_members(rows, REGISTRY, CORE, "flag")
    by_name = {name: {r[1] for r in rows_of(members) if r[0] == name} for name in ("flagged", "triple")}
    assert by_name["triple"] - by_name["flagged"] == {"e46d685d3399e6b4"} and len(by_name["flagged"]) == 4
    captured = populations.capture(rows, table, REGISTRY, CORE, "flag", [B, C], rows_bound=bound)
    got = captured.where("population = 'flagged'").orderBy("pos").collect()
    # the isotactic member qualifies by its flagged row and is served with both of its rows
    assert [(round(r["objective"], 3), round(r[B], 3), r[C], r["n"], r["pos"]) for r in got] == [
        (0.155, 2.61, 377.5, 1, 0), (0.18, 2.25, 400.0, 1, 1), (0.23, 2.22, 445.0, 1, 2), (0.315, 2.335, 262.5, 1, 3),
    ]


def request(tmp_path, name, batch, iteration=1):
    path = tmp_path / name
    path.write_text(json.dumps({"run_id": "r", "iteration": iteration, "batch": [{"candidate_id": c, "properties": p} for c, p in batch]}))
    return str(path)


def test_answering_with_cache_and_budget(spark, loaded, tmp_path):
    out, _ = loaded
    table = measurements.read_table(spark, f"{out}/candidates", **FACTS)
    facts = {"backend": "table", "source": "invented@1", "tier": "simulated"}
    cache = str(tmp_path / "cache")
    asked = request(tmp_path, "a.json", [("7ec8cb49ff317efc", [A, B]), ("0123456789abcdef", [A])])
    first = workflows.answer_requests(spark, asked, table, REGISTRY, limit=1, **facts)
    assert rows_of(first.select("status", "cached", "evals")) == [("ok", False, 1), ("ok", False, 0), ("missing", False, 0)]
    caches.append_cache(first, cache)
    again = workflows.answer_requests(spark, asked, table, REGISTRY, cache=cache, limit=0, **facts)
    assert rows_of(again.select("status", "cached", "evals")) == [("ok", True, 0), ("ok", True, 0), ("missing", True, 0)]
    other = workflows.answer_requests(spark, asked, table, REGISTRY, cache=cache, **(facts | {"source": "invented@2"}))
    assert other.agg(F.count_if("cached")).first()[0] == 0
    two = request(tmp_path, "b.json", [("7ec8cb49ff317efc", [A]), ("d751b16095852737", [A])])
    with pytest.raises(workflows.Refused, match="requested 2 evals of limit 1"):
        workflows.answer_requests(spark, two, table, REGISTRY, limit=1, **facts)
    with pytest.raises(workflows.Refused, match="candidate id is malformed"):
        workflows.answer_requests(spark, request(tmp_path, "c.json", [("xyz", [A])]), table, REGISTRY, **facts)


def test_replay_and_outputs(spark, write_log, tmp_path):
    replayed = workflows.replay(spark, write_log(golden_records()), rows_bound=1_000)
    assert replayed.metrics.count() == 8
    assert rows_of(replayed.usage.select("evals", "cpu_hours")) == [(5, 0.0)]
    workflows.write_replay(replayed, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "results"))
    assert {r["pct_of_population"] for r in back.where("beam = 'chem'").collect()} == {None}
    summary = spark.read.json(str(tmp_path / "out" / "summary")).where("status = 'completed'").collect()
    assert len(summary) == 1 and len(summary[0]["trends"]) == 6


def test_replay_refuses_a_broken_log(spark, write_log):
    records = golden_records()
    with pytest.raises(workflows.Refused, match="seq is not its position|header"):
        workflows.replay(spark, write_log(records[:5] + records[6:]))
    records[4]["payload"]["cost"]["evals"] = 7
    with pytest.raises(workflows.Refused, match="not the sum of its results"):
        workflows.replay(spark, write_log(records))


def test_unfinished_work(spark, write_log):
    plan = spark.createDataFrame(
        [(RUN, i, b, c) for i, beams in PLAN.items() for b, ids in beams for c in ids or [None]],
        "run_id string, iteration long, beam string, candidate_id string",
    )
    _, events = runlogs.read_log(spark, write_log(golden_records()[:6]))
    left = workflows.unfinished_work(plan, events)
    assert left.count() == 5
    _, complete = runlogs.read_log(spark, write_log(golden_records(), "whole.jsonl"))
    assert workflows.unfinished_work(plan, complete).count() == 0
