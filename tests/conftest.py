"""A small session, the invented measurement rows and the golden run log."""

from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assayframe import build_session  # noqa: E402
from assayframe.operators import scale  # noqa: E402
from assayframe.sources.registry import Property, Registry  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_tasks(monkeypatch):
    """Pretend a task holds three rows, so that every group is hot."""
    monkeypatch.setattr(scale, "TASK_ROWS", 3)
    monkeypatch.setattr(scale, "HOT_ROWS", 3)
    monkeypatch.setattr(scale, "PERCENTILE_ROWS", 3)
    monkeypatch.setattr(scale, "MIN_PIECES", 5)
    monkeypatch.setattr(scale, "MOST_BRANCHES", 20)
    monkeypatch.setattr(scale, "POSITION_WIDTH", 3)


REGISTRY = Registry(
    [
        Property("thermal_conductivity", "thermal_conductivity", "W/(m*K)", "objective", 0.0, 2.0, keep_flag=True),
        Property("dielectric_const_dc", "dielectric_const_dc", "1", "constraint", 1.0, 20.0),
        Property("tg", "tg", "K", "constraint", 100.0, 900.0, ladder=(0.05, 0.1, 0.2, 0.5, 1.0)),
        Property("rg", "Rg", "A", "intermediate", 0.0, 200.0),
        Property("r2", "r2", "A^2", "validator", 0.0, 2000.0),
        Property("ffv", "fractional_free_volume", "1", "intermediate", 0.0, 1.0),
        Property("sp_ced", "sp_ced", "MPa", "intermediate", 0.0, 2000.0),
        Property("density", "density", "g/cm^3", "intermediate", 0.5, 2.5),
        Property("refractive_index", "refractive_index", "1", "validator", 1.0, 3.0),
    ]
)
CORE = ("thermal_conductivity", "dielectric_const_dc", "tg")

# The invented measurement rows and the canonical form of each raw key.
# raw key, second component, label, A, B, refractive index, C, error of C, flag
ROWS = [
    ("*CC*", None, "none", 0.30, 2.30, 1.50, 250.0, 0.05, True),
    ("*CC*", None, "none", 0.34, 2.36, 1.50, 270.0, 0.08, True),
    ("*CC*", None, "none", 0.32, 2.33, 1.50, 260.0, 0.15, True),
    ("*CC(*)C", None, "isotactic", 0.20, 2.20, 1.45, 450.0, 0.02, True),
    ("*CC(*)C", None, "atactic", 0.18, 2.25, 1.45, 400.0, 0.03, True),
    ("*CC*", None, None, 0.31, 2.34, 1.50, 265.0, 0.06, True),
    ("*CC(*)c1ccccc1", None, "atactic", 0.15, 2.60, 1.59, 380.0, 0.01, True),
    ("C(C*)(*)c1ccccc1", None, "atactic", 0.16, 2.62, 1.59, 375.0, 0.02, True),
    ("*CC(*)C(=O)OC", None, "atactic", 0.19, 25.0, 1.49, 390.0, 0.05, True),
    ("*CC(*)(C)C(=O)OC", None, "none", 15.0, 3.00, 1.49, 1.0e6, 5.0, False),
    ("*OC*", None, "none", None, 3.10, 1.48, 200.0, 0.05, None),
    ("*C(", None, "none", 0.20, 2.50, 1.50, 300.0, 0.05, True),
    ("*CC*,*OC*", "*OC*", "none", 0.25, 2.40, 1.50, 320.0, 0.05, True),
    ("*CC(*)F", None, "none", 0.22, 2.10, 1.40, None, None, True),
]
EXTRA_ROWS = [
    ("*CC(*)Cl", None, "atactic", 0.40, 2.40, 1.54, 420.0, 0.04, False),
    ("*CC(*)C", None, "isotactic", 0.26, 2.24, 1.45, 440.0, 0.03, False),
]
CANONICAL = {"C(C*)(*)c1ccccc1": "*CC(*)c1ccccc1", "*OC*": "*CO*", "*C(": None}
SCHEMA = (
    "raw string, second string, label string, thermal_conductivity double, dielectric_const_dc double, refractive_index double, "
    "tg double, tg_rmse double, flag boolean"
)


def lookup_canonical(raw):
    """A stand-in for an expensive canonicaliser: a pandas UDF over distinct texts."""
    table = dict(CANONICAL)

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: table.get(text, text))

    return canonical(raw)


def source_frame(spark, rows):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "row_index long, " + SCHEMA)
    square = F.col("refractive_index") * F.col("refractive_index")
    constants = {"Rg": 20.0, "r2": 4.0, "fractional_free_volume": 0.18, "sp_ced": 300.0, "density": 1.0}
    return df.withColumns({name: F.lit(value) for name, value in constants.items()}).withColumn(
        "static", F.col("dielectric_const_dc") + 1 - square
    )


@pytest.fixture(scope="session")
def source(spark):
    return source_frame(spark, ROWS).cache()


@pytest.fixture(scope="session")
def in_scope(source):
    from assayframe.operators.identity import with_identity

    return with_identity(source, raw="raw", second="second", label="label", canonical=lookup_canonical, expensive=True).cache()


# -- the golden log --------------------------------------------------------------------------

RUN = "20260101T000000Z-00000000"
TS = "2026-01-01T00:00:00Z"
SNAPSHOT = "invented:rows@00000001"
PROBLEM = {
    "schema_version": 1,
    "objective": {"property": "thermal_conductivity", "direction": "max"},
    "constraints": [{"property": "dielectric_const_dc", "op": "<=", "value": 2.6}, {"property": "tg", "op": ">=", "value": 400.0}],
    "form": "constrained_single", "budget": {"iterations": 2, "candidates_per_beam": 3, "beams": 2}, "table": SNAPSHOT, "seed": 0,
}
# Served medians, counts and spreads of the candidates the plan names.
SERVED = {
    "7ec8cb49ff317efc": {"thermal_conductivity": 0.315, "dielectric_const_dc": 2.335, "tg": 262.5},
    "b3a635a55e1a6645": {"thermal_conductivity": 0.155, "dielectric_const_dc": 2.61, "tg": 377.5},
    "d751b16095852737": {"thermal_conductivity": 0.2, "dielectric_const_dc": 2.2, "tg": 450.0},
    "81b997b85ccd2069": {"thermal_conductivity": None, "dielectric_const_dc": 3.1, "tg": 200.0},
    "d24805b4ce4c381c": {"thermal_conductivity": 0.22, "dielectric_const_dc": 2.1, "tg": None},
}
PLAN = {
    1: [("full", ["7ec8cb49ff317efc", "b3a635a55e1a6645"]), ("random", ["81b997b85ccd2069", "d24805b4ce4c381c", "0123456789abcdef"])],
    2: [("full", ["7ec8cb49ff317efc", "d751b16095852737"]), ("chem", [])],
}
UNITS = {"thermal_conductivity": "W/(m*K)", "dielectric_const_dc": "1", "tg": "K"}


def golden_records(limit=None, plan=PLAN):
    """Header and events of a run of the plan; a small reference evaluator for the tests only."""
    records, cached, spent, seq = [], set(), 0, 0

    def emit(kind, iteration, payload):
        nonlocal seq
        seq += 1
        records.append({"seq": seq, "ts": TS, "run_id": RUN, "iteration": iteration, "event": kind, "payload": payload})

    header = {
        "schema_version": 1, "run_id": RUN, "problem": PROBLEM,
        "provenance": {"seed": 0, "snapshot": SNAPSHOT, "registry_version": "v1", "selector": "plan:test", "code_git_sha": "0" * 40},
    }
    population = {
        "objective": [0.155, 0.18, 0.2, 0.315],
        "constraints": {"dielectric_const_dc": [2.61, 2.25, 2.2, 2.335], "tg": [377.5, 400.0, 450.0, 262.5]},
    }
    emit("run_opened", 0, {"primary": "flagged", "populations": [{"name": "flagged", **population}, {"name": "triple", **population}]})
    for iteration, beams in plan.items():
        emit("iteration_opened", iteration, {})
        for beam, ids in beams:
            if not ids:
                emit("no_match", iteration, {"beam": beam})
                continue
            emit("selection", iteration, {"beam": beam, "candidates": ids})
            for cid in ids:
                results, charged = [], 0
                for key, unit in UNITS.items():
                    value = SERVED.get(cid, {}).get(key)
                    hit = (cid, key) in cached
                    pay = 1 if value is not None and not hit and not charged else 0
                    charged += pay
                    result = {
                        "candidate_id": cid, "property": key, "status": "missing" if value is None else "ok", "value": value,
                        "unit": None if value is None else unit, "n_replicates": None if value is None else 1, "spread": None,
                        "backend": "table", "source": SNAPSHOT, "provenance_tier": "simulated", "cached": hit,
                        "cost": {"evals": pay, "cpu_hours": 0.0},
                    }
                    if value is None:
                        result["reason"] = "value_absent" if cid in SERVED else "candidate_unknown"
                    results.append(result)
                if limit is not None and spent + charged > limit:
                    emit("run_closed", 0, {"reason": "budget_exhausted", "requested": charged, "remaining": limit - spent, "limit": limit})
                    return [header, *records]
                spent += charged
                cached |= {(cid, key) for key in UNITS}
                emit("evaluation", iteration, {"beam": beam, "candidate_id": cid, "results": results, "cost": {"evals": charged, "cpu_hours": 0.0}})
        emit("iteration_closed", iteration, {})
    emit("run_closed", 0, {"reason": "completed"})
    return [header, *records]


def canonical(record):
    import json

    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture
def write_log(tmp_path):
    """Write records (or ready lines) as one log file and return its path."""

    def write(records, name="run.jsonl", end="\n"):
        lines = [r if isinstance(r, str) else canonical(r) for r in records]
        path = tmp_path / name
        path.write_bytes(("\n".join(lines) + end).encode())
        return str(path)

    return write


def rows_of(df):
    return [tuple(row) for row in df.collect()]
