"""Lookups: status order, caching, charging, budgets, state, isolated failures."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import CORE, REGISTRY, rows_of
from pyspark.sql import functions as F

from assayframe.operators import candidates as cand
from assayframe.operators import lookups as ops
from assayframe.operators.backends import python_backend

A, B, C = CORE
FACTS = {"backend": "table", "source": "invented@1", "tier": "simulated"}
BATCH = "run_id string, request_seq long, batch array<struct<candidate_id: string, properties: array<string>>>"


@pytest.fixture(scope="module")
def table(in_scope):
    return cand.build_candidates(in_scope, REGISTRY.columns(), rows_bound=1_000).cache()


def requests(spark, *batches, run="r"):
    return spark.createDataFrame([(run, i, batch) for i, batch in enumerate(batches)], BATCH)


def ask(spark, table, *batches, bound=1_000, **more):
    looked = ops.explode_requests(requests(spark, *batches))
    return ops.response_order(ops.evaluate(looked, table, REGISTRY, rows_bound=bound, **more, **FACTS))


@pytest.mark.parametrize("bound", [1_000, None])
def test_status_taxonomy(spark, table, bound):
    batch = [
        ("7ec8cb49ff317efc", [A, "melting_point", "tg"]), ("81b997b85ccd2069", [A, B]), ("d24805b4ce4c381c", ["tg"]),
        ("0123456789abcdef", [A, "melting_point"]),
    ]
    got = ask(spark, table, batch, bound=bound).collect()
    assert [(r["property"], r["status"], r["reason"], r["evals"]) for r in got] == [
        (A, "ok", None, 1), ("melting_point", "unsupported", None, 0), ("tg", "ok", None, 0),
        (A, "missing", "value_absent", 0), (B, "ok", None, 1), ("tg", "missing", "value_absent", 0),
        (A, "missing", "candidate_unknown", 0), ("melting_point", "unsupported", None, 0),
    ]
    first, bare = got[0], got[3]
    assert first["value"] == pytest.approx(0.315) and (first["unit"], first["n_replicates"]) == ("W/(m*K)", 4)
    assert first["spread"] == pytest.approx(0.0170783, abs=1e-7) and first["source"] == "invented@1"
    assert [bare[n] for n in ("value", "unit", "n_replicates", "spread")] == [None] * 4
    single = ask(spark, table, [("d751b16095852737", [A])], bound=bound).first()
    assert single["n_replicates"] == 1 and single["spread"] is None


def test_out_of_range_candidates_are_served(spark, table):
    got = ask(spark, table, [("182075ab56be81bf", [A, "tg"])]).collect()
    assert [(r["status"], r["value"]) for r in got] == [("ok", 15.0), ("ok", 1.0e6)]


@pytest.mark.parametrize("ways", [{"bound": 1_000}, {"bound": None}, {"bound": None, "hot_rows": 0}, {"bound": None, "hot_rows": 2}])
def test_cache_and_charge_edges(spark, table, ways):
    cid = "7ec8cb49ff317efc"
    got = ask(
        spark, table,
        [(cid, [A]), (cid, [A, B])],  # a repeat inside a request is neither a hit nor charged again
        [(cid, [A, "tg"])],  # a new property of a cached candidate is charged again
        [("0123456789abcdef", [A]), (cid, ["tg", "nope"])],
        [("0123456789abcdef", [A]), (cid, ["nope"])],  # missing is cached, unsupported never
        **ways,
    ).collect()
    assert [(r["request_seq"], r["property"], r["cached"], r["evals"]) for r in got] == [
        (0, A, False, 1), (0, A, False, 0), (0, B, False, 0), (1, A, True, 0), (1, "tg", False, 1),
        (2, A, False, 0), (2, "tg", True, 0), (2, "nope", False, 0), (3, A, True, 0), (3, "nope", False, 0),
    ]


def test_preloaded_cache(spark, table):
    known = spark.createDataFrame([("r", "7ec8cb49ff317efc", A)], "run_id string, candidate_id string, property string")
    got = ask(spark, table, [("7ec8cb49ff317efc", [A, B])], preloaded=known).collect()
    assert [(r["cached"], r["evals"]) for r in got] == [(True, 0), (False, 1)]


def test_stored_answers_come_before_the_backend(spark, table):
    known = spark.createDataFrame(
        [("r", "7ec8cb49ff317efc", A, "ok", 9.0, "u", 7, None, None), ("r", "7ec8cb49ff317efc", "nope", "ok", 1.0, "u", 1, None, None)],
        "run_id string, candidate_id string, property string, status string, value double, unit string, n_replicates long, spread double, reason string",
    )
    got = ask(spark, table, [("7ec8cb49ff317efc", [A, "nope", B])], preloaded=known).collect()
    assert [(r["status"], r["value"], r["cached"], r["evals"]) for r in got] == [
        ("ok", 9.0, True, 0), ("unsupported", None, False, 0), ("ok", pytest.approx(2.335), False, 1),
    ]


def test_backend_failures_are_answers(spark, table):
    failing = table.withColumn("failure", F.when(F.col("candidate_id") == "7ec8cb49ff317efc", "SnapshotMismatch"))
    got = ask(spark, failing, [("7ec8cb49ff317efc", [A, "nope"]), ("81b997b85ccd2069", [B])], [("7ec8cb49ff317efc", [A])], failure="failure")
    assert [(r["status"], r["reason"], r["cached"], r["evals"]) for r in got.collect()] == [
        ("error", "SnapshotMismatch", False, 0), ("unsupported", None, False, 0), ("ok", None, False, 1), ("error", "SnapshotMismatch", False, 0),
    ]


def test_python_backend_isolates_failures(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "candidate_id string, property string")

    def lookup(candidate_id, key, row):
        return {"a": 1.0, "b": None}[candidate_id]

    assert sorted(rows_of(python_backend(asked, lookup).drop("property")), key=str) == [
        ("a", "ok", None, 1.0), ("b", "missing", "value_absent", None), ("c", "error", "KeyError", None),
    ]


def test_request_rules(spark):
    good = ("7ec8cb49ff317efc", ["a"])
    bad = spark.createDataFrame(
        [("r", 0, [good]), ("r", 1, []), ("r", 2, [good] * 1001), ("r", 3, [("7EC8cb49ff317efc", ["a"])]), ("r", 4, [(good[0], [])]),
         ("r", 5, [(good[0], ["a", "a"])]), ("", 6, [good]), ("r", 7, [(good[0] + "\n", ["a"])]), ("r", 8, [(good[0], [""])])], BATCH,
    )
    assert sorted(rows_of(ops.request_violations(bad).select("request_seq", "rule"))) == [
        (1, "batch must hold 1 to 1000 entries"), (2, "batch must hold 1 to 1000 entries"), (3, "candidate id is malformed"),
        (4, "an entry names no property"), (5, "a property repeats in an entry"), (6, "run id is empty"), (7, "candidate id is malformed"),
        (8, "a property name is empty"),
    ]


@pytest.mark.parametrize("bound", [1_000, None])
def test_budget_cutoff(spark, tiny_tasks, bound):
    if bound:
        from assayframe.operators import scale

        scale.TASK_ROWS = 1_000
    costs = spark.createDataFrame([("a", i, c) for i, c in enumerate([2, 0, 1, 3, 0, 1])] + [("b", 9, 4)], "run_id string, request_seq long, evals long")
    got = ops.budget_cutoff(costs, F.lit(4), rows_bound=bound).orderBy("run_id", "request_seq")
    assert rows_of(got) == [
        ("a", 0, 2, 0, True, False), ("a", 1, 0, 2, True, False), ("a", 2, 1, 2, True, False), ("a", 3, 3, 3, False, True),
        ("a", 4, 0, 6, False, False), ("a", 5, 1, 6, False, False), ("b", 9, 4, 0, True, False),
    ]


def greedy_by_hand(pairs, limit):
    out, runs = {}, {}
    for run, seq, cid, key in pairs:
        runs.setdefault(run, {}).setdefault(seq, set()).add((cid, key))
    for run, by_seq in runs.items():
        left, known = limit, set()
        for seq in sorted(by_seq):
            fresh = by_seq[seq] - known
            cost = len({cid for cid, _ in fresh})
            out[(run, seq)] = (cost, cost <= left)
            if cost <= left:
                left, known = left - cost, known | fresh
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budget_greedy_both_ways(spark, seed, monkeypatch):
    from assayframe.operators import scale

    rng = random.Random(seed)
    pairs = sorted({
        (rng.choice("aab"), rng.randrange(12), f"c{rng.randrange(7)}", rng.choice("xy")) for _ in range(90)
    })
    answered = spark.createDataFrame(pairs, "run_id string, request_seq long, candidate_id string, property string").withColumn("status", F.lit("ok"))
    expected = greedy_by_hand(pairs, 5)
    monkeypatch.setattr(scale, "POSITION_WIDTH", 4)
    larger = answered.groupBy("run_id").count().agg(F.max("count")).first()[0]
    for ways in ({"rows_bound": 1_000}, {}, {"hot_rows": 0}, {"hot_rows": larger - 1}):
        got = {(r[0], r[1]): (r[2], r[3]) for r in ops.budget_greedy(answered, 5, **ways).collect()}
        assert got == expected, ways


def greedy_rounds(spark, monkeypatch, pairs, limit):
    """Decisions by rounds, and how many rounds they took."""
    cuts = []
    real = ops.cut_lineage
    monkeypatch.setattr(ops, "cut_lineage", lambda df: cuts.append(1) or real(df))
    answered = spark.createDataFrame(pairs, "run_id string, request_seq long, candidate_id string, property string").withColumn("status", F.lit("ok"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in ops.budget_greedy(answered, limit, hot_rows=0).collect()}
    return got, (len(cuts) - 1) // 2


def test_greedy_rounds_do_not_grow_with_the_budget(spark, monkeypatch):
    rng = random.Random(6)
    pairs = sorted({("hot", seq, f"c{rng.randrange(200_000)}", "x") for seq in range(30_000) for _ in range(rng.randint(1, 7))})
    got, rounds = greedy_rounds(spark, monkeypatch, pairs, 60_000)
    assert got == greedy_by_hand(pairs, 60_000)
    assert sum(cost for cost, accepted in got.values() if accepted) == 60_000
    assert rounds <= 5


def test_greedy_rounds_with_large_and_overlapping_requests(spark, monkeypatch):
    rng = random.Random(7)
    sizes = [1, 40, 1, 39, 2, 30, 3, 17, 64, 1, 5, 9, 12, 33, 2, 1, 1, 70]
    pairs = [("steps", seq, f"s{seq}.{i}", "x") for seq, size in enumerate(sizes) for i in range(size)]
    pairs += [("windows", seq, f"w{seq + i}", "x") for seq in range(12) for i in range(30)]
    pairs += sorted({("mixed", rng.randrange(60), f"m{rng.randrange(40)}", rng.choice("xy")) for _ in range(500)})
    got, rounds = greedy_rounds(spark, monkeypatch, pairs, 45)
    assert got == greedy_by_hand(pairs, 45)
    assert rounds <= 20


def test_greedy_rounds_move_shared_pairs_only(spark, monkeypatch):
    """A candidate that one request of a run asks for is a number; bounded and unbounded candidates give the same decisions."""
    rng = random.Random(8)
    pairs = sorted({(rng.choice("ab"), seq, f"c{rng.randrange(30)}", rng.choice("xy")) for seq in range(12) for _ in range(3)})
    pairs += [("a", seq, f"own{seq}.{i}", key) for seq in range(12) for i in range(seq % 4) for key in "xy"]
    asked = Counter((run, cid) for run, _, cid in {pair[:3] for pair in pairs})
    answered = spark.createDataFrame(pairs, "run_id string, request_seq long, candidate_id string, property string").withColumn("status", F.lit("ok"))
    missing = spark.createDataFrame([("a", 99, "c1", "x"), ("b", 3, "own0.0", "y")], "run_id string, request_seq long, candidate_id string, property string")
    answered = answered.unionByName(missing.withColumn("status", F.lit("missing")))
    expected = greedy_by_hand(pairs, 9) | {("a", 99): (0, True)}
    expected.setdefault(("b", 3), (0, True))
    real, moved = ops._rounds, []
    monkeypatch.setattr(ops, "_rounds", lambda *tables: moved.append(tables[-1].count()) or real(*tables))
    for ways in ({}, {"candidate_bound": 100}):
        got = {(r[0], r[1]): (r[2], r[3]) for r in ops.budget_greedy(answered, 9, hot_rows=0, **ways).collect()}
        assert got == expected, ways
        assert moved.pop() == sum(asked[run, cid] > 1 for run, _, cid, _ in pairs) < len(pairs)


def test_state_is_rebuilt_from_results(spark, table):
    cid = "7ec8cb49ff317efc"
    results = ask(spark, table, [(cid, [A, "nope"])], [(cid, [A, B])], [("0123456789abcdef", [A])])
    cache = ops.rebuild_cache(results).select("candidate_id", "property", "status")
    assert set(rows_of(cache)) == {(cid, A, "ok"), (cid, B, "ok"), ("0123456789abcdef", A, "missing")}
    assert rows_of(ops.meter(results)) == [("r", 2, 0.0)]
    assert rows_of(ops.request_costs(results).orderBy("request_seq").select("evals")) == [(1,), (1,), (0,)]


def test_remaining_work_and_served_values(spark, table):
    planned = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "iteration int, candidate_id string")
    left = ops.remaining_work(planned, planned.where("iteration = 1 AND candidate_id = 'a'"), ["iteration", "candidate_id"])
    assert sorted(rows_of(left)) == [(1, "b"), (2, "a")]
    ids = spark.createDataFrame([("7ec8cb49ff317efc",), ("0123456789abcdef",)], "candidate_id string")
    assert dict(rows_of(ops.served_values(ids, table, {"a": f"{A}_median"})))["0123456789abcdef"] is None
