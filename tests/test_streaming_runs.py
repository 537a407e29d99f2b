"""Streaming checks of run logs against the batch checks."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayframe.operators import logchecks
from assayframe.streaming import runs

SPEC = "run_id string, seq long, ts timestamp, iteration long, event string, beam string, candidate_id string"
START = datetime.datetime(2024, 1, 1)


def log_rows():
    """Sound runs, and runs with lost, repeated and misplaced events; stamps rise with ``seq``."""
    rng = random.Random(12)
    rows = []
    for number in range(12):
        events = [(None, "run_opened", None, None)]
        for iteration in (1, 2, 3):
            events.append((iteration, "iteration_opened", None, None))
            for beam in "ab":
                events.append((iteration, "selection", beam, None))
                events += [(iteration, "evaluation", beam, f"c{i}") for i in range(2)]
            events.append((iteration, "iteration_closed", None, None))
        events.append((None, "run_closed", None, None))
        if number % 3 == 1:
            del events[rng.randrange(len(events))]
        if number % 4 == 2:
            events.insert(rng.randrange(len(events)), rng.choice(events))
        if number == 7:
            events.append((3, "evaluation", "a", "c0"))
        line = [(f"r{number}", i + 1, START + datetime.timedelta(seconds=60 * i + number), *event) for i, event in enumerate(events)]
        if number % 5 == 3:
            lost = rng.randrange(len(line))
            line = line[:lost] + line[lost + 1 :]
        rows += line + ([line[4]] if number == 6 else [])
    return rows


def batch(spark, rows):
    events = spark.createDataFrame(rows, SPEC)
    parts = [
        logchecks.contiguity_violations(events, rows_bound=1000), logchecks.lifecycle_violations(events, rows_bound=1000), logchecks.duplicate_keys(events),
    ]
    return sorted(tuple(row) for part in parts for row in part.collect())


def clock(day):
    """A line of a run that nobody looks at, which only moves the time on."""
    return ("clock", 1, START + datetime.timedelta(days=day), None, "run_opened", None, None)


@pytest.mark.parametrize("split", ["in order", "shuffled"])
def test_any_split_gives_the_batch_violations(spark, tmp_path, split):
    rows = log_rows()
    expected = batch(spark, rows)
    assert {row[2] for row in expected} >= {"seq is not its position", "event outside its iteration", "duplicate event", "event follows run_closed"}
    rng = random.Random(5)
    moved = sorted(rows, key=lambda row: row[2])
    if split == "shuffled":  # a line comes up to one batch late
        parts = [[], [], [], []]
        for place, row in enumerate(moved):
            parts[min(3, 3 * place // len(moved) + rng.randint(0, 1))].append(row)
    else:
        parts = [moved[: len(moved) // 2], moved[len(moved) // 2 :]]
    source, sink, check = (str(tmp_path / name) for name in ("in", "out", "check"))
    # Every batch is a query of its own that goes on from the checkpoint, as after a crash.
    for part in [*parts, [clock(2)], [clock(3)]]:
        spark.createDataFrame(part, SPEC).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SPEC).parquet(source)
        runs.watch_runs(stream, sink, check, delay="30 minutes", idle_ms=3_600_000).awaitTermination()
    got = spark.read.parquet(sink).where(F.col("run_id") != "clock")
    assert sorted(tuple(row) for row in got.collect()) == expected


def test_fold_of_a_sound_run_is_silent():
    fold = runs.Fold(None, 1)
    events = [(None, "run_opened"), (1, "iteration_opened"), (1, "selection"), (1, "iteration_closed"), (2, "iteration_opened"), (2, "iteration_closed"), (None, "run_closed")]
    assert [found for i, (iteration, event) in enumerate(events) for found in fold.step(i + 1, iteration, event)] == []


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(runs.STORE_SETTING)
    with runs.state_store(spark):
        assert spark.conf.get(runs.STORE_SETTING) == runs.STORE
    assert spark.conf.get(runs.STORE_SETTING) == before


class Calls:
    """States in memory that count the calls a run makes, as each one is a round trip."""

    def __init__(self):
        self.value, self.rows, self.entries, self.timers, self.calls = None, [], {}, set(), 0

    def counted(self):
        self.calls += 1
        return self

    def getValueState(self, name, schema):
        return type("Value", (), {"get": lambda _: self.counted().value, "update": lambda _, row: setattr(self.counted(), "value", row), "clear": lambda _: setattr(self.counted(), "value", None)})()

    def getListState(self, name, schema):
        return type("List", (), {"get": lambda _: iter(self.counted().rows), "appendList": lambda _, rows: self.counted().rows.extend(rows), "clear": lambda _: self.counted().rows.clear()})()

    def getMapState(self, name, key, value):
        return type("Map", (), {
            "getValue": lambda _, key: self.counted().entries.get(key), "updateValue": lambda _, key, row: self.counted().entries.update({key: row}),
            "removeKey": lambda _, key: self.counted().entries.pop(key, None), "iterator": lambda _: iter(list(self.counted().entries.items())), "clear": lambda _: self.counted().entries.clear(),
        })()

    def registerTimer(self, due):
        self.counted().timers.add(due)


def through_states(lines, pieces):
    """(violations, calls, most event keys in one stored part) of one run whose lines come in ``pieces``; the time moves on behind each."""
    held, checks, found, widest = Calls(), runs.RunChecks(50, 1), [], 0
    checks.init(held)
    size = -(-len(lines) // pieces)

    def fire(now):
        for due in sorted(held.timers):
            if due <= now:
                held.timers.remove(due)
                times = type("T", (), {"getCurrentWatermarkInMs": lambda _: now, "getExpiryTimeInMs": lambda _: due})()
                found.extend(tuple(row) for row in checks.handleExpiredTimer(("r",), times, times))

    for start in range(0, len(lines), size):
        part = [Row(seq=seq, stamp=stamp, iteration=iteration, event=event, event_key=key) for seq, stamp, iteration, event, key in lines[start : start + size]]
        list(checks.handleInputRows(("r",), iter(part), None))
        widest = max([widest, *(len(runs.json.loads(row[0])) for row in held.entries.values())])
        fire(part[-1].stamp // 1000 - 5)
    for now in (10**6, 2 * 10**6):
        fire(now)
    assert (held.value, held.rows, held.entries, held.timers) == (None, [], {}, set())
    return sorted(found), held.calls, widest


def test_a_small_run_takes_few_calls_and_a_large_one_small_parts(monkeypatch):
    lines = [(i + 1, 1000 * i, 1, "evaluation", f"evaluation/1/b/{i % 700}") for i in range(900)]
    few, calls, _ = through_states(lines[:40], 4)
    assert len(few) == 41  # the first one is not run_opened, and all are outside an iteration
    assert calls <= 40  # one state call per event key, three times over, before
    whole, _, _ = through_states(lines, 3)
    assert sum(row[2] == "duplicate event" for row in whole) == 200
    monkeypatch.setattr(runs, "PACKED", 8)
    parted, _, widest = through_states(lines, 3)
    assert parted == whole
    assert widest <= 32
