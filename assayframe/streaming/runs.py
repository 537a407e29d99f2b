"""The order-dependent checks of run logs over a stream: positions, lifecycles and repeated events, with one state per run.

Lines may arrive in any order and in any split into micro-batches.  A line waits
in its run's state until the watermark has passed its stamp; then no line before
it can come any more, and it is folded into the run's counters in the order of
``seq``.  A run that has been silent for ``idle`` is sealed: its repeated events
are reported and its state is dropped.  The violations are those of the batch
checks in ``operators.logchecks``.

The stamps of a run must not fall as ``seq`` rises.  Spark drops lines that come
later than the watermark allows and counts them in the query's progress.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from assayframe.operators.logchecks import ITERATION_CLOSED, ITERATION_OPENED, RUN_CLOSED, RUN_LEVEL, RUN_OPENED, event_key

VIOLATION = "run_id string, seq long, rule string, detail string"
# What a run remembers, read and written at once: the events folded so far and the last of each kind that matters, its latest
# stamp, the timer that it relies on, a few waiting lines and event counts, whether more lines are listed, how many counts
# are stored beside it and by how many bits of their hash.
FOLDED = "n long, previous string, mark_event string, mark_iteration long, close_iteration long"
HELD = f"{FOLDED}, last_stamp long, timer long, lines string, counts string, listed boolean, stored long, bits int"
WAITING = "seq long, stamp long, iteration long, event string"
# Lines or counts that are kept in the value itself or in one part of the stored counts, and counts a call gathers before it stores them.
PACKED, GATHERED = 512, 100_000
STORE_SETTING, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """The counters of one run; ``step`` takes its events in the order of ``seq`` and tells what is wrong with each."""

    def __init__(self, values: tuple | None, first: int) -> None:
        self.first = first
        self.n, self.previous, self.mark_event, self.mark_iteration, self.close_iteration = values or (0, None, None, None, None)

    def values(self) -> tuple:
        return self.n, self.previous, self.mark_event, self.mark_iteration, self.close_iteration

    def step(self, seq: int, iteration: int | None, event: str) -> Iterator[tuple[str, str]]:
        """(rule, detail) of every rule that the event breaks."""
        expected = self.n + self.first
        if seq != expected:
            yield "seq is not its position", f"expected {expected}"
        detail = event if iteration is None else f"{event}/{iteration}"
        opened = self.mark_iteration if self.mark_event == ITERATION_OPENED else None
        if self.previous is None and event != RUN_OPENED:
            yield "first event is not run_opened", detail
        if self.previous == RUN_CLOSED:
            yield "event follows run_closed", detail
        if event == ITERATION_OPENED and (opened is not None or (iteration is not None and iteration != (self.close_iteration or 0) + 1)):
            yield "iteration opens out of order", detail
        if event not in RUN_LEVEL and event != ITERATION_OPENED and (opened is None or iteration != opened):
            yield "event outside its iteration", detail
        self.n, self.previous = self.n + 1, event
        if event in (ITERATION_OPENED, ITERATION_CLOSED):
            self.mark_event, self.mark_iteration = event, iteration
        if event == ITERATION_CLOSED:
            self.close_iteration = iteration


class Held:
    """What a run remembers between two calls; ``fold`` has the counters as ``Fold`` takes them."""

    def __init__(self, row: tuple | None) -> None:
        self.fold = tuple(row[:5]) if row else None
        self.last, self.timer, lines, counts, listed, stored, bits = row[5:] if row else (None, None, "[]", "{}", False, 0, 0)
        self.lines, self.counts = [tuple(line) for line in json.loads(lines)], {name: tuple(count) for name, count in json.loads(counts).items()}
        self.listed, self.stored, self.bits = listed, stored, bits

    def row(self) -> tuple:
        fold = self.fold or (0, None, None, None, None)
        return (*fold, self.last, self.timer, json.dumps(self.lines), json.dumps(self.counts), self.listed, self.stored, self.bits)


def merged(one: tuple[int, int] | None, other: tuple[int, int]) -> tuple[int, int]:
    """(count, latest seq) of one event key from two shares of its lines."""
    return other if one is None else (one[0] + other[0], max(one[1], other[1]))


def part_of(name: str, bits: int) -> int:
    """The part that an event key is stored in: the first bits of its hash."""
    return zlib.crc32(name.encode()) >> 32 - bits


class RunChecks(StatefulProcessor):
    """One state per run: the fold, the lines that wait for the watermark, and the counts of event keys.

    A run with few lines is one value, read once and written once a call.  Lines
    beyond ``PACKED`` go to a list; counts beyond it to parts by the hash of the
    event key, which are cut in four as they fill, so a call holds one part.
    """

    def __init__(self, idle_ms: int, first: int) -> None:
        self.idle_ms, self.first = idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.waiting = handle.getListState("waiting", WAITING)
        self.seen = handle.getMapState("seen", "bits int, part long", "counts string")

    def _part(self, bits: int, part: int) -> dict[str, tuple[int, int]]:
        row = self.seen.getValue((bits, part))
        return {} if row is None else {name: tuple(count) for name, count in json.loads(row[0]).items()}

    def _store_counts(self, state: Held) -> None:
        """Add the gathered counts to the stored parts, and cut the parts once they are full."""
        shares: dict[int, dict] = {}
        for name, count in state.counts.items():
            shares.setdefault(part_of(name, state.bits), {})[name] = count
        for part, share in shares.items():
            known = self._part(state.bits, part)
            before = len(known)
            for name, count in share.items():
                known[name] = merged(known.get(name), count)
            state.stored += len(known) - before
            self.seen.updateValue((state.bits, part), (json.dumps(known),))
        state.counts = {}
        while state.stored > PACKED << state.bits and state.bits < 32:
            for part in range(1 << state.bits):
                finer: dict[int, dict] = {}
                for name, count in self._part(state.bits, part).items():
                    finer.setdefault(part_of(name, state.bits + 2), {})[name] = count
                for place, share in finer.items():
                    self.seen.updateValue((state.bits + 2, place), (json.dumps(share),))
                self.seen.removeKey((state.bits, part))
            state.bits += 2

    def _all_counts(self, state: Held) -> Iterator[dict[str, tuple[int, int]]]:
        """The counts of all event keys, each key in one dictionary only."""
        if not state.stored:
            yield state.counts
            return
        self._store_counts(state)
        for _, (counts,) in self.seen.iterator():
            yield json.loads(counts)

    def _wait(self, state: Held, lines: list[tuple]) -> None:
        """Keep lines until the watermark has passed them."""
        if not state.listed and len(state.lines) + len(lines) <= PACKED:
            state.lines += lines
            return
        self.waiting.appendList(state.lines + lines)
        state.lines, state.listed = [], True

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, latest, lines = Held(self.held.get()), None, []
        for row in rows:
            seq, stamp, name = row.seq, row.stamp, row.event_key
            lines.append((seq, stamp, row.iteration, row.event))
            if name is not None:
                state.counts[name] = merged(state.counts.get(name), (1, seq))
            if latest is None or stamp > latest:
                latest = stamp
            if len(lines) > GATHERED:
                self._wait(state, lines)
                lines = []
            if len(state.counts) > GATHERED:
                self._store_counts(state)
        if latest is not None:
            self._wait(state, lines)
            if len(state.counts) > PACKED:
                self._store_counts(state)
            state.last = latest if state.last is None else max(state.last, latest)
            due = latest // 1000 + 1
            if state.timer is None or due < state.timer:
                self.handle.registerTimer(due)
                state.timer = due
            self.held.update(state.row())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self.held.get()
        if row is None:  # a timer of a run that is sealed already
            return
        state, settled = Held(row), timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for line in [*state.lines, *(tuple(line) for line in (self.waiting.get() if state.listed else ()))]:
            (ready if line[1] <= settled else later).append(line)
        if ready:
            fold = Fold(state.fold, self.first)
            for seq, _, iteration, event in sorted(ready, key=lambda line: (line[0], -1 if line[2] is None else line[2], line[3])):
                for rule, detail in fold.step(seq, iteration, event):
                    yield Row(run_id=key[0], seq=seq, rule=rule, detail=detail)
            state.fold = fold.values()
            if state.listed:
                self.waiting.clear()
            state.lines, state.listed = [], False
            self._wait(state, later)
        if not later and settled >= state.last + self.idle_ms * 1000:
            for counts in self._all_counts(state):
                for name, (count, seq) in counts.items():
                    if count > 1:
                        yield Row(run_id=key[0], seq=seq, rule="duplicate event", detail=f"{name} x{count}")
            self.held.clear()
            if state.stored:
                self.seen.clear()
        else:
            if expiredTimerInfo.getExpiryTimeInMs() >= state.timer:  # the one relied on; the next is for the lines left, or else for the silence
                state.timer = max(line[1] for line in later) // 1000 + 1 if later else state.last // 1000 + 1 + self.idle_ms
                self.handle.registerTimer(state.timer)
            self.held.update(state.row())

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """The state store that these checks need, in ``partitions`` parts, for queries started inside; the session's own settings come back after."""
    wanted = {STORE_SETTING: STORE} | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_violations(events: DataFrame, *, delay: str, idle_ms: int, first: int = 1) -> DataFrame:
    """The violations of a stream of (run_id, seq, ts, iteration, event, beam, candidate_id), each once and for good.

    ``delay`` is how far a line's stamp may lie behind the latest one, and
    ``idle_ms`` the silence after which a run counts as complete; it must exceed
    every pause inside a run.  Lines without a run, a ``seq`` or a stamp are the
    business of the line checks and take no part.
    """
    keyed = events.where("run_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select(
        F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("stamp"),
        F.col("iteration").cast("long").alias("iteration"), F.col("event"), event_key(events).alias("event_key"),
    )
    return keyed.withWatermark("ts", delay).groupBy("run_id").transformWithState(
        statefulProcessor=RunChecks(idle_ms, first), outputStructType=VIOLATION, outputMode="Append", timeMode="EventTime"
    )


def watch_runs(events: DataFrame, sink: str, checkpoint: str, *, delay: str, idle_ms: int, first: int = 1, partitions: int | None = None) -> StreamingQuery:
    """Check the lines present, append what is settled to ``sink`` and stop; run again with the same checkpoint to go on.

    The first start fixes the number of parts of the state: ``partitions``, or
    else the session's shuffle partitions.
    """
    broken = run_violations(events, delay=delay, idle_ms=idle_ms, first=first)
    with state_store(events.sparkSession, partitions):
        return (
            broken.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
