"""The append-only result cache: generations, exactly-once appends, last record of a key wins.

A cache folder holds ``lines/<token>`` folders of cache lines and ``commits``,
one small JSON file per generation.  An append first writes its lines under a
new token and then creates the next commit file, which no two writers can both
do.  Readers see committed folders only, so an append that failed half way, or
was repeated by a retry, leaves no trace; a batch that is already committed is
not written again.

Records are ordered by (generation, file, line).  ``compact`` writes the last
records of all generations so far as one; generations committed meanwhile still
come after it.  A folder without commits is read as plain files in the order in
which they were last written.

Lines are stored compressed.  A compressed file is read by one task, so a file
holds at most ``FILE_LINES`` lines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayframe.functions.strictjson import sorted_json, strict_json
from assayframe.sources.runlogs import RESULT, read_log_lines
from assayframe.sources.storage import create_once, hadoop_path, shuffles_dropped

CACHE_LINE = f"`key` array<string>, result {RESULT}, _bad string"
KEY = ("candidate_id", "property", "backend", "source")
STORED = ("candidate_id", "property", "status", "value", "unit", "n_replicates", "spread", "backend", "source", "provenance_tier", "reason")
# Lines of a stored file.
FILE_LINES = 250_000
COMMIT = "generation long, batch string, folder string, covers long"


class Commit(NamedTuple):
    """A generation: its batch, where its lines are, and up to which generation it stands for all (0: none)."""

    generation: int
    batch: str
    folder: str
    covers: int


class Committed(NamedTuple):
    """What an append did: its generation, and whether the batch had been committed before."""

    generation: int
    replayed: bool


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All generations of a cache in order; a commit file that was cut short counts as none."""
    folder, store = hadoop_path(spark, f"{path}/commits")
    if not store.exists(folder):
        return []
    rows = spark.read.schema(COMMIT).json(f"{path}/commits").where("generation IS NOT NULL AND folder IS NOT NULL").collect()
    return sorted(Commit(row["generation"], row["batch"], row["folder"], row["covers"] or 0) for row in rows)


def _commit(spark: SparkSession, path: str, batch: str, folder: str, covers: int) -> Committed:
    """Take the next free generation; if another writer committed the same batch first, that one counts."""
    number = 0
    while True:
        known = commits(spark, path)
        for commit in known:
            if commit.batch == batch:
                return Committed(commit.generation, True)
        number = max([number, *[commit.generation for commit in known]]) + 1
        text = json.dumps({"generation": number, "batch": batch, "folder": folder, "covers": covers}, sort_keys=True)
        if create_once(spark, f"{path}/commits/{number:012d}.json", text):
            return Committed(number, False)


def _line(key: Column, fields: dict[str, Column]) -> Column:
    """The canonical text of a cache line."""
    return sorted_json({"key": key, "result": F.struct(*[fields[name].alias(name) for name in sorted(fields)])})


def _line_of(key: str, result: str) -> Column:
    """The canonical text of a record that was read."""
    fields = {name: F.col(f"{result}.{name}") for name in (*STORED, "cached")}
    return _line(F.col(key), fields | {"cost": F.struct(f"{result}.cost.cpu_hours", f"{result}.cost.evals")})


def cache_line(results: DataFrame) -> DataFrame:
    """The ok and missing answers that were looked up afresh, as cache lines marked uncached, beside their columns."""
    fresh = results.where(F.col("status").isin("ok", "missing") & ~F.col("cached"))
    fields = {name: F.col(name) for name in STORED}
    fields["cached"] = F.lit(False)
    fields["cost"] = F.struct(F.col("cpu_hours").alias("cpu_hours"), F.col("evals").alias("evals"))
    return fresh.withColumn("_line", _line(F.array(*KEY), fields))


def _write_lines(lines: DataFrame, path: str) -> None:
    with shuffles_dropped(lines.sparkSession):
        lines.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(path)


def append_cache(results: DataFrame, path: str, batch: str | None = None, order: Sequence[str] = KEY[:2]) -> Committed:
    """Append fresh ok and missing answers as one generation, in ``order``; of equal keys in one batch the last wins.

    ``batch`` names the append: committing it again changes nothing.  Without a
    name every call is a batch of its own.
    """
    spark = results.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    for commit in commits(spark, path):
        if commit.batch == batch:
            return Committed(commit.generation, True)
    folder = f"lines/{uuid.uuid4().hex}"
    # Columns move, which are far smaller than the lines that are made of them.
    fresh = results.where(F.col("status").isin("ok", "missing") & ~F.col("cached"))
    ordered = fresh.repartitionByRange(*order).sortWithinPartitions(*order)
    _write_lines(cache_line(ordered).select(F.col("_line").alias("value")), f"{path}/{folder}")
    return _commit(spark, path, batch, folder, 0)


def append_stream(results: DataFrame, path: str, checkpoint: str, name: str, order: Sequence[str] = KEY[:2]) -> StreamingQuery:
    """Append the micro-batches present and stop; each is a batch of its own, so a restart appends none twice."""

    def append(rows: DataFrame, number: int) -> None:
        append_cache(rows, path, f"{name}-{number}", order)

    return results.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _checked(lines: DataFrame, *order: str) -> DataFrame:
    """``key``, ``result`` and the order of every line; a bad line fails the job and names its position."""
    record = F.from_json("value", CACHE_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.where(F.trim("value") != "").withColumn("r", record)
    # A text that its own record spells again is strict JSON; only others are parsed for it.
    same = F.coalesce(F.col("value") == _line_of("r.key", "r.result"), F.lit(False))
    sound = (
        F.when(same, True).otherwise(strict_json("value")) & F.col("r._bad").isNull() & (F.size("r.key") == len(KEY)) & F.col("r.result.status").isNotNull()
        & F.col("r.result.cached").isNotNull() & F.col("r.result.cost").isNotNull()
    )
    complaint = F.concat(F.col("file"), F.lit(":"), F.col("line"), F.lit(": malformed cache line"))
    key = F.when(F.coalesce(sound, F.lit(False)), F.col("r.key")).otherwise(F.raise_error(complaint))
    return parsed.select(key.alias("key"), "r.result", F.struct(*order).alias("order"))


def _last(lines: DataFrame) -> DataFrame:
    latest = lines.groupBy("key").agg(F.max_by("result", "order").alias("result"))
    return latest.select(*[F.col("key")[i].alias(name) for i, name in enumerate(KEY)], "result")


def live_commits(known: Sequence[Commit], as_of: int | None = None) -> list[Commit]:
    """The generations that a reader needs: the widest compaction, and what came after the ones it covers."""
    seen = [commit for commit in known if as_of is None or commit.generation <= as_of]
    base = max((commit for commit in seen if commit.covers), key=lambda commit: commit.covers, default=None)
    after = [commit for commit in seen if not commit.covers and (base is None or commit.generation > base.covers)]
    return after if base is None else [base, *after]


def read_cache(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Result cache: the last record of a key wins, over all generations or those up to ``as_of``; a bad line is an error that names it."""
    known = commits(spark, path)
    if not known:
        return _last(_checked(read_log_lines(spark, path, "file_modification_time"), "file_modification_time", "file", "line"))
    live = live_commits(known, as_of)
    if not live:
        return _last(_checked(spark.createDataFrame([], "file string, line long, value string, generation long"), "generation", "file", "line"))
    # A compaction stands where the last generation that it covers stood.
    numbers = [(commit.folder.rsplit("/", 1)[1], commit.covers or commit.generation) for commit in live]
    generations = spark.createDataFrame(numbers, "_token string, generation long")
    lines = read_log_lines(spark, [f"{path}/{commit.folder}" for commit in live])
    # One row per generation travels: a join that moves the lines would put those of a generation into one task.
    parts = F.split("file", "/")
    lines = lines.withColumns({"_token": F.element_at(parts, -2), "_name": F.element_at(parts, -1)}).join(F.broadcast(generations), "_token")
    return _last(_checked(lines, "generation", "_name", "line"))


def compact(spark: SparkSession, path: str) -> Committed | None:
    """Write the last record of every key as one generation that covers all so far; None if there is nothing to gain."""
    known = commits(spark, path)
    newest = max((commit.generation for commit in known if not commit.covers), default=0)
    if len(live_commits(known)) < 2:
        return None
    folder = f"lines/{uuid.uuid4().hex}"
    latest = read_cache(spark, path).select(F.array(*KEY).alias("key"), "result")
    _write_lines(latest.select(_line_of("key", "result").alias("value")), f"{path}/{folder}")
    return _commit(spark, path, f"compaction-{newest}-{uuid.uuid4().hex}", folder, newest)


def drop_covered(spark: SparkSession, path: str) -> int:
    """Delete the lines of generations that a compaction covers; readers that began before it may fail.  Returns how many went."""
    known = commits(spark, path)
    live = {commit.folder for commit in live_commits(known)}
    gone = 0
    for commit in known:
        if commit.folder not in live:
            target, store = hadoop_path(spark, f"{path}/{commit.folder}")
            gone += bool(store.delete(target, True))
    return gone
