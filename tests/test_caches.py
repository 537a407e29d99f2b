"""The append-only cache: generations, retries, races, compaction, streams."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from assayframe.sources import caches, storage

SPEC = (
    "candidate_id string, property string, backend string, source string, provenance_tier string, status string, value double, unit string, "
    "n_replicates long, spread double, reason string, cached boolean, cpu_hours double, evals long, n long"
)


def answers(spark, *rows):
    """``(candidate_id, value)`` rows as fresh answers, in this order."""
    full = [(key, "p", "table", "s", "simulated", "ok" if value is not None else "missing", value, "u", 1, None, None, False, 0.5, 1, i)
            for i, (key, value) in enumerate(rows)]
    return spark.createDataFrame(full, SPEC)


def values(spark, path, **how):
    return {row["candidate_id"]: row["value"] for row in caches.read_cache(spark, path, **how).select("candidate_id", "result.value").collect()}


def test_a_later_append_wins_with_a_smaller_line_number(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = caches.append_cache(answers(spark, ("a", 1.0), ("b", 1.0), ("k", 1.0)), path, "one")
    second = caches.append_cache(answers(spark, ("k", 2.0)), path, "two")
    assert (first, second) == (caches.Committed(1, False), caches.Committed(2, False))
    assert values(spark, path) == {"a": 1.0, "b": 1.0, "k": 2.0}
    assert values(spark, path, as_of=1) == {"a": 1.0, "b": 1.0, "k": 1.0}
    assert values(spark, path, as_of=0) == {}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    caches.append_cache(answers(spark, ("a", 1.0)), path, "one")
    caches.append_cache(answers(spark, ("a", 2.0)), path, "two")
    assert caches.append_cache(answers(spark, ("a", 1.0)), path, "one") == caches.Committed(1, True)
    assert values(spark, path) == {"a": 2.0}
    assert len(list((tmp_path / "cache/lines").iterdir())) == 2


def test_lines_without_a_commit_do_not_exist(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    caches.append_cache(answers(spark, ("a", 1.0)), path, "one")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(caches, "_commit", fails)
        with pytest.raises(OSError, match="lost"):
            caches.append_cache(answers(spark, ("a", 2.0)), path, "two")
    assert values(spark, path) == {"a": 1.0}
    assert caches.append_cache(answers(spark, ("a", 2.0)), path, "two") == caches.Committed(2, False)
    assert values(spark, path) == {"a": 2.0}


def test_writers_that_meet_take_different_generations(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    real, met = caches.create_once, []

    def slow(session, file, text):
        if not met:  # another writer is faster, and a third one died while it wrote
            met.append(file)
            assert real(session, file, json.dumps({"generation": 1, "batch": "other", "folder": "lines/x", "covers": 0}))
            assert real(session, file.replace("1.json", "2.json"), '{"generation": 2, "ba')
        return real(session, file, text)

    monkeypatch.setattr(caches, "create_once", slow)
    assert caches.append_cache(answers(spark, ("a", 1.0)), path, "mine") == caches.Committed(3, False)
    assert [(c.generation, c.batch) for c in caches.commits(spark, path)] == [(1, "other"), (3, "mine")]


def test_of_equal_keys_in_a_batch_the_last_in_order_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = answers(spark, *[("k", float(i)) for i in range(50)]).repartition(7, "n")
    caches.append_cache(rows, path, "one", order=["n"])
    assert values(spark, path) == {"k": 49.0}
    caches.append_cache(rows.withColumn("status", F.lit("missing")).withColumn("value", F.lit(None).cast("double")), path, "two", order=["n"])
    assert values(spark, path) == {"k": None}


def test_compaction_keeps_what_comes_after_it(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert caches.compact(spark, path) is None
    for number in range(3):
        caches.append_cache(answers(spark, ("a", float(number)), (f"x{number}", 1.0)), path, f"b{number}")
    known = caches.commits(spark, path)
    before = values(spark, path)
    compacted = caches.compact(spark, path)
    assert (compacted.generation, caches.live_commits(caches.commits(spark, path))[0].covers) == (4, 3)
    assert values(spark, path) == before
    # A writer that committed while the compaction ran still comes after it.
    racing = caches.Commit(4, "racing", "lines/r", 0)
    order = caches.live_commits([*known, racing, caches.Commit(5, "c", "lines/c", 3)])
    assert [commit.batch for commit in order] == ["c", "racing"]
    caches.append_cache(answers(spark, ("a", 9.0)), path, "b3")
    assert values(spark, path) == before | {"a": 9.0}
    assert caches.drop_covered(spark, path) == 3
    assert values(spark, path) == before | {"a": 9.0}


def test_a_stream_appends_each_micro_batch_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "cache")
    answers(spark, ("a", 1.0), ("b", 1.0)).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(SPEC).json(source)
    caches.append_stream(stream(), path, str(tmp_path / "check"), "feed").awaitTermination()
    answers(spark, ("a", 2.0)).write.mode("append").json(source)
    caches.append_stream(stream(), path, str(tmp_path / "check"), "feed").awaitTermination()
    assert values(spark, path) == {"a": 2.0, "b": 1.0}
    # The second batch was written, but the checkpoint did not hear of it.
    for done in (tmp_path / "check/commits").glob("*1*"):
        done.unlink()
    caches.append_stream(stream(), path, str(tmp_path / "check"), "feed").awaitTermination()
    assert values(spark, path) == {"a": 2.0, "b": 1.0}
    assert len(caches.commits(spark, path)) == 2


def test_plain_files_are_read_in_the_order_of_their_writing(spark, tmp_path):
    import os

    def line(value):
        return json.dumps({"key": ["k", "p", "table", "s"], "result": {"status": "ok", "value": value, "cached": False, "cost": {"evals": 1, "cpu_hours": 0.0}}})

    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.jsonl").write_text("\n\n" + line(1.0) + "\n")
    (tmp_path / "plain/b.jsonl").write_text(line(2.0) + "\n")
    os.utime(tmp_path / "plain/a.jsonl", (1_000_000, 1_000_000))
    assert values(spark, str(tmp_path / "plain")) == {"k": 2.0}
    os.utime(tmp_path / "plain/b.jsonl", (900_000, 900_000))
    assert values(spark, str(tmp_path / "plain")) == {"k": 1.0}


def test_stored_lines_are_small_and_do_not_move_to_be_ordered(spark, tmp_path, monkeypatch):
    """Lines are stored compressed, in files that one task can read, and only one row per generation travels to order them."""
    monkeypatch.setattr(caches, "FILE_LINES", 3, raising=False)
    path = str(tmp_path / "cache")
    rows = answers(spark, *[(f"k{i % 20}", float(i)) for i in range(400)]).coalesce(1)
    caches.append_cache(rows, path, "one", order=["n"])
    caches.append_cache(rows.where("n < 10").withColumn("value", F.lit(-1.0)), path, "two", order=["n"])
    files = [file for file in (tmp_path / "cache/lines").rglob("*") if file.name.startswith("part-")]
    assert len(files) > 130 and all(file.suffix == ".gz" for file in files)
    assert values(spark, path) == {f"k{i}": -1.0 if i < 10 else 380.0 + i for i in range(20)}
    assert "SortMergeJoin" not in caches.read_cache(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_a_line_in_another_spelling_is_still_checked(spark, tmp_path):
    path = str(tmp_path / "cache")
    caches.append_cache(answers(spark, ("a", 1.0)), path, "one")
    folder = next((tmp_path / "cache/lines").iterdir())
    line = '{"result": {"status": "ok", "value": 2.0, "cached": false, "cost": {"evals": 1, "cpu_hours": 0.0}}, "key": ["b", "p", "table", "s"]%s}'
    (folder / "part-a.txt").write_text(line % "" + "\n")
    assert values(spark, path) == {"a": 1.0, "b": 2.0}
    (folder / "part-b.txt").write_text(line % ', "key": ["c", "p", "table", "s"]' + "\n")
    with pytest.raises(Exception, match="part-b.txt:1: malformed cache line"):
        values(spark, path)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_is_written_leaves_no_shuffle_files(spark, tmp_path):
    before, setting = shuffle_files(spark), spark.conf.get(storage._SHUFFLE_CLEANUP, None)
    caches.append_cache(answers(spark, *[(f"k{i}", 1.0) for i in range(50)]), str(tmp_path / "cache"), "one")
    storage.write_shared(spark.range(1000).repartition(5, "id"), "kept")
    until = time.time() + 20  # files go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(storage._SHUFFLE_CLEANUP, None) == setting
