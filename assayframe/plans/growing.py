"""Registered queries over tables that grow: caches appended in generations, logs read as streams, large tables compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayframe.operators import digests, sketches, upkeep
from assayframe.operators.scale import fits_one_task, position_chunk, running
from assayframe.plans import lookup
from assayframe.plans.registering import Shelf
from assayframe.plans.rounding import rounded
from assayframe.plans.runs import METRICS_SQL, run_metrics
from assayframe.plans.tables import LOG, candidates, event_log, lookups, row_bound, table
from assayframe.sources import caches
from assayframe.sources.bucketed import write_bucketed
from assayframe.sources.layout import write_clustered
from assayframe.sources.storage import shared_folder, write_shared
from assayframe.streaming import runs

SHELF = Shelf()
query = SHELF.query


def scratch(spark, label: str) -> str:
    """A new folder for what a query appends to, on the shared storage."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def line_answers(spark, sf_dir):
    """Lines as answers of lookups: one in five is missing, one in six came from a cache, one in seven failed."""
    lines = table(spark, sf_dir, "lineitem")
    missing, failed = F.pmod("l_orderkey", F.lit(5)) == 0, F.pmod("l_orderkey", F.lit(7)) == 0
    status = F.when(failed, "failed").when(missing, "missing").otherwise("ok")
    return lines.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("candidate_id"), F.col("l_returnflag").alias("property"),
        F.lit("table").alias("backend"), F.lit("parts@1").alias("source"), F.lit("simulated").alias("provenance_tier"), status.alias("status"),
        F.when(status == "ok", F.col("l_extendedprice")).alias("value"), F.lit("usd").alias("unit"), F.lit(1).cast("long").alias("n_replicates"),
        F.lit(None).cast("double").alias("spread"), F.lit(None).cast("string").alias("reason"), (F.pmod("l_orderkey", F.lit(6)) == 0).alias("cached"),
        F.lit(0.25).alias("cpu_hours"), F.lit(1).cast("long").alias("evals"), F.coalesce(F.year("l_shipdate") >= 1997, F.lit(False)).alias("late"),
    )


_ANSWER_ORDER = ["l_orderkey", "l_linenumber"]
_LAST_ANSWERS = """WITH answers AS (
  SELECT l_partkey::VARCHAR AS candidate_id, l_returnflag AS property, l_orderkey, l_linenumber, coalesce(year(l_shipdate) >= 1997, false) AS late,
         CASE WHEN l_orderkey % 7 = 0 THEN 'failed' WHEN l_orderkey % 5 = 0 THEN 'missing' ELSE 'ok' END AS status, l_extendedprice
  FROM lineitem WHERE l_orderkey % 6 <> 0),
stored AS (SELECT * FROM answers WHERE status <> 'failed' {only}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, property ORDER BY late DESC, {half}l_orderkey DESC, l_linenumber DESC) AS k FROM stored)
SELECT candidate_id, property, 'table' AS backend, 'parts@1' AS source, status, CASE WHEN status = 'ok' THEN round(l_extendedprice, 6) END AS value
FROM ranked WHERE k = 1"""


def _shown(cache):
    return cache.select("candidate_id", "property", "backend", "source", "result.status", F.round("result.value", 6).alias("value"))


@query("cache_generations", _LAST_ANSWERS.format(only="", half=""))
def cache_generations(spark, sf_dir):
    """Two appends, the second one retried, read back: later generations win whatever their line numbers."""
    answers, path = line_answers(spark, sf_dir), scratch(spark, "cache")
    caches.append_cache(answers.where("NOT late"), path, "early", _ANSWER_ORDER)
    caches.append_cache(answers.where("late"), path, "late", _ANSWER_ORDER)
    caches.append_cache(answers.where("late"), path, "late", _ANSWER_ORDER)
    return _shown(caches.read_cache(spark, path))


@query("cache_as_of", _LAST_ANSWERS.format(only="AND NOT late", half=""))
def cache_as_of(spark, sf_dir):
    """The cache as it was after the first of two appends."""
    answers, path = line_answers(spark, sf_dir), scratch(spark, "cache")
    first = caches.append_cache(answers.where("NOT late"), path, "early", _ANSWER_ORDER)
    caches.append_cache(answers.where("late"), path, "late", _ANSWER_ORDER)
    return _shown(caches.read_cache(spark, path, as_of=first.generation))


@query("cache_compacted", _LAST_ANSWERS.format(only="", half="CASE WHEN late THEN 0 ELSE l_orderkey % 2 END DESC, "))
def cache_compacted(spark, sf_dir):
    """An append, a compaction of it, another append, and a compaction of both."""
    answers, path = line_answers(spark, sf_dir), scratch(spark, "cache")
    early = answers.where("NOT late")
    for half in (0, 1):
        caches.append_cache(early.where(F.pmod("l_orderkey", F.lit(2)) == half), path, f"early-{half}", _ANSWER_ORDER)
    caches.compact(spark, path)
    caches.drop_covered(spark, path)  # nobody else reads this cache
    caches.append_cache(answers.where("late"), path, "late", _ANSWER_ORDER)
    caches.compact(spark, path)
    caches.drop_covered(spark, path)
    return _shown(caches.read_cache(spark, path))


_METRIC_KEY = ["run_id", "iteration", "beam", "population"]


@query(
    "stored_metric_differences",
    f"""WITH {METRICS_SQL}
SELECT run_id, iteration, beam, population, 'hits_top1' AS "column" FROM metrics WHERE run_id % 97 = 5 AND iteration = 1 AND population = 'all' AND run_id % 101 <> 7
UNION ALL SELECT run_id, iteration, beam, population, 'median_objective' FROM metrics
  WHERE run_id % 89 = 3 AND iteration = 1 AND population = 'promo' AND median_objective IS NOT NULL AND run_id % 101 <> 7
UNION ALL SELECT run_id, iteration, beam, population, '(row)' FROM metrics WHERE run_id % 101 = 7
UNION ALL SELECT run_id, iteration, beam, population, '(row)' FROM metrics WHERE run_id % 103 = 9 AND run_id % 101 <> 7""",
)
def stored_metric_differences(spark, sf_dir):
    """Stored metrics with changed hits and medians, lost runs and a run stored twice, against the recomputed ones."""
    computed = write_shared(run_metrics(spark, sf_dir), "metrics")

    def run_is(every: int, at: int):
        return F.pmod("run_id", F.lit(every)) == at

    first = F.col("iteration") == 1
    changed = computed.where(~run_is(101, 7)).withColumns({
        "hits_top1": F.col("hits_top1") + F.when(run_is(97, 5) & first & (F.col("population") == "all"), 1).otherwise(0),
        "median_objective": F.col("median_objective") + F.when(run_is(89, 3) & first & (F.col("population") == "promo"), 1.0).otherwise(0.0),
    })
    stored = changed.unionByName(changed.where(run_is(103, 9)))
    # Both sides come from one written table, so a count gives the shape without writing the changed one twice.
    here = digests.store(stored, _METRIC_KEY, scratch(spark, "stored"), digests.Shape.for_rows(stored.count()))
    there = digests.store(computed, _METRIC_KEY, scratch(spark, "computed"), here.shape)
    return digests.differences(spark, here, there, _METRIC_KEY, tolerance=1e-9).select(*_METRIC_KEY, "column")


# -- a log that grows ------------------------------------------------------------------------

_STREAM_SQL = f"""WITH {LOG}, placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM log),
kept AS (SELECT run_id, place AS seq, iteration, event FROM placed WHERE seq % 97 <> 5 UNION ALL SELECT run_id, place, iteration, event FROM placed WHERE seq % 89 = 3 AND seq % 97 <> 5),
state AS (
  SELECT *, row_number() OVER w AS position, lag(event) OVER w AS previous,
    last_value(CASE WHEN event IN ('iteration_opened', 'iteration_closed') THEN event END IGNORE NULLS) OVER p AS mark,
    last_value(CASE WHEN event IN ('iteration_opened', 'iteration_closed') THEN iteration END IGNORE NULLS) OVER p AS mark_iteration,
    coalesce(last_value(CASE WHEN event = 'iteration_closed' THEN iteration END IGNORE NULLS) OVER p, 0) AS closed
  FROM kept WINDOW w AS (PARTITION BY run_id ORDER BY seq),
                   p AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, CASE WHEN mark = 'iteration_opened' THEN mark_iteration END AS open_iteration, event || '/' || iteration AS detail FROM state),
keyed AS (SELECT run_id, seq, CASE WHEN event = 'selection' THEN 'beam' ELSE event END || '/' || iteration
    || CASE WHEN event IN ('selection', 'evaluation') THEN '/b' ELSE '' END || CASE WHEN event = 'evaluation' THEN '/' || seq % 4 ELSE '' END AS k FROM kept)
SELECT run_id::VARCHAR AS run_id, seq, 'seq is not its position' AS rule, 'expected ' || position AS detail FROM opened WHERE seq <> position
UNION ALL SELECT run_id::VARCHAR, seq, 'first event is not run_opened', detail FROM opened WHERE previous IS NULL AND event <> 'run_opened'
UNION ALL SELECT run_id::VARCHAR, seq, 'event follows run_closed', detail FROM opened WHERE previous = 'run_closed'
UNION ALL SELECT run_id::VARCHAR, seq, 'iteration opens out of order', detail FROM opened WHERE event = 'iteration_opened' AND (open_iteration IS NOT NULL OR iteration <> closed + 1)
UNION ALL SELECT run_id::VARCHAR, seq, 'event outside its iteration', detail FROM opened
  WHERE event IN ('selection', 'evaluation', 'iteration_closed') AND NOT coalesce(iteration = open_iteration, false)
UNION ALL SELECT run_id::VARCHAR, max(seq), 'duplicate event', k || ' x' || count(*) FROM keyed GROUP BY run_id, k HAVING count(*) > 1"""
_LOG_BATCHES, _STATE_ROWS = 3, 20_000


@query("log_stream_violations", _STREAM_SQL)
def log_stream_violations(spark, sf_dir):
    """User events as a log that lost some lines and repeats others, arriving in batches, every eleventh line one batch late."""
    bound = row_bound(spark, sf_dir, "events")
    log = event_log(spark, sf_dir, None if fits_one_task(bound) else position_chunk("seq"))
    placed = running(log, ["run_id"], ["seq"], {"place": ("sum", F.lit(1))}, chunk=None if fits_one_task(bound) else position_chunk("seq"))
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    lines = placed.where(F.pmod("seq", F.lit(97)) != 5).join(times, "seq")
    copies = F.when(F.pmod("seq", F.lit(89)) == 3, 2).otherwise(1)
    lines = write_shared(
        lines.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
            "run_id", F.col("place").alias("seq"), "ts", "iteration", "event", F.lit("b").alias("beam"),
            F.pmod("place", F.lit(4)).cast("string").alias("candidate_id"), (F.pmod("seq", F.lit(11)) == 0).cast("int").alias("late"),
        ), "log-lines",
    )
    span = lines.agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")).first()
    source, columns = scratch(spark, "log"), ["run_id", "seq", "ts", "iteration", "event", "beam", "candidate_id"]
    width = max(1, (span["last"] - span["first"]) // _LOG_BATCHES + 1) if span["first"] is not None else 1
    arrival = F.floor((F.unix_micros("ts") - F.lit(span["first"] or 0)) / F.lit(width)) + F.col("late")
    # Lines of a run that nobody looks at move the time on, until every run counts as complete.
    far = 4 * width + (span["last"] or 0)
    clocks = [
        spark.range(1).select(
            F.lit(-1).cast(lines.schema["run_id"].dataType).alias("run_id"), F.lit(step).cast("long").alias("seq"), F.timestamp_micros(F.lit(far + step)).alias("ts"),
            F.lit(None).cast("long").alias("iteration"), F.lit("run_opened").alias("event"), F.lit(None).cast("string").alias("beam"), F.lit(None).cast("string").alias("candidate_id"),
        )
        for step in (1, 2)
    ]
    sink, checkpoint = scratch(spark, "log-violations"), scratch(spark, "log-checkpoint")
    delay, idle = f"{width // 1000 + 1} milliseconds", 2 * width // 1000
    # At most as many parts of the state as the session shuffles into; few for few lines.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + bound // _STATE_ROWS)
    for part in [*[lines.where(arrival == batch).select(*columns) for batch in range(_LOG_BATCHES + 1)], *clocks]:
        part.write.mode("append").parquet(source)  # each batch arrives on its own, and its query goes on from the checkpoint
        stream = spark.readStream.schema(lines.select(*columns).schema).parquet(source)
        runs.watch_runs(stream, sink, checkpoint, delay=delay, idle_ms=idle, partitions=parts).awaitTermination()
    return spark.read.schema(runs.VIOLATION).parquet(sink).where("run_id <> '-1'")


# -- a candidate table under appends ---------------------------------------------------------

_KEPT = ("price", "discount")


@query(
    "candidates_appended",
    """WITH m AS (SELECT l_partkey AS key, nullif(l_returnflag, 'N') AS label, l_extendedprice AS price, nullif(l_discount, 0.0) AS discount FROM lineitem),
e AS (SELECT key, min(label) AS lone, max(label) AS last FROM m GROUP BY key),
r AS (SELECT m.*, coalesce(label, CASE WHEN lone = last THEN lone END, 'unknown') AS resolved_label FROM m JOIN e USING (key))
SELECT key, resolved_label, count(*) AS n_rows, round(median(price), 6) AS price_median, count(price) AS price_n, min(price) AS price_min, max(price) AS price_max,
  round(stddev_samp(price), 4) AS price_std, round(median(discount), 6) AS discount_median, count(discount) AS discount_n, min(discount) AS discount_min,
  max(discount) AS discount_max, round(stddev_samp(discount), 4) AS discount_std
FROM r GROUP BY key, resolved_label""",
)
def candidates_appended(spark, sf_dir):
    """Lines up to 1993 as a candidate table, then two years and the rest appended, the second append repeated."""
    path = scratch(spark, "candidates")
    years = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey"), F.nullif("l_returnflag", F.lit("N")).alias("label"), F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.coalesce(F.year("l_shipdate"), F.lit(0)).alias("year"),
    )
    bound = row_bound(spark, sf_dir, "lineitem")
    slices = {"first": F.col("year") <= 1993, "1994": F.col("year") == 1994, "1995": F.col("year") == 1995, "rest": F.col("year") > 1995}
    for batch, chosen in [*slices.items(), ("1994", slices["1994"])]:
        upkeep.append_rows(years.where(chosen), _KEPT, path, key="l_partkey", label="label", batch=batch, rows_bound=bound)
    table_now = upkeep.read_candidates(spark, path)
    places = {f"{name}_{what}": digits for name in _KEPT for what, digits in (("median", 6), ("std", 4))}
    return table_now.withColumns({name: F.round(name, digits) for name, digits in places.items()})


# -- stored approximations -------------------------------------------------------------------

_SKETCHED = ("l_quantity", "l_extendedprice", "l_partkey")


@query(
    "sketches_rolled_up",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count({name}) AS n, count(DISTINCT {name}) AS n_distinct, true AS distinct_within, true AS p90_within FROM lineitem"""
        for name in _SKETCHED
    ),
)
def sketches_rolled_up(spark, sf_dir):
    """Sketches per ship day, stored and merged, beside the exact counts: whether each approximation is within its stated error."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    stored = write_shared(sketches.build_sketches(lines, _SKETCHED, ["day"]), "sketches")
    merged = sketches.roll_up(stored).select("column", "n", sketches.approx_distinct().alias("about"), sketches.approx_quantile(0.9).alias("p90"))
    found = {row["column"]: row for row in merged.collect()}  # one row per column
    exact = lines.agg(*[
        total.alias(f"{what}_{name}")
        for name in found
        for what, total in (
            ("distinct", F.count_distinct(name)), ("below", F.count_if(F.col(name) < F.lit(found[name]["p90"]))), ("upto", F.count_if(F.col(name) <= F.lit(found[name]["p90"])))
        )
    ]) if found else None
    rows = []
    for name, row in found.items():
        n, distinct = F.lit(row["n"]), F.col(f"distinct_{name}")
        within = (F.col(f"below_{name}") <= n * (0.9 + sketches.RANK_ERROR)) & (F.col(f"upto_{name}") >= n * (0.9 - sketches.RANK_ERROR))
        rows.append(F.struct(
            F.lit(name).alias("column"), n.alias("n"), distinct.alias("n_distinct"),
            (F.abs(F.lit(row["about"]) - distinct) <= distinct * sketches.DISTINCT_ERROR).alias("distinct_within"), within.alias("p90_within"),
        ))
    if exact is None:
        return spark.createDataFrame([], "column string, n long, n_distinct long, distinct_within boolean, p90_within boolean")
    return exact.select(F.inline(F.array(*rows)))


# -- tables laid out for joins ---------------------------------------------------------------

_CANDIDATE_BUCKETS = 8


@query("evaluate_status_bucketed", lookup.SHELF.oracles["evaluate_status"])
def evaluate_status_bucketed(spark, sf_dir):
    """Lookups answered from a candidate table in buckets of its key."""
    bound = lookup.lookup_bound(spark, sf_dir)
    held = write_bucketed(candidates(spark, sf_dir), scratch(spark, "candidates"), "candidate_id", _CANDIDATE_BUCKETS)
    return rounded(lookup.answered_status(lookups(spark, sf_dir, bound), held))


_CLUSTERED_ROWS = 1_000_000  # rows of a file of the clustered copy


@query(
    "clustered_windows",
    """WITH bounds AS (SELECT max(l_partkey) AS most FROM lineitem),
w AS (SELECT 'key' AS "window", l_returnflag, l_extendedprice FROM lineitem, bounds WHERE l_partkey BETWEEN most * 0.40 AND most * 0.45
UNION ALL SELECT 'value', l_returnflag, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 30000 AND 33000
UNION ALL SELECT 'both', l_returnflag, l_extendedprice FROM lineitem, bounds
WHERE l_partkey BETWEEN most * 0.40 AND most * 0.45 AND l_extendedprice BETWEEN 30000 AND 33000)
SELECT "window", l_returnflag, count(*) AS n_rows, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM w GROUP BY ALL""",
)
def clustered_windows(spark, sf_dir):
    """Rows per flag in a window of keys, a window of values and both, from a copy of the lines clustered on key and value."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag")
    size = lines.agg(F.count(F.lit(1)).alias("n"), F.max("l_partkey").alias("most")).first()
    files = max(1, -(-size["n"] // _CLUSTERED_ROWS))
    held = write_clustered(lines, scratch(spark, "clustered"), ["l_partkey", "l_extendedprice"], files)
    # Whole bounds, so that the column is compared as it is stored and the condition reaches the scan.
    low, high = -(-(size["most"] or 0) * 40 // 100), (size["most"] or 0) * 45 // 100
    by_key, by_value = F.col("l_partkey").between(low, high), F.col("l_extendedprice").between(30000.0, 33000.0)
    windows = [held.where(chosen).withColumn("window", F.lit(name)) for name, chosen in (("key", by_key), ("value", by_value), ("both", by_key & by_value))]
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    value = F.col("l_extendedprice")
    return windows[0].union(windows[1]).union(windows[2]).groupBy("window", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), cents, F.min(value).alias("least"), F.max(value).alias("most")
    )
