"""Registered queries: batched lookups, caching, charging, budgets and state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayframe.functions.columns import format_timestamp, make_run_id, parse_timestamp
from assayframe.operators import lookups as ops
from assayframe.operators.backends import python_backend
from assayframe.operators.scale import fits_one_map, fits_one_task, running_by_size
from assayframe.plans.registering import Shelf
from assayframe.plans.rounding import rounded
from assayframe.plans.tables import (
    ANSWERS, CANDIDATES, RESULTS, SERVED, candidates, lookups, order_lines, row_bound, table,
)
from assayframe.sources import runlogs
from assayframe.sources.storage import shared_folder

SHELF = Shelf()
query = SHELF.query
LIMIT = 20
FACTS = {"backend": "table", "source": "parts@1", "tier": "simulated"}


def lookup_bound(spark, sf_dir) -> int:
    """Lines times the most properties a line asks for."""
    return 3 * row_bound(spark, sf_dir, "lineitem")


def candidate_bound(spark, sf_dir) -> int:
    """The most lookups of any one candidate, over all runs: its lines times the most properties a line asks for."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return 3 * (lines.agg(F.max("n")).first()[0] or 0)


def lookup_results(spark, sf_dir, bound, hot_rows=None):
    most = None if hot_rows is not None or fits_one_task(bound) else candidate_bound(spark, sf_dir)
    asked = lookups(spark, sf_dir, bound, by_candidate=fits_one_map(most))
    return ops.evaluate(asked, candidates(spark, sf_dir), SERVED, rows_bound=bound, candidate_bound=most, hot_rows=hot_rows, **FACTS)


_STATUS_COLUMNS = ["run_id", "request_seq", "entry_pos", "property", "candidate_id", "status", "reason", "value", "unit",
                   "n_replicates", "spread", "backend", "source", "provenance_tier"]


@query(
    "evaluate_status",
    f"""WITH {ANSWERS} SELECT run_id, request_seq, entry_pos, property, candidate_id, status, reason,
  CASE WHEN status = 'ok' THEN round(value, 6) END AS value,
  CASE WHEN status = 'ok' THEN CASE property WHEN 'retail' THEN 'usd' ELSE 'cm' END END AS unit,
  CASE WHEN status = 'ok' THEN n END AS n_replicates,
  CASE WHEN status = 'ok' AND n >= 2 THEN round(std, 6) END AS spread,
  'table' AS backend, 'parts@1' AS source, 'simulated' AS provenance_tier FROM answers""",
)
def evaluate_status(spark, sf_dir):
    bound = lookup_bound(spark, sf_dir)
    return rounded(answered_status(lookups(spark, sf_dir, bound), candidates(spark, sf_dir)))


def answered_status(asked, known):
    return ops.answer(asked, known, SERVED, **FACTS).select(*_STATUS_COLUMNS)


_CHARGED_SQL = f"""WITH {RESULTS} SELECT run_id, request_seq, entry_pos, property, candidate_id, status, cached, evals::BIGINT AS evals FROM charged"""
_CHARGED_COLUMNS = ["run_id", "request_seq", "entry_pos", "property", "candidate_id", "status", "cached", "evals"]


@query("evaluate_cached_charged", _CHARGED_SQL)
def evaluate_cached_charged(spark, sf_dir):
    return lookup_results(spark, sf_dir, lookup_bound(spark, sf_dir)).select(*_CHARGED_COLUMNS)


@query("evaluate_cached_charged_chunked", _CHARGED_SQL)
def evaluate_cached_charged_chunked(spark, sf_dir):
    """Candidates a run asks for more than twice count as hot."""
    return lookup_results(spark, sf_dir, None, hot_rows=2).select(*_CHARGED_COLUMNS)


_PRELOADED_SQL = f"""WITH {ANSWERS},
pre AS (SELECT DISTINCT run_id, candidate_id, property FROM answers JOIN orders ON request_seq = o_orderkey WHERE o_orderstatus = 'F'),
flagged AS (SELECT a.*, status IN ('ok', 'missing') AND (p.run_id IS NOT NULL OR coalesce(min(CASE WHEN status IN ('ok', 'missing') THEN request_seq END)
      OVER (PARTITION BY a.run_id, a.candidate_id, a.property) < request_seq, false)) AS cached
  FROM answers a LEFT JOIN pre p ON a.run_id = p.run_id AND a.candidate_id = p.candidate_id AND a.property = p.property)
SELECT property, status, cached, count(*) AS n FROM flagged GROUP BY ALL"""


@query("evaluate_preloaded_cache", _PRELOADED_SQL)
def evaluate_preloaded_cache(spark, sf_dir):
    bound = lookup_bound(spark, sf_dir)
    answered = ops.answer(lookups(spark, sf_dir, bound), candidates(spark, sf_dir), SERVED, **FACTS)
    filled = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("request_seq"))
    preloaded = answered.join(filled, "request_seq", "left_semi").select(*ops.PAIR).distinct()
    flagged = ops.flag_cached(answered, preloaded=preloaded)
    return flagged.groupBy("property", "status", "cached").agg(F.count("*").alias("n"))


_COSTS = f"{RESULTS}, costs AS (SELECT run_id, request_seq, sum(evals)::BIGINT AS evals FROM charged GROUP BY ALL)"


@query("request_costs", f"WITH {_COSTS} SELECT *, 0.0::DOUBLE AS cpu_hours FROM costs")
def request_costs(spark, sf_dir):
    return ops.request_costs(lookup_results(spark, sf_dir, lookup_bound(spark, sf_dir)))


_CUTOFF_SQL = f"""WITH {_COSTS},
totals AS (SELECT *, sum(evals) OVER (PARTITION BY run_id ORDER BY request_seq) AS upto FROM costs),
breaches AS (SELECT *, min(CASE WHEN upto > {LIMIT} THEN request_seq END) OVER (PARTITION BY run_id) AS breach FROM totals)
SELECT run_id, request_seq, evals, (upto - evals)::BIGINT AS spent, breach IS NULL OR request_seq < breach AS kept,
       coalesce(request_seq = breach, false) AS refused FROM breaches"""


def _cutoff(spark, sf_dir, bound):
    costs = ops.request_costs(lookup_results(spark, sf_dir, bound)).select("run_id", "request_seq", "evals")
    return ops.budget_cutoff(costs, F.lit(LIMIT), rows_bound=bound)


@query("budget_cutoff", _CUTOFF_SQL)
def budget_cutoff(spark, sf_dir):
    return _cutoff(spark, sf_dir, lookup_bound(spark, sf_dir))


@query("budget_cutoff_chunked", _CUTOFF_SQL)
def budget_cutoff_chunked(spark, sf_dir):
    return _cutoff(spark, sf_dir, None)


_GREEDY_SQL = f"""WITH RECURSIVE {ANSWERS},
requests AS (
  SELECT run_id, request_seq, row_number() OVER (PARTITION BY run_id ORDER BY request_seq) AS step,
         coalesce(list(DISTINCT candidate_id || '|' || property) FILTER (WHERE status = 'ok'), []) AS pairs
  FROM answers GROUP BY run_id, request_seq),
fold AS (
  SELECT run_id, 0::BIGINT AS request_seq, 0::BIGINT AS step, 0::BIGINT AS cost, true AS accepted, {LIMIT}::BIGINT AS remaining, []::VARCHAR[] AS known
  FROM requests WHERE step = 1
  UNION ALL
  SELECT run_id, request_seq, step, cost, cost <= remaining, CASE WHEN cost <= remaining THEN remaining - cost ELSE remaining END,
         CASE WHEN cost <= remaining THEN list_concat(known, pairs) ELSE known END
  FROM (SELECT r.run_id, r.request_seq, r.step, f.remaining, f.known, r.pairs,
               len(list_distinct(list_transform(list_filter(r.pairs, lambda p: NOT list_contains(f.known, p)), lambda p: split_part(p, '|', 1)))) AS cost
        FROM fold f JOIN requests r ON r.run_id = f.run_id AND r.step = f.step + 1))
SELECT run_id, request_seq, cost AS evals, accepted FROM fold WHERE step > 0"""


@query("budget_greedy", _GREEDY_SQL)
def budget_greedy(spark, sf_dir):
    bound = lookup_bound(spark, sf_dir)
    answered = ops.answer(lookups(spark, sf_dir, bound), candidates(spark, sf_dir), SERVED)
    return ops.budget_greedy(answered, LIMIT, rows_bound=bound)


@query("budget_greedy_rounds", _GREEDY_SQL)
def budget_greedy_rounds(spark, sf_dir):
    most = candidate_bound(spark, sf_dir)
    asked = lookups(spark, sf_dir, lookup_bound(spark, sf_dir), by_candidate=fits_one_map(most))
    return ops.budget_greedy(ops.answer(asked, candidates(spark, sf_dir), SERVED), LIMIT, hot_rows=0, candidate_bound=most)


@query(
    "state_rebuild",
    f"""WITH {RESULTS} SELECT run_id, candidate_id, property, 'table' AS backend, 'parts@1' AS source,
  arg_max(status, (request_seq, entry_pos, prop_pos)) AS status, round(max(CASE WHEN status = 'ok' THEN value END), 6) AS value,
  max(request_seq) AS request_seq
FROM charged WHERE NOT cached AND status IN ('ok', 'missing') GROUP BY ALL""",
)
def state_rebuild(spark, sf_dir):
    return rounded(ops.rebuild_cache(lookup_results(spark, sf_dir, lookup_bound(spark, sf_dir))))


@query("meter", f"WITH {RESULTS} SELECT run_id, sum(evals)::BIGINT AS evals, 0.0::DOUBLE AS cpu_hours FROM charged GROUP BY 1")
def meter(spark, sf_dir):
    return ops.meter(lookup_results(spark, sf_dir, lookup_bound(spark, sf_dir)))


@query(
    "remaining_work",
    """WITH planned AS (SELECT DISTINCT o_custkey AS run_id, year(o_orderdate) - 1994 AS iteration, o_orderpriority AS beam, l_partkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
recorded AS (SELECT o_custkey AS run_id, year(o_orderdate) - 1994 AS iteration, o_orderpriority AS beam, l_partkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F')
SELECT * FROM planned ANTI JOIN recorded USING (run_id, iteration, beam, candidate_id)""",
)
def remaining_work(spark, sf_dir):
    key = ["run_id", "iteration", "beam", "candidate_id"]
    lines = order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("run_id"), (F.year("o_orderdate") - 1994).cast("long").alias("iteration"),
        F.col("o_orderpriority").alias("beam"), F.col("l_partkey").alias("candidate_id"), "l_linestatus",
    )
    return ops.remaining_work(lines.select(*key).distinct(), lines.where("l_linestatus = 'F'"), key)


@query(
    "served_values",
    f"""WITH {CANDIDATES}, m AS (SELECT DISTINCT l_partkey AS candidate_id FROM lineitem WHERE l_quantity BETWEEN 2 AND 45)
SELECT candidate_id, retail_median AS retail, size_median AS size FROM m LEFT JOIN candidates USING (candidate_id)""",
)
def served_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(2, 45))
    ids = lines.select(F.col("l_partkey").alias("candidate_id")).distinct()
    return ops.served_values(ids, candidates(spark, sf_dir), {"retail": "retail_median", "size": "size_median"})


@query(
    "failure_isolation",
    f"""WITH {ANSWERS}, failing AS (
  SELECT a.property, CASE WHEN status <> 'unsupported' AND p_name LIKE 'hot %' AND c.candidate_id IS NOT NULL THEN 'error' ELSE status END AS status,
         CASE WHEN status <> 'unsupported' AND p_name LIKE 'hot %' AND c.candidate_id IS NOT NULL THEN 'TimeoutError' ELSE reason END AS reason
  FROM answers a LEFT JOIN candidates c USING (candidate_id))
SELECT property, status, reason, count(*) AS n FROM failing GROUP BY ALL""",
)
def failure_isolation(spark, sf_dir):
    bound = lookup_bound(spark, sf_dir)
    failing = F.when(F.col("p_name").startswith("hot "), F.lit("TimeoutError"))
    served = candidates(spark, sf_dir).withColumn("failure", failing)
    answered = ops.answer(lookups(spark, sf_dir, bound), served, SERVED, failure="failure")
    return answered.groupBy("property", "status", "reason").agg(F.count("*").alias("n"))


def _square_root_of_price(candidate_id, key, row):
    """A backend that fails on some inputs: sizes are unknown to it and low prices are refused."""
    if key != "retail":
        raise KeyError(key)
    if row["retail_median"] < 950:
        raise ValueError("below the range of the model")
    return row["retail_median"] ** 0.5


@query(
    "python_backend",
    f"""WITH {CANDIDATES}, asked AS (SELECT candidate_id, unnest(['retail', 'size']) AS property, retail_median FROM candidates)
SELECT candidate_id, property, CASE WHEN property = 'size' THEN 'error' WHEN retail_median < 950 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN property = 'size' THEN 'KeyError' WHEN retail_median < 950 THEN 'ValueError' END AS reason,
  CASE WHEN property = 'retail' AND retail_median >= 950 THEN round(sqrt(retail_median), 6) END AS value FROM asked""",
)
def python_backend_query(spark, sf_dir):
    asked = candidates(spark, sf_dir).select(
        "candidate_id", F.explode(F.array(F.lit("retail"), F.lit("size"))).alias("property"), "retail_median"
    )
    return rounded(python_backend(asked, _square_root_of_price).drop("retail_median"))


@query(
    "request_checks",
    """SELECT o_custkey AS run_id, o_orderkey AS request_seq, CASE WHEN n = 0 THEN 'request has no entry' ELSE 'request has too many entries' END AS rule
FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE n < 1 OR n > 8""",
)
def request_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("request_seq"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_seq"))
    return ops.request_size_violations(orders, entries, most=8)


@query(
    "response_lines",
    f"""WITH {RESULTS} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY request_seq, entry_pos, prop_pos) AS place,
  '{{"candidate_id":' || candidate_id || ',"entry_pos":' || entry_pos || ',"property":"' || property || '","reason":' || coalesce('"' || reason || '"', 'null')
    || ',"request_seq":' || request_seq || ',"run_id":' || run_id || ',"status":"' || status || '"}}' AS line FROM charged""",
)
def response_lines(spark, sf_dir):
    """Answers in response order as canonical lines, written and read back; ``place`` is where a run's lines stand in the files."""
    path = f"{shared_folder(spark).rstrip('/')}/response-{uuid.uuid4().hex}"
    ordered = ops.response_order(lookup_results(spark, sf_dir, lookup_bound(spark, sf_dir)))
    runlogs.write_json(ordered.select("run_id", "request_seq", "entry_pos", "property", "candidate_id", "status", "reason"), path, compression="gzip")
    lines = runlogs.read_log_lines(spark, path).select("file", "line", "value", F.get_json_object("value", "$.run_id").cast("long").alias("run_id"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run_id")).join(
        table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_copy")), "l_orderkey"
    )
    numbered = running_by_size(
        lines, ["run_id"], ["file", "line"], {"place": ("sum", F.lit(1))}, chunk=F.col("file"), rows_bound=lookup_bound(spark, sf_dir), sized=asked,
    )
    return numbered.select("run_id", "place", F.col("value").alias("line"))


@query(
    "run_id_forms",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, date_trunc('second', ts) AS parsed,
  CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || md5(event_id::VARCHAR)[1:8] END AS run_id FROM events""",
)
def run_id_forms(spark, sf_dir):
    """Stamps as text and back, and run ids; one token in five is too short."""
    ts, token = F.col("ts").cast("timestamp"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8)
    short = F.when(F.pmod("event_id", F.lit(5)) == 0, F.substring(token, 1, 7)).otherwise(token)
    stamp = format_timestamp(ts)
    parsed = parse_timestamp(stamp).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), parsed.alias("parsed"), make_run_id(ts, short).alias("run_id"))
