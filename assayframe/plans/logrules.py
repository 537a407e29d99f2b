"""Registered queries: the rules of log lines, headers, payloads, plans and requests, over texts and structs built from the given tables.

Every rule is broken by some rows.  The SQL states which rows those are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayframe.operators import logchecks, lookups
from assayframe.plans.registering import Shelf
from assayframe.plans.runs import opening_log
from assayframe.plans.tables import table
from assayframe.sources import runlogs

SHELF = Shelf()
query = SHELF.query


def _is(column: str, every: int, at: int) -> Column:
    return F.pmod(F.col(column), F.lit(every)) == at


def _broken(*rules: tuple[str, str], source: str, run: str, seq: str) -> str:
    """One row per broken rule: ``(rule, condition)`` pairs over a source."""
    return "\nUNION ALL ".join(f"SELECT {run} AS run_id, {seq}::BIGINT AS seq, '{rule}' AS rule FROM {source} WHERE {test}" for rule, test in rules)


@query(
    "log_line_checks",
    _broken(
        ("line is not in canonical form", "event_id % 5 = 1"), ("line is not strict JSON", "event_id % 5 IN (2, 3)"),
        source="events", run="user_id::VARCHAR", seq="event_id",
    ),
)
def log_line_checks(spark, sf_dir):
    """Lines that are canonical, spaced, followed by more text, or no JSON at all."""
    number = F.col("event_id").cast("string")
    value = (
        F.when(_is("event_id", 5, 1), F.concat(F.lit('{"n": '), number, F.lit("}")))
        .when(_is("event_id", 5, 2), F.concat(F.lit('{"n":'), number, F.lit("} {}")))
        .when(_is("event_id", 5, 3), F.concat(F.lit("n="), number))
        .otherwise(F.concat(F.lit('{"n":'), number, F.lit("}")))
    )
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), value.alias("value"))
    return logchecks.line_violations(lines).select("run_id", "seq", "rule")


@query(
    "log_torn_tails",
    "SELECT user_id::VARCHAR AS run_id, max(event_id) AS seq, 'last line is not terminated' AS rule FROM events WHERE user_id % 3 = 0 GROUP BY user_id",
)
def log_torn_tails(spark, sf_dir):
    """Every third file is one byte short of its lines and their ends."""
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), F.col("props").cast("string").alias("value"), "user_id"
    )
    sizes = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"))
    short = F.when(_is("user_id", 3, 0), 1).otherwise(0)
    whole = lines.join(sizes, "file").select("file", "line", "value", (F.col("_bytes") - short).alias("file_bytes"))
    return logchecks.torn_tails(whole).select("run_id", "seq", "rule")


@query(
    "log_header_checks",
    """WITH l AS (SELECT user_id, 1 + event_id % 4 AS line, event_type = 'signup' AS head, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE user_id::VARCHAR END AS id FROM events),
f AS (SELECT user_id, count(*) FILTER (WHERE head) AS n, min(line) FILTER (WHERE head) AS seq, max(id) FILTER (WHERE head) AS own, min(id) AS low, max(id) AS high FROM l GROUP BY 1)
SELECT user_id::VARCHAR AS run_id, seq, 'no header' AS rule FROM f WHERE n = 0 UNION ALL SELECT user_id::VARCHAR, seq, 'more than one header' FROM f WHERE n > 1
UNION ALL SELECT user_id::VARCHAR, seq, 'header is not the first line' FROM f WHERE seq <> 1 UNION ALL SELECT user_id::VARCHAR, seq, 'an event carries another run id' FROM f WHERE low <> own OR high <> own""",
)
def log_header_checks(spark, sf_dir):
    """Signups stand for headers; some events carry another run's id."""
    own = F.when(_is("event_id", 50, 0), "other").otherwise(F.col("user_id").cast("string"))
    parsed = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("file"), (F.pmod("event_id", F.lit(4)) + 1).alias("line"),
        (F.col("event_type") == "signup").alias("is_header"), F.struct(own.alias("run_id")).alias("record"),
    )
    return logchecks.header_violations(parsed).select("run_id", "seq", "rule")


@query(
    "log_shape_checks",
    _broken(
        ("envelope members", "o_orderkey % 7 = 1"), ("unknown event kind", "o_orderkey % 11 = 2"),
        ("payload members", "o_orderkey % 11 <> 2 AND o_orderkey % 5 = 3"), ("timestamp form", "o_orderkey % 13 = 4"), ("seq below one", "o_orderkey % 17 = 5"),
        ("iteration below one", "o_orderkey % 19 = 6"),
        ("candidates must be distinct ids", "o_orderkey % 11 <> 2 AND o_orderkey % 23 = 7"),
        source="orders", run="o_custkey::VARCHAR", seq="o_orderkey",
    ),
)
def log_shape_checks(spark, sf_dir):
    """Selection events as JSON text with foreign members, wrong kinds, stamps, numbers and candidate lists."""
    known = lambda every, at: _is("o_orderkey", every, at)
    ids = F.array(F.lit("0123456789abcdef"), F.when(known(23, 7), "0123456789abcdef").otherwise("fedcba9876543210"))
    plain = F.to_json(F.struct(F.col("o_orderpriority").alias("beam"), ids.alias("candidates")))
    foreign = F.to_json(F.struct(F.col("o_orderpriority").alias("beam"), ids.alias("candidates"), F.lit(1).alias("note")))
    payload = F.when(known(5, 3), foreign).otherwise(plain)
    value = F.concat(
        F.lit('{"event":"'), F.when(known(11, 2), "dreamed").otherwise("selection"), F.lit('","iteration":'), F.when(known(19, 6), "0").otherwise("1"),
        F.lit(',"payload":'), payload, F.lit(',"run_id":"'), F.col("o_custkey").cast("string"), F.lit('","seq":'), F.when(known(17, 5), "0").otherwise("3"),
        F.lit(',"ts":"'), F.when(known(13, 4), "2026-01-01 00:00:00").otherwise("2026-01-01T00:00:00Z"), F.lit('"'),
        F.when(known(7, 1), ',"extra":null').otherwise(""), F.lit("}"),
    )
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("line"), value.alias("value"))
    return logchecks.shape_violations(runlogs.parse_log(lines)).select("run_id", "seq", "rule")


@query(
    "log_population_checks",
    _broken(
        ("the run has no population", "n % 7 = 0"), ("primary is not a population", "n % 7 = 0 OR n % 3 = 1"), ("population names repeat", "n % 7 <> 0 AND n % 4 = 2"),
        ("constraint arrays are not the problem''s", "n % 7 <> 0 AND n % 5 = 3"), ("arrays differ in length", "n % 7 <> 0 AND n % 6 = 4"),
        source="(SELECT DISTINCT p_brand, split_part(p_brand, '#', 2)::INTEGER AS n FROM part)", run="p_brand", seq="1",
    ),
)
def log_population_checks(spark, sf_dir):
    """Opening events whose populations are missing, misnamed, of other constraints or ragged."""
    headers, events = opening_log(spark, sf_dir)
    headers = headers.withColumn("problem", F.struct(F.col("problem.constraints").alias("constraints")))
    events = events.withColumn("n", F.split_part("run_id", F.lit("#"), F.lit(2)).cast("int"))

    def spoiled(p: Column, i: Column) -> Column:
        name = F.when(_is("n", 4, 2), "brand").otherwise(p["name"])
        key = F.when(_is("n", 5, 3) & (i == 0), "weight").otherwise("size")
        array = p["constraints"]["size"]
        longer = F.when(_is("n", 6, 4) & (i == 0), F.concat(array, F.array(F.lit(1.0)))).otherwise(array)
        return F.struct(name.alias("name"), p["objective"].alias("objective"), F.create_map(key, longer).alias("constraints"))

    listed = F.transform("payload.populations", spoiled)
    payload = F.struct(
        F.when(_is("n", 3, 1), "elsewhere").otherwise("brand").alias("primary"), F.when(_is("n", 7, 0), F.slice(listed, 1, 0)).otherwise(listed).alias("populations")
    )
    return logchecks.population_violations(events.withColumn("payload", payload), headers).select("run_id", "seq", "rule")


@query(
    "plan_document_checks",
    _broken(
        ("iterations are not 1..N in order", "c_custkey % 3 = 0"), ("a beam repeats in an iteration", "c_custkey % 13 = 4"), ("a beam name is malformed", "c_custkey % 5 = 1"),
        ("a candidate id is malformed", "c_custkey % 7 = 2"), ("a beam lists more than 1000 candidates", "c_custkey % 17 = 6"), ("a candidate repeats in a beam", "c_custkey % 11 = 3"),
        source="customer", run="c_custkey", seq="0",
    ),
)
def plan_document_checks(spark, sf_dir):
    """Nested plans, one per customer."""
    known = lambda every, at: _is("c_custkey", every, at)
    name = F.when(known(5, 1), "B!").otherwise("first")
    hexed = lambda number: F.lower(F.lpad(F.hex(number), 16, "0"))
    many = F.transform(F.sequence(F.lit(1), F.when(known(17, 6), 1001).otherwise(2)), lambda i: hexed(i.cast("long")))
    ids = F.concat(many, F.when(known(7, 2), F.array(F.lit("xyz"))).otherwise(F.array().cast("array<string>")), F.when(known(11, 3), F.slice(many, 1, 1)).otherwise(F.array().cast("array<string>")))
    beam = lambda called, listed: F.struct(called.alias("beam"), listed.alias("candidates"))
    beams = F.array(beam(name, ids), beam(F.when(known(13, 4), name).otherwise("second"), F.slice(many, 1, 1)))
    step = lambda number: F.struct(number.cast("long").alias("iteration"), beams.alias("beams"))
    plans = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit(2).cast("long").alias("n_iterations"),
        F.array(step(F.lit(1)), step(F.when(known(3, 0), 3).otherwise(2))).alias("iterations"),
    )
    return logchecks.plan_violations(plans).select("run_id", "seq", "rule")


@query(
    "request_document_checks",
    """SELECT CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_custkey::VARCHAR END AS run_id, c_custkey AS request_seq, rule FROM (
  SELECT c_custkey, 'run id is empty' AS rule FROM customer WHERE c_custkey % 19 = 0
  UNION ALL SELECT c_custkey, 'batch must hold 1 to 1000 entries' FROM customer WHERE c_custkey % 17 = 1 OR c_custkey % 23 = 2
  UNION ALL SELECT c_custkey, 'candidate id is malformed' FROM customer WHERE c_custkey % 17 <> 1 AND c_custkey % 7 = 3
  UNION ALL SELECT c_custkey, 'an entry names no property' FROM customer WHERE c_custkey % 17 <> 1 AND c_custkey % 11 = 4
  UNION ALL SELECT c_custkey, 'a property repeats in an entry' FROM customer WHERE c_custkey % 17 <> 1 AND c_custkey % 11 <> 4 AND c_custkey % 5 = 2
  UNION ALL SELECT c_custkey, 'a property name is empty' FROM customer WHERE c_custkey % 17 <> 1 AND c_custkey % 11 <> 4 AND c_custkey % 13 = 6)""",
)
def request_document_checks(spark, sf_dir):
    """Nested requests, one per customer."""
    known = lambda every, at: _is("c_custkey", every, at)
    properties = F.concat(
        F.array(F.lit("retail"), F.when(known(5, 2), "retail").otherwise("size")), F.when(known(13, 6), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    )
    properties = F.when(known(11, 4), F.array().cast("array<string>")).otherwise(properties)
    entry = F.struct(F.when(known(7, 3), "XYZ").otherwise("0123456789abcdef").alias("candidate_id"), properties.alias("properties"))
    size = F.when(known(17, 1), 0).when(known(23, 2), 1001).otherwise(1)
    requests = table(spark, sf_dir, "customer").select(
        F.when(known(19, 0), "").otherwise(F.col("c_custkey").cast("string")).alias("run_id"), F.col("c_custkey").alias("request_seq"),
        F.array_repeat(entry, size).alias("batch"),
    )
    return lookups.request_violations(requests)


@query(
    "recorded_events",
    """WITH lines AS (SELECT DISTINCT o_custkey AS run_id, l_partkey AS candidate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY candidate) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM lines)
SELECT DISTINCT run_id, 1::BIGINT AS iteration, 0::BIGINT AS pos, 'iteration_opened' AS event, NULL::VARCHAR AS beam, NULL::VARCHAR AS candidate_id, 0::BIGINT AS n_listed FROM n
UNION ALL SELECT DISTINCT run_id, 1, 1, 'selection', 'all', NULL, n FROM n UNION ALL SELECT run_id, 1, 1 + k, 'evaluation', 'all', candidate::VARCHAR, 0 FROM n""",
)
def recorded_events(spark, sf_dir):
    """The recorded sequence of runs that evaluate the parts of a customer's lines in key order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    runs = lines.select(F.col("o_custkey").alias("run_id"), "l_partkey").distinct().groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list("l_partkey")), lambda k: k.cast("string")).alias("ids")
    )
    event = lambda kind, beam, listed, candidate: F.struct(
        F.lit(kind).alias("event"), F.struct(beam.alias("beam"), listed.alias("candidates"), candidate.alias("candidate_id")).alias("payload")
    )
    nothing, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    steps = F.concat(
        F.array(event("iteration_opened", nothing, no_list, nothing), event("selection", F.lit("all"), F.col("ids"), nothing)),
        F.transform("ids", lambda c: event("evaluation", F.lit("all"), no_list, c)),
    )
    events = runs.select("run_id", F.posexplode(steps).alias("at", "e")).select(
        "run_id", (F.col("at") + 5).cast("long").alias("seq"), F.lit(1).cast("long").alias("iteration"), "e.event", "e.payload"
    )
    found = logchecks.recorded_sequence(events)
    return found.select("run_id", "iteration", "pos", "event", "beam", "candidate_id", F.coalesce(F.size("listed"), F.lit(0)).cast("long").alias("n_listed"))
