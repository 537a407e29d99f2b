"""Integrity checks on run logs.  Every check returns ``run_id, seq, rule, detail``; clean is empty.

Order-dependent rules use running aggregates that are chunked by sequence
number, so one very long run is checked by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.columns import BEAM_NAME_PATTERN, CANDIDATE_ID_PATTERN, TIMESTAMP_PATTERN, case, is_finite, matches
from assayframe.functions.strictjson import is_canonical_line, strict_json
from assayframe.operators.scale import fits_one_task, position_chunk, running

# Event kinds and the payload members each kind may and must hold.
RUN_OPENED, RUN_CLOSED = "run_opened", "run_closed"
ITERATION_OPENED, ITERATION_CLOSED = "iteration_opened", "iteration_closed"
SELECTION, NO_MATCH, EVALUATION = "selection", "no_match", "evaluation"
PAYLOAD_MEMBERS = {
    RUN_OPENED: ("populations", "primary"),
    ITERATION_OPENED: (),
    SELECTION: ("beam", "candidates"),
    EVALUATION: ("beam", "candidate_id", "cost", "results"),
    NO_MATCH: ("beam",),
    ITERATION_CLOSED: (),
    RUN_CLOSED: ("reason",),
}
BUDGET_MEMBERS = ("limit", "reason", "remaining", "requested")
ENVELOPE = ("event", "iteration", "payload", "run_id", "seq", "ts")
HEADER = ("problem", "provenance", "run_id", "schema_version")
RUN_LEVEL = (RUN_OPENED, RUN_CLOSED)


def violations(df: DataFrame, rules: Mapping[str, Column], detail: Column | None = None) -> DataFrame:
    """One row per broken rule of every row; a rule that evaluates to NULL is not broken."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select("run_id", "seq", F.explode(broken).alias("rule"), shown.alias("detail"))


def _chunk(rows_bound: int | None, seq: str = "seq") -> Column | None:
    return None if fits_one_task(rows_bound) else position_chunk(seq)


def contiguity_violations(events: DataFrame, *, first: int = 1, rows_bound: int | None = None) -> DataFrame:
    """``seq`` must equal the position of the event in its run, counted from ``first``."""
    placed = running(
        events.select("run_id", "seq"), ["run_id"], ["seq"], {"n": ("sum", F.lit(1)), "before": ("max", F.col("seq"))},
        chunk=_chunk(rows_bound), inclusive=False,
    )
    expected = F.coalesce(F.col("n"), F.lit(0)) + F.lit(first)
    wrong = placed.withColumn("expected", expected).where(F.col("seq") != F.col("expected"))
    return violations(wrong, {"seq is not its position": F.lit(True)}, F.concat(F.lit("expected "), F.col("expected")))


def event_key(events: DataFrame) -> Column:
    """What identifies an event; selections and no-matches of a beam share one key space."""
    beam, candidate = F.col("beam"), F.col("candidate_id")
    kind = F.col("event")
    space = F.when(kind.isin(SELECTION, NO_MATCH), F.lit("beam")).otherwise(kind)
    return F.concat_ws(
        "/", space, F.col("iteration").cast("string"),
        F.when(kind.isin(SELECTION, NO_MATCH, EVALUATION), beam), F.when(kind == EVALUATION, candidate),
    )


def duplicate_keys(events: DataFrame) -> DataFrame:
    """Event keys that occur more than once in a run, with the first repetition's count.

    ``events`` carries ``beam`` and ``candidate_id`` beside the envelope.
    """
    keyed = events.select("run_id", "seq", event_key(events).alias("event_key"))
    counted = keyed.groupBy("run_id", "event_key").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    return violations(
        counted.where(F.col("n") > 1), {"duplicate event": F.lit(True)}, F.concat_ws(" x", "event_key", F.col("n").cast("string"))
    )


def lifecycle_violations(events: DataFrame, *, rows_bound: int | None = None) -> DataFrame:
    """Openings and closings alternate, numbers follow on, and events stay in their open iteration."""
    kind = F.col("event")
    narrow = events.select("run_id", "seq", "iteration", "event")
    marker = F.struct("seq", "iteration", "event")
    states = running(
        narrow, ["run_id"], ["seq"],
        {
            "previous": ("max", marker),
            "last_mark": ("max", F.when(kind.isin(ITERATION_OPENED, ITERATION_CLOSED), marker)),
            "last_close": ("max", F.when(kind == ITERATION_CLOSED, marker)),
        },
        chunk=_chunk(rows_bound), inclusive=False,
    )
    open_iteration = F.when(F.col("last_mark.event") == ITERATION_OPENED, F.col("last_mark.iteration"))
    closed = F.coalesce(F.col("last_close.iteration"), F.lit(0))
    inside = ~kind.isin(*RUN_LEVEL, ITERATION_OPENED)
    return violations(
        states,
        {
            "first event is not run_opened": F.col("previous").isNull() & (kind != RUN_OPENED),
            "event follows run_closed": F.col("previous.event") == RUN_CLOSED,
            "iteration opens out of order": (kind == ITERATION_OPENED)
            & (open_iteration.isNotNull() | (F.col("iteration") != closed + 1)),
            "event outside its iteration": inside & ~F.coalesce(F.col("iteration") == open_iteration, F.lit(False)),
        },
        F.concat_ws("/", kind, F.col("iteration").cast("string")),
    )


def history_before(events: DataFrame, iteration: int) -> DataFrame:
    """Events recorded before the first opening of ``iteration``; all of a run that never opened it."""
    opening = (
        events.where((F.col("event") == ITERATION_OPENED) & (F.col("iteration") == iteration))
        .groupBy("run_id").agg(F.min("seq").alias("_opened"))
    )
    joined = events.join(opening, "run_id", "left")
    return joined.where(F.col("_opened").isNull() | (F.col("seq") < F.col("_opened"))).drop("_opened")


def reference_violations(
    named: DataFrame, references: DataFrame, key: Sequence[str], rule: str = "names nothing selected before"
) -> DataFrame:
    """Rows of ``references`` whose key appears in no earlier row of ``named``.

    Only the earliest naming of a key matters, so the naming side shrinks to one
    row per key before the join and no pair of rows is ever enumerated.
    """
    earliest = named.groupBy(*key).agg(F.min("seq").alias("_named"))
    joined = references.join(earliest, list(key), "left")
    wrong = joined.where(F.col("_named").isNull() | (F.col("_named") >= F.col("seq")))
    return violations(wrong, {rule: F.lit(True)}, F.concat_ws("/", *[F.col(name).cast("string") for name in key]))


def evaluation_references(events: DataFrame) -> DataFrame:
    """An evaluation must name a candidate of an earlier selection of its beam."""
    beam = F.col("payload.beam").alias("beam")
    named = events.where(F.col("event") == SELECTION).select(
        "run_id", "seq", "iteration", beam, F.explode("payload.candidates").alias("candidate_id")
    )
    used = events.where(F.col("event") == EVALUATION).select(
        "run_id", "seq", "iteration", beam, F.col("payload.candidate_id").alias("candidate_id")
    )
    return reference_violations(named, used, ["run_id", "iteration", "beam", "candidate_id"])


def line_violations(lines: DataFrame) -> DataFrame:
    """Row-local line rules: valid UTF-8, strict JSON, canonical form.  Works on batch and stream."""
    text = F.col("value")
    utf8 = F.is_valid_utf8(text)
    strict = strict_json(text)
    rules = {
        "line is not UTF-8": ~utf8,
        "line is not strict JSON": utf8 & ~strict,
        "line is not in canonical form": utf8 & strict & ~is_canonical_line(F.when(utf8, text)),
    }
    return violations(lines.select(F.col("file").alias("run_id"), F.col("line").alias("seq"), "value"), rules)


def torn_tails(lines: DataFrame) -> DataFrame:
    """Files whose last line has no terminator: their bytes are one short of lines plus terminators."""
    sizes = lines.groupBy("file").agg(
        F.sum(F.octet_length("value") + 1).alias("terminated"), F.max("file_bytes").alias("found"), F.max("line").alias("seq")
    )
    torn = sizes.where(F.col("terminated") != F.col("found")).withColumnRenamed("file", "run_id")
    return violations(torn, {"last line is not terminated": F.lit(True)}, F.col("found"))


def header_violations(parsed: DataFrame) -> DataFrame:
    """Each file has exactly one header, on its first line, and its events carry the header's run id."""
    per_file = parsed.groupBy("file").agg(
        F.count_if("is_header").alias("n_headers"),
        F.min(F.when(F.col("is_header"), F.col("line"))).alias("seq"),
        F.max(F.when(F.col("is_header"), F.col("record.run_id"))).alias("header_id"),
        F.min("record.run_id").alias("lowest_id"), F.max("record.run_id").alias("highest_id"),
    )
    foreign = (F.col("lowest_id") != F.col("header_id")) | (F.col("highest_id") != F.col("header_id"))
    return violations(
        per_file.withColumnRenamed("file", "run_id"),
        {
            "no header": F.col("n_headers") == 0,
            "more than one header": F.col("n_headers") > 1,
            "header is not the first line": F.col("seq") != 1,
            "an event carries another run id": foreign,
        },
        F.col("n_headers"),
    )


def has_members(text: Column, expected: Column) -> Column:
    """The object's keys are exactly ``expected`` (sorted); a repeated or foreign key fails."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == expected, F.lit(False))


def _result_is_sound(result: Column) -> Column:
    ok = result["status"] == "ok"
    valued = result["value"].isNotNull() & result["unit"].isNotNull() & (result["n_replicates"] >= 1)
    bare = result["value"].isNull() & result["unit"].isNull() & result["n_replicates"].isNull() & result["spread"].isNull()
    reason = result["reason"]
    told = (
        F.when(ok, reason.isNull())
        .when(result["status"] == "missing", reason.isin("value_absent", "candidate_unknown"))
        .when(result["status"] == "error", F.length(reason) > 0)
        .otherwise(result["status"] == "unsupported")
    )
    free = F.when(ok & ~result["cached"], result["cost"]["evals"] >= 0).otherwise(result["cost"]["evals"] == 0)
    identified = matches(result["candidate_id"], CANDIDATE_ID_PATTERN) & (F.length(result["property"]) > 0)
    return F.coalesce(F.when(ok, valued).otherwise(bare) & told & free & identified, F.lit(False))


def shape_violations(parsed: DataFrame) -> DataFrame:
    """Closed envelope and payload per event kind, and the value rules inside the payloads."""
    kind, payload = F.col("record.event"), F.col("record.payload")
    allowed = F.create_map(*[part for k, members in PAYLOAD_MEMBERS.items() for part in (F.lit(k), F.array(*map(F.lit, sorted(members))).cast("array<string>"))])
    text = F.get_json_object("value", "$.payload")
    members_ok = has_members(text, F.try_element_at(allowed, kind)) | (
        (kind == RUN_CLOSED) & has_members(text, F.array(*map(F.lit, BUDGET_MEMBERS)))
    )
    event = ~F.col("is_header")
    run_level = kind.isin(*RUN_LEVEL)
    listed = payload["candidates"]
    rules = {
        "header members": F.col("is_header") & ~has_members(F.col("value"), F.array(*map(F.lit, HEADER))),
        "envelope members": event & ~has_members(F.col("value"), F.array(*map(F.lit, ENVELOPE))),
        "unknown event kind": event & ~F.coalesce(kind.isin(*PAYLOAD_MEMBERS), F.lit(False)),
        "payload members": event & kind.isin(*PAYLOAD_MEMBERS) & ~members_ok,
        "timestamp form": event & ~matches("record.ts", TIMESTAMP_PATTERN),
        "seq below one": event & ~F.coalesce(F.col("record.seq") >= 1, F.lit(False)),
        "iteration of a run event must be 0": event & run_level & (F.col("record.iteration") != 0),
        "iteration below one": event & ~run_level & ~F.coalesce(F.col("record.iteration") >= 1, F.lit(False)),
        "candidates must be distinct ids": (kind == SELECTION)
        & ~F.coalesce(
            (F.size(listed) >= 1) & (F.size(F.array_distinct(listed)) == F.size(listed))
            & F.forall(listed, lambda c: matches(c, CANDIDATE_ID_PATTERN)),
            F.lit(False),
        ),
        "evaluation names no candidate id": (kind == EVALUATION) & ~matches(payload["candidate_id"], CANDIDATE_ID_PATTERN),
        "a result breaks the status rules": (kind == EVALUATION)
        & ~F.coalesce(F.forall(payload["results"], _result_is_sound), F.lit(False)),
    }
    return violations(parsed.select(F.col("file").alias("run_id"), F.col("line").alias("seq"), "value", "record", "is_header"), rules, kind)


def population_violations(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Populations of a run: unique names, a known primary, parallel arrays, the problem's constraints."""
    expected = headers.select(
        "run_id", F.array_sort(F.transform("problem.constraints", lambda c: c["property"])).alias("expected")
    )
    opened = events.where(F.col("event") == RUN_OPENED).join(expected, "run_id", "left")
    populations = F.col("payload.populations")
    names = F.transform(populations, lambda p: p["name"])

    def ragged(p: Column) -> Column:
        return F.exists(F.map_values(p["constraints"]), lambda a: F.size(a) != F.size(p["objective"]))

    return violations(
        opened,
        {
            "the run has no population": F.coalesce(F.size(populations), F.lit(0)) < 1,
            "primary is not a population": ~F.array_contains(names, F.col("payload.primary")),
            "population names repeat": F.size(F.array_distinct(names)) != F.size(names),
            "constraint arrays are not the problem's": F.exists(
                populations, lambda p: F.array_sort(F.map_keys(p["constraints"])) != F.col("expected")
            ),
            "arrays differ in length": F.exists(populations, ragged),
        },
        F.col("payload.primary"),
    )


def problem_violations(problems: DataFrame) -> DataFrame:
    """Rules of a problem: ``run_id`` beside the members of the problem struct."""
    constraints = F.col("constraints")
    properties = F.transform(constraints, lambda c: c["property"])
    budget = F.col("budget")
    return violations(
        problems.withColumn("seq", F.lit(0).cast("long")),
        {
            "form is not allowed": ~F.coalesce(F.col("form") == "constrained_single", F.lit(False)),
            "direction is not max or min": ~F.coalesce(F.col("objective.direction").isin("max", "min"), F.lit(False)),
            "more than eight constraints": F.size(constraints) > 8,
            "operator is not <= or >=": F.exists(constraints, lambda c: ~F.coalesce(c["op"].isin("<=", ">="), F.lit(False))),
            "threshold is not finite": F.exists(constraints, lambda c: ~is_finite(c["value"])),
            "constraint property repeats": F.size(F.array_distinct(properties)) != F.size(properties),
            "objective is also a constraint": F.array_contains(properties, F.col("objective.property")),
            "budget must be positive": F.least(budget["iterations"], budget["candidates_per_beam"], budget["beams"]) < 1,
        },
        F.col("objective.property"),
    )


def evals_limit() -> Column:
    """The evaluation budget of a run: iterations x candidates per beam x beams."""
    return F.col("budget.iterations") * F.col("budget.candidates_per_beam") * F.col("budget.beams")


def plan_violations(plans: DataFrame) -> DataFrame:
    """Plan rules: ``run_id, n_iterations`` (of the budget) and ``iterations``."""
    numbers = F.transform("iterations", lambda i: i["iteration"])
    expected = F.sequence(F.lit(1).cast("long"), F.col("n_iterations"))

    def repeats(i: Column) -> Column:
        names = F.transform(i["beams"], lambda b: b["beam"])
        return F.size(F.array_distinct(names)) != F.size(names)

    def any_beam(test) -> Column:
        return F.exists("iterations", lambda i: F.exists(i["beams"], test))

    return violations(
        plans.withColumn("seq", F.lit(0).cast("long")),
        {
            "iterations are not 1..N in order": numbers != expected,
            "a beam repeats in an iteration": F.exists("iterations", repeats),
            "a beam name is malformed": any_beam(lambda b: ~matches(b["beam"], BEAM_NAME_PATTERN)),
            "a candidate id is malformed": any_beam(
                lambda b: F.exists(b["candidates"], lambda c: ~matches(c, CANDIDATE_ID_PATTERN))
            ),
            "a beam lists more than 1000 candidates": any_beam(lambda b: F.size(b["candidates"]) > 1000),
            "a candidate repeats in a beam": any_beam(
                lambda b: F.size(F.array_distinct(b["candidates"])) != F.size(b["candidates"])
            ),
        },
    )


def plan_row_violations(rows: DataFrame) -> DataFrame:
    """The plan rules for plans kept as rows ``run_id, iteration, beam, candidate_id``."""
    numbers = rows.groupBy("run_id").agg(
        F.min("iteration").alias("lowest"), F.max("iteration").alias("highest"), F.count_distinct("iteration").alias("n")
    )
    gaps = numbers.where((F.col("lowest") != 1) | (F.col("n") != F.col("highest"))).select(
        "run_id", F.lit("iterations are not 1..N").alias("rule"),
        F.concat_ws(" of ", F.col("n").cast("string"), F.col("highest").cast("string")).alias("detail"),
    )
    names = rows.select("run_id", "beam").distinct().where(~matches("beam", BEAM_NAME_PATTERN)).select(
        "run_id", F.lit("a beam name is malformed").alias("rule"), F.col("beam").alias("detail")
    )
    repeats = rows.groupBy("run_id", "iteration", "beam", "candidate_id").count().where(F.col("count") > 1).select(
        "run_id", F.lit("a candidate repeats in a beam").alias("rule"), F.col("beam").alias("detail")
    )
    return gaps.unionByName(names).unionByName(repeats)


def expected_sequence(plan: DataFrame) -> DataFrame:
    """The events a plan records, one row per event: ``run_id, iteration, pos, event, beam, candidate_id, listed``.

    ``plan`` has one row per planned candidate (``beam_pos, cand_pos``), and one
    row with a NULL candidate for an empty beam.
    """
    key = ["run_id", "iteration"]
    beams = plan.dropna(subset=[*key, "beam_pos"]).groupBy(*key, "beam_pos", "beam").agg(
        # A plan lists at most a thousand candidates in a beam.
        F.array_sort(F.collect_list(F.when(F.col("candidate_id").isNotNull(), F.struct("cand_pos", "candidate_id")))).alias("_chosen")
    )
    return listed_sequence(beams.withColumn("listed", F.transform("_chosen", lambda c: c["candidate_id"])))


def listed_sequence(beams: DataFrame, *also: str) -> DataFrame:
    """``expected_sequence`` of planned beams (``run_id, iteration, beam_pos, beam, listed``), which list their candidates in order.

    ``also`` names columns that tell several plans of an iteration apart.
    Positions are arithmetic: a beam takes one row plus one per candidate, so
    only the handful of beams of an iteration is ever ordered together.  Every
    event unfolds from its beam, the first beam of an iteration opens it and the
    last one closes it, so nothing moves where an iteration's beams are together.
    """
    key = ["run_id", "iteration", *also]
    in_order = Window.partitionBy(*key).orderBy("beam_pos")
    n, before = F.size("listed"), in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = beams.select(
        *key, "beam", "listed", n.alias("_n"), (F.coalesce(F.sum(n + 1).over(before), F.lit(0)) + 1).alias("_start"),
        F.lead(F.lit(True)).over(in_order).isNull().alias("_closes"),
    )
    none = F.array(F.lit(None)).cast(beams.schema["listed"].dataType)
    opens, nothing = F.col("_start") == 1, F.slice(none, 1, 0)
    events = F.concat(F.when(opens, none).otherwise(nothing), none, F.col("listed"), F.when(F.col("_closes"), none).otherwise(nothing))
    rows = placed.select("*", F.posexplode(events).alias("_at", "candidate_id"))
    place = F.col("_at") - opens.cast("int")  # -1 opens, 0 selects, what follows the candidates closes
    event = F.when(place < 0, ITERATION_OPENED).when(place > F.col("_n"), ITERATION_CLOSED).when(place > 0, EVALUATION)
    return rows.select(
        *key, (F.col("_start") + place).alias("pos"), event.when(F.col("_n") > 0, SELECTION).otherwise(NO_MATCH).alias("event"),
        F.when((place >= 0) & (place <= F.col("_n")), F.col("beam")).alias("beam"), "candidate_id",
        F.when((place == 0) & (F.col("_n") > 0), F.col("listed")).alias("listed"),
    )


def recorded_sequence(events: DataFrame) -> DataFrame:
    """The recorded events of every iteration in the shape of ``expected_sequence``."""
    key = ["run_id", "iteration"]
    opened = events.where(F.col("event") == ITERATION_OPENED).groupBy(*key).agg(F.min("seq").alias("_from"))
    inside = events.where(~F.col("event").isin(*RUN_LEVEL)).join(opened, key)
    listed = F.when(F.col("event") == SELECTION, F.col("payload.candidates"))
    return inside.select(
        *key, (F.col("seq") - F.col("_from")).alias("pos"), "event", F.col("payload.beam").alias("beam"),
        F.when(F.col("event") == EVALUATION, F.col("payload.candidate_id")).alias("candidate_id"), listed.alias("listed"),
    )


def replay_differences(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """First position of each recorded iteration that its plan does not give.

    A recorded iteration may stop early (it is a prefix of the plan), so planned
    events beyond it are no difference.
    """
    names = ["run_id", "iteration", "pos", "event", "beam", "candidate_id", "listed"]
    sides = [side.select(*names, F.lit(mark).alias("recorded")) for side, mark in ((recorded, True), (expected, False))]
    return side_differences(sides[0].unionByName(sides[1]))


def side_differences(events: DataFrame) -> DataFrame:
    """``replay_differences`` of one table of recorded events and planned ones (not ``recorded``): nothing moves where both lie together."""
    key = ["run_id", "iteration"]
    content = F.struct("event", "beam", "candidate_id", "listed")
    planned = F.max(F.when(~F.col("recorded"), content)).over(Window.partitionBy(*key, "pos"))  # at most one
    differing = events.select(*key, "pos", "event", "recorded", content.alias("_ours"), planned.alias("_planned")).where(
        F.col("recorded") & ~F.col("_ours").eqNullSafe(F.col("_planned"))
    )
    d = F.struct("pos", F.col("event").alias("recorded"), F.coalesce("_planned.event", F.lit("(end of plan)")).alias("planned"))
    return differing.groupBy(*key).agg(F.min(d).alias("d")).select(*key, "d.pos", "d.recorded", "d.planned")


def provenance_differences(headers: DataFrame, running_facts: Mapping[str, str]) -> DataFrame:
    """First provenance fact, in the given order, that differs from the running one."""
    first = case((~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)) for name, value in running_facts.items())
    return headers.select("run_id", first.alias("field")).where(F.col("field").isNotNull())
