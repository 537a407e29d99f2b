"""Run metrics: beams against reference populations, top-k hits, trends, usage and status.

The inputs are plain tables, so the same operators reduce a parsed run log or
any other record of selections:

* ``picks``    ``run_id, iteration, beam, candidate_id, objective, feasible``
* ``members``  population key columns plus ``objective, feasible``
* ``reported`` ``run_id, iteration, beam, seq``, one row per selection or no-match

``sign`` is 1 where a large objective is good and -1 where a small one is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.columns import ceil_div, exact_sum
from assayframe.operators.filters import holds
from assayframe.operators.logchecks import EVALUATION, ITERATION_CLOSED, NO_MATCH, RUN_CLOSED, RUN_OPENED, SELECTION
from assayframe.operators.scale import Split, chunk_of, cut_points, fits_one_map, fits_one_task, group_quantiles, running, split_by_group_size
from assayframe.sources.storage import write_shared

BEAM = ["run_id", "iteration", "beam"]
# The shares of the feasible members that count as top hits.
TOP_DIVISORS = {"top10": 10, "top1": 100}


def _value_chunk(df: DataFrame, column: str, rows_bound: int | None) -> Column | None:
    """Chunk of a value column for ``running``; none while the input is proven small."""
    if fits_one_task(rows_bound):
        return None
    return chunk_of(F.col(column), cut_points(df, [column])[column])


def population_order(
    members: DataFrame, keys: Sequence[str], constraints: Sequence[str], *, rows_bound: int | None = None
) -> DataFrame:
    """Add ``pos``: objective, then each constraint, ascending, NULLs last at every position.

    Equal records are interchangeable, so they collapse to one row with a count
    before they are ordered; ``pos`` is the first position the record takes.
    """
    record = ["objective", *constraints]
    counted = members.groupBy(*keys, *record).agg(F.count("*").alias("n"))
    order = [F.col(name).asc_nulls_last() for name in record]
    chunk = _value_chunk(counted, "objective", rows_bound)
    if chunk is not None:
        chunk = F.coalesce(F.when(F.col("objective").isNotNull(), chunk), F.lit(1 << 30))
    placed = running(counted, keys, order, {"_before": ("sum", F.col("n"))}, chunk=chunk, inclusive=False)
    return placed.withColumn("pos", F.coalesce("_before", F.lit(0))).drop("_before")


def thresholds(
    members: DataFrame, keys: Sequence[str], sign: Column, *, rows_bound: int | None = None
) -> DataFrame:
    """Per population: its size, its feasible size and the k-th best feasible values.

    k is a tenth and a hundredth of the feasible members, rounded up.
    """
    counts = members.groupBy(*keys).agg(
        F.count("objective").alias("n_population"),
        F.count_if(F.col("feasible") & F.col("objective").isNotNull()).alias("n_feasible"),
    )
    worth = members.where(F.col("feasible") & F.col("objective").isNotNull()).select(*keys, (-sign * F.col("objective")).alias("_v"))
    entries = worth.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranked = running(
        entries, keys, ["_v"], {"_upto": ("sum", F.col("_n"))}, chunk=_value_chunk(entries, "_v", rows_bound), totals=["_upto"]
    )
    best = ranked.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("_upto") >= ceil_div("_upto_all", divisor), F.col("_v"))).alias(f"worst_{name}")
            for name, divisor in TOP_DIVISORS.items()
        ]
    )
    joined = counts.join(best, list(keys), "left")
    return joined.select(
        *keys, "n_population", "n_feasible", *[(-sign * F.col(f"worst_{name}")).alias(name) for name in TOP_DIVISORS]
    )


def _large_beams(picks: DataFrame, rows_bound: int | None) -> Split:
    return Split(picks, None) if fits_one_map(rows_bound) else split_by_group_size(picks, BEAM)


def beam_metrics(picks: DataFrame, *, rows_bound: int | None = None) -> DataFrame:
    """Per beam: selected, answered, median objective and feasible share."""
    return _beam_table(picks, _large_beams(picks, rows_bound))


def _beam_table(picks: DataFrame, split: Split, *also: Column) -> DataFrame:
    """``beam_metrics`` with further aggregates; without large beams it is one grouping."""
    stats = [
        F.count("*").alias("n_selected"),
        F.count("objective").alias("n_ok"),
        F.count_if(F.coalesce("feasible", F.lit(False))).alias("n_feasible"),
        *also,
    ]
    if split.hot is None:
        # Picks are smaller than what a task would make of the few of a beam that it holds.
        table = picks.select(*BEAM, "objective", "feasible").repartition(*BEAM).groupBy(*BEAM).agg(*stats, F.median("objective").alias("median_objective"))
    else:
        medians = group_quantiles(picks, BEAM, {"median_objective": ("objective", 0.5)}, split=split)
        table = picks.groupBy(*BEAM).agg(*stats).join(medians, BEAM, "left")
    return table.withColumn("feasible_frac", F.col("n_feasible") / F.col("n_selected")).drop("n_feasible")


def percent_worse(
    medians: DataFrame, members: DataFrame, keys: Sequence[str], sign: Column, *, rows_bound: int | None = None
) -> DataFrame:
    """Add ``pct_of_population``: the share of the population strictly worse than the median.

    ``medians`` carries ``keys`` and ``median_objective``.  A running count over
    the union of both sides places every median among the members; no median is
    ever paired with members.
    """
    placed = medians.withColumn("_v", sign * F.col("median_objective"))
    theirs = members.where(F.col("objective").isNotNull()).groupBy(*keys, (sign * F.col("objective")).alias("_v")).agg(
        F.count("*").alias("_m")
    )
    count = {"_worse": ("sum", F.col("_m"))}
    if fits_one_task(rows_bound):
        # Medians sort before members of the same value, so the count up to them is strictly worse.
        both = placed.withColumn("_m", F.lit(0).cast("long")).unionByName(theirs, allowMissingColumns=True)
        counted = running(both, keys, ["_v", "_m"], count, chunk=None, totals=["_worse"]).where(F.col("_m") == 0)
        share = F.lit(100) * F.col("_worse") / F.col("_worse_all")
        known = F.col("_v").isNotNull() & (F.col("_worse_all") > 0)
        return counted.select(*medians.columns, F.when(known, share).alias("pct_of_population"))
    # Any number of beams may share a median: both sides shrink to distinct values first.
    placed = write_shared(placed, "placed-medians")
    ours = placed.where(F.col("_v").isNotNull()).select(*keys, "_v").distinct().withColumn("_m", F.lit(0).cast("long"))
    values = write_shared(theirs.unionByName(ours).groupBy(*keys, "_v").agg(F.sum("_m").alias("_m")), "placed-values")
    counted = running(values, keys, ["_v"], count, chunk=_value_chunk(values, "_v", None), totals=["_worse"])
    share = F.lit(100) * (F.col("_worse") - F.col("_m")) / F.col("_worse_all")
    shares = counted.select(*keys, "_v", F.when(F.col("_worse_all") > 0, share).alias("pct_of_population"))
    return placed.join(shares, [*keys, "_v"], "left").drop("_v")


def hits(picks: DataFrame, references: DataFrame, keys: Sequence[str], sign: Column) -> DataFrame:
    """Per beam and population: feasible picks at least as good as each threshold.

    ``picks`` already carries the population key columns (one row per
    population it is reported against).  Populations shared by all runs are a
    short, given list, so their thresholds travel to the picks: a join by
    population would put all picks of one into one task.
    """
    good = picks.where(F.coalesce("feasible", F.lit(False)) & F.col("objective").isNotNull())
    marks = references.select(*keys, *TOP_DIVISORS)
    joined = good.join(marks if "run_id" in keys else F.broadcast(marks), list(keys))
    group = [*BEAM, *[key for key in keys if key not in BEAM]]
    return joined.groupBy(*group).agg(
        *[F.count_if(sign * F.col("objective") >= sign * F.col(name)).alias(f"hits_{name}") for name in TOP_DIVISORS]
    )


def reduce_run(
    reported: DataFrame, picks: DataFrame, members: DataFrame, sign: Column, *, keys: Sequence[str] = ("run_id", "population"),
    populations: DataFrame | None = None, rows_bound: int | None = None,
) -> DataFrame:
    """The long result table: one row per reported beam and population.

    ``members`` holds ``keys``.  Populations that belong to a run are matched on
    ``run_id``; populations shared by all runs come with ``keys=("population",)``
    and every beam is reported against each name in ``populations``.
    """
    keys = list(keys)
    references = thresholds(members, keys, sign, rows_bound=rows_bound)
    if "run_id" in keys:
        names = populations if populations is not None else references.select(*keys)
        beams = reported.join(beam_metrics(picks, rows_bound=rows_bound), BEAM, "left").join(names, "run_id")
        counted = hits(picks.join(names, "run_id"), references, keys, sign)
        spread = beams.join(counted, [*BEAM, "population"], "left")
    else:
        spread = _spread_over_shared(reported, picks, references, populations, sign, rows_bound)
    out = percent_worse(spread, members, keys, sign, rows_bound=rows_bound).join(references, keys, "left")
    counts = [
        F.when(F.col("n_feasible") > 0, F.coalesce(f"hits_{name}", F.lit(0))).alias(f"hits_{name}") for name in TOP_DIVISORS
    ]
    return out.select(
        *[name for name in ("run_id", "seq", "iteration", "beam", "population") if name in out.columns],
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"),
        "median_objective", "feasible_frac", F.coalesce("n_population", F.lit(0)).alias("n_population"),
        "pct_of_population", *counts,
    )


def _spread_over_shared(
    reported: DataFrame, picks: DataFrame, references: DataFrame, populations: DataFrame, sign: Column, rows_bound: int | None
) -> DataFrame:
    """Beams against populations shared by all runs.

    The shared populations with their thresholds are a short, given list; it
    travels as one row and unfolds beside every beam.  The good values of a beam
    that is not large are listed with its other figures and compared there; large
    beams unfold it beside every pick.
    """
    listed = populations.select("population").distinct().join(references, "population", "left").agg(
        F.array_sort(F.collect_list(F.struct("population", *TOP_DIVISORS))).alias("_listed")
    )
    split = _large_beams(picks, rows_bound)
    if split.hot is None:
        good = F.collect_list(F.when(F.coalesce("feasible", F.lit(False)), F.col("objective"))).alias("_good")
        beams = reported.join(_beam_table(picks, split, good), BEAM, "left").crossJoin(listed)  # one row

        def hits_of(population: Column, name: str) -> Column:
            good_enough = F.filter(F.coalesce("_good", F.array().cast("array<double>")), lambda value: sign * value >= sign * population[name])
            return F.size(good_enough).cast("long").alias(f"hits_{name}")

        unfolded = F.transform("_listed", lambda p: F.struct(p["population"].alias("population"), *[hits_of(p, name) for name in TOP_DIVISORS]))
        return beams.select(*[name for name in beams.columns if name not in ("_listed", "_good")], F.inline(unfolded))
    beams = reported.join(_beam_table(picks, split), BEAM, "left").crossJoin(listed)
    beams = beams.select(*[name for name in beams.columns if name != "_listed"], F.explode(F.col("_listed.population")).alias("population"))
    good = picks.where(F.coalesce("feasible", F.lit(False)) & F.col("objective").isNotNull()).crossJoin(listed)
    counted = good.select(*BEAM, "objective", F.inline("_listed")).groupBy(*BEAM, "population").agg(
        *[F.count_if(sign * F.col("objective") >= sign * F.col(name)).alias(f"hits_{name}") for name in TOP_DIVISORS]
    )
    return beams.join(counted, [*BEAM, "population"], "left")


def trends(metrics: DataFrame) -> DataFrame:
    """Per beam and population: percentile and count by iteration, and where the beam first appears.

    One point per iteration: the arrays are as long as a run has iterations.
    """
    point = F.struct("iteration", F.col("pct_of_population").alias("value"))
    count = F.struct("iteration", F.col("n_selected").alias("value"))
    return metrics.groupBy("run_id", "beam", "population").agg(
        F.min("seq").alias("first_seq"),
        F.array_sort(F.collect_list(point)).alias("percentile_trend"),
        F.array_sort(F.collect_list(count)).alias("count_trend"),
    )


def beam_order(reported: DataFrame) -> DataFrame:
    """Beams of a run in the order they first appear.  One row per beam reaches the window."""
    first = reported.groupBy("run_id", "beam").agg(F.min("seq").alias("first_seq"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("first_seq"))
    return first.select("run_id", "beam", place.cast("long").alias("place"))


# -- from a parsed run log ---------------------------------------------------------------


def log_picks(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Selected candidates with their ok objective and whether every constraint held."""
    chosen = events.where(F.col("event") == SELECTION).select(
        "run_id", "iteration", F.col("payload.beam").alias("beam"), F.explode("payload.candidates").alias("candidate_id")
    )
    results = log_results(events).where(F.col("status") == "ok")
    values = results.groupBy(*BEAM, "candidate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("ok_values")  # one per property
    )
    rules = headers.select("run_id", F.col("problem.objective.property").alias("objective_key"), F.col("problem.constraints").alias("constraints"))
    empty = F.create_map().cast("map<string,double>")
    joined = chosen.join(values, [*BEAM, "candidate_id"], "left").join(rules, "run_id")
    found = F.coalesce("ok_values", empty)
    return joined.select(
        *BEAM, "candidate_id", F.try_element_at(found, F.col("objective_key")).alias("objective"),
        holds(F.col("constraints"), found).alias("feasible"),
    )


def recorded_results(events: DataFrame) -> DataFrame:
    """Every recorded result, one row each, placed by ``request_seq, entry_pos, prop_pos``."""
    rows = events.where(F.col("event") == EVALUATION).select(
        "run_id", F.col("seq").alias("request_seq"), "iteration", F.col("payload.beam").alias("beam"), F.lit(0).cast("long").alias("entry_pos"),
        F.posexplode("payload.results").alias("prop_pos", "r"),
    )
    flat = rows.select("run_id", "request_seq", "iteration", "beam", "entry_pos", "prop_pos", "r.*")
    return flat.withColumns({"evals": F.col("cost.evals"), "cpu_hours": F.col("cost.cpu_hours")}).drop("cost")


def log_results(events: DataFrame) -> DataFrame:
    """Recorded results, the latest per candidate and property of a beam."""
    rows = recorded_results(events)
    key = [*BEAM, "candidate_id", "property"]
    others = [name for name in rows.columns if name not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("request_seq", "prop_pos")).alias("r"))
    return latest.select(*key, "r.*")


def log_members(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Population members of every run: ``run_id, population, pos, objective, feasible``."""
    rules = headers.select("run_id", F.col("problem.constraints").alias("constraints"))
    opened = events.where(F.col("event") == RUN_OPENED).select("run_id", F.explode("payload.populations").alias("p")).join(rules, "run_id")

    def member(objective: Column, pos: Column) -> Column:
        values = F.transform_values("p.constraints", lambda _, array: F.get(array, pos))
        return F.struct(pos.alias("pos"), objective.alias("objective"), holds(F.col("constraints"), values).alias("feasible"))

    # The arrays are folded into members before they are unfolded, so no member row carries an array.
    return opened.select("run_id", F.col("p.name").alias("population"), F.inline(F.transform("p.objective", member)))


def log_populations(events: DataFrame) -> DataFrame:
    """Populations of every run in the order it lists them, those without a member too: ``run_id, population_pos, population``."""
    return events.where(F.col("event") == RUN_OPENED).select(
        "run_id", F.posexplode(F.transform("payload.populations", lambda p: p["name"])).alias("population_pos", "population")
    )


def log_metrics(events: DataFrame, headers: DataFrame, *, rows_bound: int | None = None) -> DataFrame:
    """Replay: the long result table of every run from its log alone."""
    signs = headers.select("run_id", F.when(F.col("problem.objective.direction") == "min", -1.0).otherwise(1.0).alias("sign"))
    reported = events.where(F.col("event").isin(SELECTION, NO_MATCH)).select(
        "run_id", "seq", "iteration", F.col("payload.beam").alias("beam")
    )
    # The direction belongs to the run: objectives are signed once and turned back at the end.
    def signed(df: DataFrame) -> DataFrame:
        return df.join(signs, "run_id").withColumn("objective", F.col("sign") * F.col("objective")).drop("sign")

    names = log_populations(events).select("run_id", "population").distinct()
    rows = reduce_run(
        reported, signed(log_picks(events, headers)), signed(log_members(events, headers)), F.lit(1.0), populations=names, rows_bound=rows_bound
    )
    restored = rows.join(signs, "run_id")
    return restored.withColumn("median_objective", F.col("sign") * F.col("median_objective")).drop("sign")


def report_order(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """Log order, then the order in which the run listed its populations."""
    return metrics.join(log_populations(events), ["run_id", "population"]).orderBy("run_id", "seq", "population_pos")


def usage(results: DataFrame) -> DataFrame:
    """Evals and cpu hours of every run; two currencies, never combined."""
    return results.groupBy("run_id").agg(
        F.sum("evals").alias("evals"), exact_sum("cpu_hours").alias("cpu_hours"),
        F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("usd"),
    )


def cost_disagreements(recorded: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Events whose recorded cost is not the sum of their result costs."""
    summed = results.groupBy(*key).agg(F.sum("evals").alias("sum_evals"), exact_sum("cpu_hours").alias("sum_hours"))
    joined = recorded.join(summed, list(key), "left").withColumns(
        {"sum_evals": F.coalesce("sum_evals", F.lit(0)), "sum_hours": F.coalesce("sum_hours", F.lit(0.0))}
    )
    return joined.where((F.col("evals") != F.col("sum_evals")) | ~close("cpu_hours", "sum_hours"))


def close(left: str, right: str, relative: float = 1e-12, absolute: float = 1e-15) -> Column:
    """Equal within a relative or an absolute tolerance."""
    a, b = F.col(left), F.col(right)
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def run_status(events: DataFrame) -> DataFrame:
    """Per run: status, closed iterations and primary population."""
    closing = F.when(F.col("event") == RUN_CLOSED, F.col("seq"))
    return events.groupBy("run_id").agg(
        F.coalesce(F.min_by("payload.reason", closing), F.lit("open")).alias("status"),
        F.count_if(F.col("event") == ITERATION_CLOSED).alias("completed_iterations"),
        F.min_by("payload.primary", F.when(F.col("event") == RUN_OPENED, F.col("seq"))).alias("primary_population"),
    )


def metric_differences(stored: DataFrame, computed: DataFrame, key: Sequence[str], *, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose stored metrics are not the computed ones: ``key, column`` and both values as text."""
    names = [name for name in stored.columns if name not in key]
    doubles = {name for name, kind in stored.dtypes if kind == "double"}
    left = stored.select(*key, F.lit(True).alias("_s"), *[F.col(n).alias(f"s_{n}") for n in names])
    right = computed.select(*key, F.lit(True).alias("_c"), *[F.col(n).alias(f"c_{n}") for n in names])
    joined = left.join(right, list(key), "full")
    found = [F.when(F.col("_s").isNull() | F.col("_c").isNull(), F.lit("(row)"))]
    for name in names:
        a, b = F.col(f"s_{name}"), F.col(f"c_{name}")
        same = a.eqNullSafe(b)
        if name in doubles:
            same = same | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))
        found.append(F.when(F.col("_s") & F.col("_c") & ~same, F.lit(name)))
    return joined.select(*key, F.explode(F.array_compact(F.array(*found))).alias("column"))
