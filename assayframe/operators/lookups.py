"""Batched property lookups: status, caching, charging and budgets, as joins and aggregates.

A lookup is one row ``run_id, request_seq, entry_pos, prop_pos, candidate_id,
property``.  Requests of a run are answered in the order of ``request_seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.columns import CANDIDATE_ID_PATTERN, exact_sum, matches, spread_if_replicated
from assayframe.operators.scale import fits_one_map, fits_one_task, position_chunk, running, split_by_group_size
from assayframe.sources.registry import Registry
from assayframe.sources.storage import cut_lineage, write_shared

# The closed vocabulary of answers.
OK, MISSING, UNSUPPORTED, ERROR = "ok", "missing", "unsupported", "error"
CANDIDATE_UNKNOWN, VALUE_ABSENT = "candidate_unknown", "value_absent"
CACHEABLE = (OK, MISSING)
MAX_REQUEST_ENTRIES = 1000

PAIR = ["run_id", "candidate_id", "property"]
REQUEST = ["run_id", "request_seq"]


def explode_requests(requests: DataFrame) -> DataFrame:
    """Nested requests ``run_id, request_seq, batch`` to one row per lookup."""
    entries = requests.select("run_id", "request_seq", F.posexplode("batch").alias("entry_pos", "entry"))
    return entries.select(
        "run_id", "request_seq", "entry_pos", F.col("entry.candidate_id").alias("candidate_id"),
        F.posexplode("entry.properties").alias("prop_pos", "property"),
    )


def request_violations(requests: DataFrame) -> DataFrame:
    """Broken request rules as ``run_id, request_seq, rule``."""
    size = F.coalesce(F.size("batch"), F.lit(0))
    rules = {
        "run id is empty": F.coalesce(F.length("run_id"), F.lit(0)) == 0,
        "batch must hold 1 to 1000 entries": (size < 1) | (size > MAX_REQUEST_ENTRIES),
        "candidate id is malformed": F.exists("batch", lambda e: ~matches(e["candidate_id"], CANDIDATE_ID_PATTERN)),
        "an entry names no property": F.exists("batch", lambda e: F.coalesce(F.size(e["properties"]), F.lit(0)) < 1),
        "a property repeats in an entry": F.exists(
            "batch", lambda e: F.size(F.array_distinct(e["properties"])) != F.size(e["properties"])
        ),
        "a property name is empty": F.exists("batch", lambda e: F.exists(e["properties"], lambda p: F.length(p) == 0)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]))
    return requests.select("run_id", "request_seq", F.explode(broken).alias("rule"))


def request_size_violations(requests: DataFrame, entries: DataFrame, *, most: int = MAX_REQUEST_ENTRIES) -> DataFrame:
    """The size rule for requests whose entries are a table of their own."""
    sizes = entries.groupBy("request_seq").agg(F.count("*").alias("n"))
    joined = requests.join(sizes, "request_seq", "left")
    rule = F.when(F.col("n").isNull(), "request has no entry").when(F.col("n") > most, "request has too many entries")
    return joined.select("run_id", "request_seq", rule.alias("rule")).where(F.col("rule").isNotNull())


def answer(
    lookups: DataFrame, candidates: DataFrame, registry: Registry, *, backend: str = "table", source: str = "",
    tier: str = "", failure: str | None = None,
) -> DataFrame:
    """Fresh answer of every lookup; the population filters play no part here.

    One join with the wide candidate table serves all properties.  ``failure``
    names a candidate column that holds the class of a backend failure, if any.
    """
    units = registry.frame(lookups.sparkSession).select(F.col("key").alias("property"), "unit")
    carried = candidates.withColumn("_known", F.lit(True))
    joined = lookups.join(F.broadcast(units.withColumn("_supported", F.lit(True))), "property", "left").join(
        carried, "candidate_id", "left"
    )
    key = F.col("property")
    median, count = registry.pick(key, "_median"), registry.pick(key, "_n")
    failed = F.lit(False) if failure is None else F.col(failure).isNotNull()
    status = (
        F.when(F.col("_supported").isNull(), UNSUPPORTED)
        .when(F.coalesce(failed, F.lit(False)), ERROR)
        .when(F.col("_known").isNull() | median.isNull(), MISSING)
        .otherwise(OK)
    )
    reason = F.when(status == MISSING, F.when(F.col("_known").isNull(), CANDIDATE_UNKNOWN).otherwise(VALUE_ABSENT))
    if failure is not None:
        reason = F.when(status == ERROR, F.col(failure)).otherwise(reason)
    served = status == OK
    return joined.select(
        *lookups.columns,
        status.alias("status"),
        F.when(served, median).alias("value"),
        F.when(served, F.col("unit")).alias("unit"),
        F.when(served, count).alias("n_replicates"),
        F.when(served, spread_if_replicated(count, registry.pick(key, "_std"))).alias("spread"),
        F.lit(backend).alias("backend"), F.lit(source).alias("source"), F.lit(tier).alias("provenance_tier"),
        reason.alias("reason"),
    )


def flag_cached(
    answered: DataFrame, *, preloaded: DataFrame | None = None, asked: DataFrame | None = None, rows_bound: int | None = None,
    by_candidate: bool = False,
) -> DataFrame:
    """Add ``cached``: the pair was answered ok or missing in an earlier request of its run.

    ``preloaded`` (``run_id, candidate_id, property``) counts as answered before
    the first request.  ``asked`` may hold the same lookups without answers when
    a pair gets the same answer every time; it spares answering them twice.
    ``rows_bound`` bounds the rows of one candidate of one run.  With
    ``by_candidate`` it bounds those of one candidate, whose rows lie together.
    """
    cacheable = F.when(F.col("status").isin(*CACHEABLE), F.col("request_seq"))
    if preloaded is None and fits_one_task(rows_bound):
        first = F.min(cacheable).over(Window.partitionBy(*PAIR))
        # Either partitioning serves this window and the charge window.
        together = answered if by_candidate else answered.repartition("run_id", "candidate_id")
        return together.withColumn("cached", F.coalesce(first < F.col("request_seq"), F.lit(False)))
    tried = answered.where(cacheable.isNotNull()) if asked is None else asked
    firsts = tried.select(*PAIR, "request_seq", F.lit(False).alias("_before"))
    if preloaded is not None:
        before = preloaded.select(*PAIR, F.lit(None).cast("long").alias("request_seq"), F.lit(True).alias("_before"))
        firsts = firsts.unionByName(before)
    firsts = firsts.groupBy(*PAIR).agg(F.min("request_seq").alias("_first"), F.bool_or("_before").alias("_before"))
    hit = cacheable.isNotNull() & (F.col("_before") | (F.col("_first") < F.col("request_seq")))
    return answered.join(firsts, PAIR, "left").withColumn("cached", F.coalesce(hit, F.lit(False))).drop("_first", "_before")


STORED = ["status", "value", "unit", "n_replicates", "spread", "reason"]


def with_stored_answers(answered: DataFrame, stored: DataFrame) -> DataFrame:
    """Answers of a preloaded cache stand in for fresh ones; an unregistered property stays unsupported."""
    kept = stored.select(*PAIR, *[F.col(name).alias(f"_stored_{name}") for name in STORED])
    joined = answered.join(kept, PAIR, "left")
    use = F.col("_stored_status").isNotNull() & (F.col("status") != UNSUPPORTED)
    others = [name for name in answered.columns if name not in STORED]
    return joined.select(*others, *[F.when(use, F.col(f"_stored_{name}")).otherwise(F.col(name)).alias(name) for name in STORED])


def charge(flagged: DataFrame, *, rows_bound: int | None = None) -> DataFrame:
    """Add ``evals`` and ``cpu_hours``: one eval on a candidate's first fresh ok answer in a request."""
    owner = ["run_id", "request_seq", "candidate_id"]
    place = F.struct("entry_pos", "prop_pos")
    fresh = (F.col("status") == OK) & ~F.col("cached")
    if fits_one_task(rows_bound):
        first = F.min(F.when(fresh, place)).over(Window.partitionBy(*owner))
        paid = flagged.withColumn("evals", F.coalesce(place == first, F.lit(False)).cast("long"))
    else:
        flagged = cut_lineage(flagged)  # two large joins deep and read twice
        firsts = flagged.where(fresh).groupBy(*owner).agg(F.min(place).alias("_first"))
        paid = (
            flagged.join(firsts, owner, "left")
            .withColumn("evals", F.coalesce(place == F.col("_first"), F.lit(False)).cast("long"))
            .drop("_first")
        )
    return paid.withColumn("cpu_hours", F.lit(0.0))


def evaluate(
    lookups: DataFrame, candidates: DataFrame, registry: Registry, *, preloaded: DataFrame | None = None,
    rows_bound: int | None = None, candidate_bound: int | None = None, hot_rows: int | None = None, **backend: str,
) -> DataFrame:
    """Answers with cache flags and costs, in no particular order (see ``response_order``).

    A ``preloaded`` cache that holds whole answers also replaces the fresh ones.
    Candidates a run asks for seldom settle in one shuffle; those it asks for
    more than ``hot_rows`` times (normally ``HOT_ROWS``) settle by aggregates.
    ``candidate_bound`` bounds the lookups of one candidate in all runs; where it
    is small, ``lookups`` should come partitioned by candidate, and then nothing
    is counted and no lookup moves again.
    """

    def settle(asked: DataFrame, bound: int | None, by_candidate: bool = False) -> DataFrame:
        answered = answer(asked, candidates, registry, **backend)
        if preloaded is not None and set(STORED) <= set(preloaded.columns):
            answered = with_stored_answers(answered, preloaded)
        flagged = flag_cached(answered, preloaded=preloaded, asked=asked, rows_bound=bound, by_candidate=by_candidate)
        return charge(flagged, rows_bound=bound)

    if fits_one_task(rows_bound):
        return settle(lookups, rows_bound)
    if fits_one_map(candidate_bound):
        return settle(lookups, 0, by_candidate=True)
    calm, hot = split_by_group_size(lookups, ["run_id", "candidate_id"], hot_rows)
    parts = ([] if calm is None else [settle(calm, 0)]) + ([] if hot is None else [settle(hot, None)])
    return reduce(DataFrame.unionByName, parts)


def response_order(results: DataFrame) -> DataFrame:
    """Request order, then entry order, then property order."""
    return results.orderBy("run_id", "request_seq", "entry_pos", "prop_pos")


def request_costs(results: DataFrame) -> DataFrame:
    """Cost of every request in its two currencies, which are never added together."""
    return results.groupBy(*REQUEST).agg(F.sum("evals").alias("evals"), exact_sum("cpu_hours").alias("cpu_hours"))


def budget_cutoff(costs: DataFrame, limit: Column, *, rows_bound: int | None = None) -> DataFrame:
    """Requests of each run with ``spent`` before them, ``kept`` and ``refused``.

    The first request that costs more than what is left closes the run.  Costs
    are not negative, so a running total over the limit stays over it: a request
    is kept while its own total is within the limit, and the refused one is
    where the total crosses it.
    """
    chunk = None if fits_one_task(rows_bound) else position_chunk("request_seq")
    totals = running(
        costs.withColumn("_limit", limit), ["run_id"], ["request_seq"], {"_upto": ("sum", F.col("evals"))}, chunk=chunk
    )
    spent = F.col("_upto") - F.col("evals")
    kept = F.col("_upto") <= F.col("_limit")
    return totals.select(
        *costs.columns, spent.alias("spent"), kept.alias("kept"), (~kept & (spent <= F.col("_limit"))).alias("refused")
    )


def budget_greedy(
    answered: DataFrame, limit: int, *, rows_bound: int | None = None, hot_rows: int | None = None, candidate_bound: int | None = None
) -> DataFrame:
    """Independent callers under one budget: a refused request is skipped and caches nothing.

    Returns ``run_id, request_seq, evals, accepted``; ``evals`` is what the
    request costs at its turn.  A refusal changes later cache hits, so a run is
    a sequential fold.  Small runs are folded in one ordered pass.  Runs of more
    than ``hot_rows`` answers (normally ``HOT_ROWS``) advance together, a stretch
    of requests per round, each round spread over all tasks.  ``candidate_bound``
    bounds the answers of one candidate; where it is small, ``answered`` should
    come partitioned by candidate.
    """
    if fits_one_task(rows_bound):
        pairs = answered.where(F.col("status") == OK).select(*REQUEST, "candidate_id", "property").distinct()
        return _with_free(answered, _fold_runs(pairs, limit))
    named = _named(answered, candidate_bound)
    calm, hot = split_by_group_size(named, ["run_id"], hot_rows, sized=_pairs(named).select("run_id"))
    parts = ([] if calm is None else [_with_free(calm, _fold_runs(_pairs(calm), limit))]) + ([] if hot is None else [_advance_runs(hot, limit)])
    return reduce(DataFrame.unionByName, parts)


def _with_free(asked: DataFrame, decided: DataFrame) -> DataFrame:
    """Every request of ``asked``; one that no pair decides costs nothing."""
    free = F.coalesce(F.col("evals"), F.lit(0)).alias("evals"), F.coalesce(F.col("accepted"), F.lit(True)).alias("accepted")
    return asked.select(*REQUEST).distinct().join(decided, REQUEST, "left").select(*REQUEST, *free)


def _named(answered: DataFrame, candidate_bound: int | None) -> DataFrame:
    """One row per request and candidate: the ``properties`` it has answers for, and whether another request of the run has answers ``again``."""
    served = F.collect_set(F.when(F.col("status") == OK, F.col("property")))  # at most the properties of one request's entries
    named = answered.groupBy(*REQUEST, "candidate_id").agg(served.alias("properties"))
    owner = ["run_id", "candidate_id"]
    if fits_one_map(candidate_bound):
        seq, whole = F.when(F.size("properties") > 0, F.col("request_seq")), Window.partitionBy(*owner)
        again = F.min(seq).over(whole) < F.max(seq).over(whole)
        return write_shared(named.withColumn("again", F.coalesce(again, F.lit(False))), "named")
    named = write_shared(named, "named")
    repeated = named.where(F.size("properties") > 0).groupBy(*owner).agg(F.count("*").alias("_n")).where("_n > 1")
    marked = named.join(repeated, owner, "left").withColumn("again", F.col("_n").isNotNull()).drop("_n")
    return write_shared(marked, "named")


def _pairs(named: DataFrame) -> DataFrame:
    return named.select(*REQUEST, "candidate_id", F.explode("properties").alias("property"))


def _fold_runs(pairs: DataFrame, limit: int) -> DataFrame:
    """One ordered pass over the runs of each partition; memory holds one run's known pairs."""
    run_type = pairs.schema["run_id"].dataType.simpleString()
    seq_type = pairs.schema["request_seq"].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, seq, left, known, fresh, out = None, None, limit, set(), set(), []

        def decide() -> None:
            nonlocal left
            cost = len({candidate for candidate, _ in fresh})
            out.append((run, seq, cost, cost <= left))
            if cost <= left:
                left -= cost
                known.update(fresh)

        for part in parts:
            for row_run, row_seq, *pair in part.itertuples(index=False, name=None):
                if (row_run, row_seq) != (run, seq):
                    if seq is not None:
                        decide()
                    if row_run != run:
                        left, known = limit, set()
                    run, seq, fresh = row_run, row_seq, set()
                if tuple(pair) not in known:
                    fresh.add(tuple(pair))
            yield pd.DataFrame(out, columns=["run_id", "request_seq", "evals", "accepted"])
            out.clear()
        if seq is not None:
            decide()
            yield pd.DataFrame(out, columns=["run_id", "request_seq", "evals", "accepted"])

    ordered = pairs.repartition("run_id").sortWithinPartitions("run_id", "request_seq")
    return ordered.select(*PAIR[:1], "request_seq", *PAIR[1:]).mapInPandas(
        fold, f"run_id {run_type}, request_seq {seq_type}, evals long, accepted boolean"
    )


def _rounds(pending: DataFrame, pairs: DataFrame) -> Iterator[DataFrame]:
    """Decided requests of each round.

    ``pending`` has the undecided requests with ``base``, the number of their
    candidates that no other request of the run asks for, whether they are
    ``linked``, and what is ``left`` of their run's budget.  ``pairs`` has the
    other pairs of linked requests, as far as nobody has paid for them.

    A round takes for granted that every small request, one that costs at most
    half of what is left under the current cache, is accepted, and that no big
    one is.  Under that guess the cost of every request at its turn and what is
    left before it are one minimum per pair and one running sum.  The guess is
    right up to the first small request that does not fit or the first big one
    that does, and that request is decided too.  Either way less than half is
    left, unless a big request has become cheap by what was cached since the
    round began: rounds follow the logarithm of the largest cost, not the budget.
    """
    while True:
        # Nothing changes the cost of a request that is not linked, and what is left only shrinks.
        settled = ~F.col("linked") & ((F.col("base") == 0) | (F.col("base") > F.col("left")))
        yield pending.where(settled).select(*REQUEST, F.col("base").alias("evals"), (F.col("base") == 0).alias("accepted"))
        pending = pending.where(~settled)
        if pending.isEmpty():
            return
        small = F.col("most") <= F.floor(F.col("left") / 2)
        plain = pending.where("NOT linked").withColumn("most", F.col("base")).withColumn("evals", F.col("base"))
        more = pairs.select(*REQUEST, "candidate_id").distinct().groupBy(*REQUEST).agg(F.count("*").alias("_more"))
        linked = pending.where("linked").join(more, REQUEST, "left").withColumn("most", F.col("base") + F.coalesce("_more", F.lit(0))).drop("_more")
        first = pairs.join(linked.where(small).select(*REQUEST), REQUEST, "left_semi").groupBy(*PAIR).agg(F.min("request_seq").alias("_first"))
        fresh = pairs.join(first, PAIR, "left").where(F.col("_first").isNull() | (F.col("_first") >= F.col("request_seq")))
        paid = fresh.select(*REQUEST, "candidate_id").distinct().groupBy(*REQUEST).agg(F.count("*").alias("_paid"))
        linked = linked.join(paid, REQUEST, "left").withColumn("evals", F.col("base") + F.coalesce("_paid", F.lit(0))).drop("_paid")
        turns = plain.unionByName(linked).select(*REQUEST, "left", "evals", small.alias("small"))
        charged = F.when(F.col("small"), F.col("evals")).otherwise(0)
        placed = running(turns, ["run_id"], ["request_seq"], {"_spent": ("sum", charged)}, chunk=position_chunk("request_seq"), inclusive=False)
        spare = F.col("left") - F.coalesce("_spent", F.lit(0))
        placed = placed.withColumn("fits", F.col("evals") <= spare)
        # A request that costs nothing changes nothing, so it ends no round.
        wrong = (F.col("evals") > 0) & (F.col("small") != F.col("fits"))
        placed = cut_lineage(placed.withColumn("wrong", wrong).select(*REQUEST, "left", "evals", "fits", "wrong"))
        stop = placed.where("wrong").groupBy("run_id").agg(F.min("request_seq").alias("_stop"))
        until = placed.join(stop, "run_id", "left").where(F.col("_stop").isNull() | (F.col("request_seq") <= F.col("_stop")))
        yield until.select(*REQUEST, "evals", F.col("fits").alias("accepted"))
        spent = until.groupBy("run_id").agg(
            F.first("_stop").alias("_stop"), (F.first("left") - F.sum(F.when(F.col("fits"), F.col("evals")).otherwise(0))).alias("left")
        )
        spent = spent.where("_stop IS NOT NULL")
        later = F.col("request_seq") > F.col("_stop")
        bought = pairs.join(until.where("fits AND evals > 0").select(*REQUEST), REQUEST, "left_semi").select(*PAIR).distinct()
        pairs = write_shared(pairs.join(spent.select("run_id", "_stop"), "run_id").where(later).drop("_stop").join(bought, PAIR, "left_anti"), "pairs")
        pending = cut_lineage(pending.drop("left").join(spent, "run_id").where(later).drop("_stop"))


def _advance_runs(named: DataFrame, limit: int) -> DataFrame:
    """Candidates that one request of a run asks for are counted once; only what several ask for takes part in the rounds as pairs."""
    served = F.size("properties") > 0
    requests = named.groupBy(*REQUEST).agg(
        F.count_if(served & ~F.col("again")).alias("base"), F.bool_or(served & F.col("again")).alias("linked"), F.lit(limit).cast("long").alias("left")
    )
    return reduce(DataFrame.unionByName, _rounds(cut_lineage(requests), _pairs(named.where("again"))))


def rebuild_cache(results: DataFrame) -> DataFrame:
    """Cache rows from recorded results: fresh ok or missing answers, the latest per key."""
    stored = results.where(~F.col("cached") & F.col("status").isin(*CACHEABLE))
    key = ["run_id", "candidate_id", "property", "backend", "source"]
    when = F.struct("request_seq", "entry_pos", "prop_pos")
    return stored.groupBy(*key).agg(
        F.max_by("status", when).alias("status"), F.max_by("value", when).alias("value"), F.max("request_seq").alias("request_seq")
    )


def meter(results: DataFrame) -> DataFrame:
    """What every run has spent, in its two currencies."""
    return results.groupBy("run_id").agg(F.sum("evals").alias("evals"), exact_sum("cpu_hours").alias("cpu_hours"))


def remaining_work(planned: DataFrame, recorded: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows whose key has not been recorded."""
    return planned.join(recorded.select(*key), key, "left_anti")


def served_values(members: DataFrame, candidates: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Member ids with the values the evaluator serves; an unknown id keeps NULLs."""
    served = candidates.select("candidate_id", *[F.col(column).alias(name) for name, column in columns.items()])
    return members.join(served, "candidate_id", "left")
