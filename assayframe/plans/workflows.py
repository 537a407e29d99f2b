"""The whole workflows: load a source, answer a request file, replay and check run logs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.columns import plain_structure_key
from assayframe.operators import candidates as cand
from assayframe.operators import logchecks, lookups, metrics
from assayframe.operators.identity import with_identity, with_structure_key
from assayframe.sources import caches, measurements, runlogs
from assayframe.sources.registry import Registry
from assayframe.sources.storage import cut_lineage


class Refused(RuntimeError):
    """An input that breaks a rule; nothing was written."""


def load_source(
    source: DataFrame, out: str, registry: Registry, *, raw: str, second: str, label: str, facts: Mapping[str, str],
    canonical: Callable[[Column], Column] = plain_structure_key, expensive: bool = False, rows_bound: int | None = None,
) -> DataFrame:
    """Write ``<out>/rows`` and ``<out>/candidates`` with provenance; return the accounting row."""
    measurements.require_columns(source, [raw, second, label, *registry.columns()])
    spark = source.sparkSession
    keyed = with_structure_key(source, raw, canonical=canonical, expensive=expensive)
    accounting = cut_lineage(measurements.load_accounting(keyed, second, "structure_key"))
    counts = {name: str(value) for name, value in accounting.first().asDict().items()}
    if counts.pop("balanced") != "True":
        raise Refused(f"the load does not balance: {counts}")
    told = {**facts, **counts}
    rows = with_identity(source, raw=raw, second=second, label=label, canonical=canonical, expensive=expensive)
    declared = {name: "double" for name in registry.columns()}
    measurements.write_table(rows, f"{out}/rows", declared, told)
    written = measurements.read_table(spark, f"{out}/rows", **facts)
    key = ["candidate_id", "structure_key", "resolved_label"]
    table = cand.build_candidates(written, registry.columns(), key=key, rows_bound=rows_bound)
    measurements.write_table(table, f"{out}/candidates", {}, told)
    return accounting


def answer_requests(
    spark: SparkSession, request_path: str, candidates: DataFrame, registry: Registry, *, cache: str | None = None,
    limit: int | None = None, **backend: str,
) -> DataFrame:
    """Answer a request document, under an optional budget, with an optional result cache to read and extend."""
    requests = runlogs.read_json_documents(spark, request_path, runlogs.REQUEST).withColumn("request_seq", F.col("iteration"))
    broken = lookups.request_violations(requests).take(1)
    if broken:
        raise Refused(f"request {broken[0]['run_id']!r}: {broken[0]['rule']}")
    asked = lookups.explode_requests(requests)
    preloaded = None
    if cache is not None:
        known = caches.read_cache(spark, cache).where(
            (F.col("backend") == backend.get("backend", "table")) & (F.col("source") == backend.get("source", ""))
        )
        stored = known.select("candidate_id", "property", *[F.col(f"result.{name}").alias(name) for name in lookups.STORED])
        preloaded = asked.select("run_id", "candidate_id", "property").distinct().join(stored, ["candidate_id", "property"])
    results = cut_lineage(lookups.evaluate(asked, candidates, registry, preloaded=preloaded, **backend))
    if limit is not None:
        over = lookups.meter(results).where(F.col("evals") > limit).take(1)
        if over:
            raise Refused(f"requested {over[0]['evals']} evals of limit {limit}")
    if cache is not None:
        caches.append_cache(results, cache)
    return lookups.response_order(results)


class Replay(NamedTuple):
    """What a set of run logs reduces to."""

    metrics: DataFrame
    usage: DataFrame
    status: DataFrame
    trends: DataFrame


def log_violations(spark: SparkSession, path: str, *, rows_bound: int | None = None) -> DataFrame:
    """Every broken rule of every log under ``path``."""
    lines = runlogs.read_log_lines(spark, path)
    parsed = runlogs.parse_log(lines)
    headers, events = runlogs.headers(parsed), runlogs.events(parsed)
    flat = events.withColumns({"beam": F.col("payload.beam"), "candidate_id": F.col("payload.candidate_id")})
    parts = [
        logchecks.line_violations(lines), logchecks.torn_tails(lines), logchecks.header_violations(parsed),
        logchecks.shape_violations(parsed), logchecks.contiguity_violations(events, rows_bound=rows_bound), logchecks.duplicate_keys(flat),
        logchecks.lifecycle_violations(events, rows_bound=rows_bound), logchecks.evaluation_references(events),
        logchecks.population_violations(events, headers), logchecks.problem_violations(headers.select("run_id", "problem.*")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def replay(spark: SparkSession, path: str, *, rows_bound: int | None = None) -> Replay:
    """Reduce the logs under ``path`` to their tables, from the logs alone; a broken log is refused."""
    broken = log_violations(spark, path, rows_bound=rows_bound).take(1)
    if broken:
        raise Refused(f"{broken[0]['run_id']}:{broken[0]['seq']}: {broken[0]['rule']}")
    headers, events = runlogs.read_log(spark, path)
    table = metrics.log_metrics(events, headers, rows_bound=rows_bound)
    results = metrics.recorded_results(events)
    recorded = events.where(F.col("event") == logchecks.EVALUATION).select(
        "run_id", F.col("seq").alias("request_seq"), F.col("payload.cost.evals").alias("evals"),
        F.col("payload.cost.cpu_hours").alias("cpu_hours"),
    )
    wrong = metrics.cost_disagreements(recorded, results, lookups.REQUEST).take(1)
    if wrong:
        raise Refused(f"{wrong[0]['run_id']}:{wrong[0]['request_seq']}: the cost is not the sum of its results")
    return Replay(metrics.report_order(table, events), metrics.usage(results), metrics.run_status(events), metrics.trends(table))


def write_replay(replayed: Replay, out: str) -> None:
    """Results as CSV, usage and summary as JSON."""
    columns = ["run_id", "iteration", "beam", "population", "n_selected", "n_ok", "median_objective", "feasible_frac", "n_population",
               "pct_of_population", "hits_top10", "hits_top1"]
    runlogs.write_results_csv(replayed.metrics.select(*columns), f"{out}/results")
    runlogs.write_json(replayed.usage, f"{out}/usage")
    runlogs.write_json(run_summaries(replayed), f"{out}/summary")


def run_summaries(replayed: Replay) -> DataFrame:
    """One row per run, those without a beam too: its status and its trends in report order, nested.

    As many trends as the run has beams and populations.
    """
    place = replayed.metrics.select("run_id", "population", "population_pos").distinct()
    trend = F.struct("first_seq", "population_pos", "beam", "population", "percentile_trend", "count_trend")
    nested = replayed.trends.join(place, ["run_id", "population"]).groupBy("run_id").agg(F.array_sort(F.collect_list(trend)).alias("trends"))
    rows = replayed.status.join(nested, "run_id", "left").withColumn("trends", F.coalesce("trends", F.array().cast(nested.schema["trends"].dataType)))
    return rows.withColumn("trends", F.transform("trends", lambda t: t.dropFields("first_seq", "population_pos")))


def unfinished_work(plan: DataFrame, events: DataFrame) -> DataFrame:
    """Planned evaluations a log has not recorded yet: what a resumed run would look up."""
    key: Sequence[str] = ["run_id", "iteration", "beam", "candidate_id"]
    planned = plan.where(F.col("candidate_id").isNotNull())
    recorded = events.where(F.col("event") == logchecks.EVALUATION).select(
        "run_id", "iteration", F.col("payload.beam").alias("beam"), F.col("payload.candidate_id").alias("candidate_id")
    )
    return lookups.remaining_work(planned, recorded, list(key))
