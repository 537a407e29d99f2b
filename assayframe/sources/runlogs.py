"""Run logs: JSONL scans into headers and typed events, and the result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions.columns import is_finite
from assayframe.functions.strictjson import sorted_json, strict_json

COST = "struct<evals: bigint, cpu_hours: double>"
RESULT = (
    "struct<candidate_id: string, property: string, status: string, value: double, unit: string, n_replicates: bigint, "
    f"spread: double, backend: string, source: string, provenance_tier: string, cached: boolean, cost: {COST}, reason: string>"
)
POPULATION = "struct<name: string, objective: array<double>, constraints: map<string, array<double>>>"
PROBLEM = (
    "struct<schema_version: int, objective: struct<property: string, direction: string>, "
    "constraints: array<struct<property: string, op: string, value: double>>, form: string, "
    "budget: struct<iterations: bigint, candidates_per_beam: bigint, beams: bigint>, table: string, seed: bigint>"
)
PROVENANCE = "struct<seed: bigint, snapshot: string, registry_version: string, selector: string, code_git_sha: string>"
PAYLOAD = (
    "struct<primary: string, populations: array<" + POPULATION + ">, beam: string, candidates: array<string>, "
    "candidate_id: string, results: array<" + RESULT + ">, cost: " + COST + ", reason: string, "
    "requested: bigint, remaining: bigint, `limit`: bigint>"
)
LINE = (
    f"schema_version int, run_id string, problem {PROBLEM}, provenance {PROVENANCE}, "
    f"seq bigint, ts string, iteration bigint, event string, payload {PAYLOAD}"
)
PLAN = "schema_version int, iterations array<struct<iteration: bigint, beams: array<struct<beam: string, candidates: array<string>>>>>"
REQUEST = "run_id string, iteration bigint, batch array<struct<candidate_id: string, properties: array<string>>>"


def read_log_lines(spark: SparkSession, path: str | list[str], *carry: str) -> DataFrame:
    """Lines with ``file, line, value, file_bytes``; lines are numbered from 1 within their file.

    ``carry`` names further members of the file's metadata to keep.

    A long file is read in splits.  Lines are numbered where they are read; only
    the number of lines in each split, one row, is shuffled and broadcast.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_size"].alias("file_bytes"),
        meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_id"), "value", *[meta[name].alias(name) for name in carry],
    )
    splits = raw.groupBy(F.col("file").alias("_file"), F.col("_split").alias("_from")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
    numbered = raw.join(F.broadcast(offsets), (F.col("file") == F.col("_file")) & (F.col("_split") == F.col("_from")))
    return numbered.select("file", (F.col("_id") + F.col("_offset")).alias("line"), "value", "file_bytes", *carry)


def parse_log(lines: DataFrame) -> DataFrame:
    """Add the typed members of every line as ``record`` and ``is_header``."""
    record = F.from_json("value", LINE)
    return lines.withColumn("record", record).withColumn(
        "is_header", F.col("record.provenance").isNotNull() & F.col("record.event").isNull()
    )


def headers(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_header").select(
        "file", "line", "record.run_id", "record.schema_version", "record.problem", "record.provenance"
    )


def events(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("is_header")).select(
        "file", "line", "record.run_id", "record.seq", "record.ts", "record.iteration", "record.event", "record.payload"
    )


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and events of every log under ``path``."""
    parsed = parse_log(read_log_lines(spark, path))
    return headers(parsed), events(parsed)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document file (requests, plans, problems), strictly read."""
    texts = spark.read.text(path, wholetext=True)
    complaint = F.lit("not a strict JSON document")
    checked = texts.select(F.when(strict_json("value"), F.col("value")).otherwise(F.raise_error(complaint)).alias("value"))
    return checked.select(F.from_json("value", schema).alias("d")).select("d.*")


def explode_plan(plans: DataFrame) -> DataFrame:
    """Plans ``run_id, iterations`` to one row per beam and candidate; an empty beam keeps one row."""
    beams = plans.select("run_id", F.explode("iterations").alias("i")).select(
        "run_id", F.col("i.iteration").alias("iteration"), F.posexplode("i.beams").alias("beam_pos", "b")
    )
    return beams.select(
        "run_id", "iteration", "beam_pos", F.col("b.beam").alias("beam"), F.posexplode_outer("b.candidates").alias("cand_pos", "candidate_id")
    )


def write_results_csv(metrics: DataFrame, path: str) -> None:
    """Long result table as CSV; NULL is an empty cell and a non-finite number fails the job."""
    doubles = [name for name, kind in metrics.dtypes if kind == "double"]
    checked = {
        name: F.when(F.col(name).isNull() | is_finite(name), F.col(name)).otherwise(
            F.raise_error(F.lit(f"non-finite number in {name}")).cast("double")
        )
        for name in doubles
    }
    metrics.withColumns(checked).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(df: DataFrame, path: str, *, compression: str = "none") -> None:
    """One compact, key-sorted JSON object per row; a compressed file is read by one task."""
    df.select(sorted_json({name: F.col(name) for name in df.columns}).alias("value")).write.mode("overwrite").option("compression", compression).text(path)
