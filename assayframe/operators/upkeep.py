"""A candidate table that is kept up to date under appends.

Rows are kept as evidence: per structure key and label, how often each property
took each value.  Evidence and candidates lie in buckets of the key's hash.  An
append merges its own evidence into the buckets that its keys fall into and
derives the candidates of those keys anew, because a new label can change what
the unlabelled rows of its key count as; other keys are carried over and other
buckets are not read.

Each append writes a generation of the touched buckets and is committed by one
small file that only one writer can create.  A batch that is already committed
changes nothing, and one that failed half way leaves no trace.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.columns import UNKNOWN_LABEL, known_label, normalise_label
from assayframe.operators.candidates import build_candidates
from assayframe.operators.scale import fits_one_map
from assayframe.sources.storage import create_once, hadoop_path, write_shared

BUCKETS = 64
GENERATION = "generation long, batch string, folder string, buckets array<int>"
ROWS = ""  # the entry that counts rows stands where a property would
STATISTICS = ("median", "n", "min", "max", "std")


class Conflict(RuntimeError):
    """Another writer committed first; the append can be tried again."""


class Generation(NamedTuple):
    """A committed append and the buckets that it wrote."""

    generation: int
    batch: str
    folder: str
    buckets: tuple[int, ...]


def generations(spark: SparkSession, path: str) -> list[Generation]:
    folder, store = hadoop_path(spark, f"{path}/commits")
    if not store.exists(folder):
        return []
    rows = spark.read.schema(GENERATION).json(f"{path}/commits").where("generation IS NOT NULL AND buckets IS NOT NULL").collect()
    return sorted(Generation(row["generation"], row["batch"], row["folder"], tuple(row["buckets"])) for row in rows)


def live_folders(known: Sequence[Generation]) -> dict[int, str]:
    """Per bucket the folder of its last generation."""
    return {bucket: generation.folder for generation in known for bucket in generation.buckets}


def evidence(rows: DataFrame, properties: Sequence[str], key: str, label: str) -> DataFrame:
    """(key, label, property, value, n): how often each value was measured, and how many rows there are; combined on the map side."""
    entries = [F.struct(F.lit(ROWS).alias("property"), F.lit(None).cast("double").alias("value"))]
    entries += [F.struct(F.lit(name).alias("property"), F.col(name).cast("double").alias("value")) for name in properties]
    tidy = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), normalise_label(label).alias("label"), F.explode(F.array(*entries)).alias("e"))
    taken = tidy.where((F.col("e.property") == ROWS) | F.col("e.value").isNotNull())
    return taken.groupBy("key", "label", F.col("e.property").alias("property"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def derive(counts: DataFrame, properties: Sequence[str], *, rows_bound: int | None = None) -> DataFrame:
    """Candidates from the evidence of whole keys: label resolution, then the statistics of every property."""
    known = known_label(F.col("label"))
    seen = counts.groupBy("key").agg(F.min(known).alias("_only"), F.max(known).alias("_last"))
    only = F.coalesce(F.when(F.col("_only") == F.col("_last"), F.col("_only")), F.lit(UNKNOWN_LABEL))
    resolved = counts.join(seen, "key").withColumn("resolved_label", F.when(F.col("label") == UNKNOWN_LABEL, only).otherwise(F.col("label")))
    identity = ["key", "resolved_label"]
    rows = resolved.where(F.col("property") == ROWS).groupBy(*identity).agg(F.sum("n").alias("n_rows"))
    if not properties:
        return rows
    if not fits_one_map(rows_bound):
        # The evidence tells how many rows the largest key has; no candidate has more values of a property.
        sizes = counts.where(F.col("property") == ROWS).groupBy("key").agg(F.sum("n").alias("n"))
        rows_bound = sizes.agg(F.max("n")).first()[0]
    # Each value as often as it was measured: the statistics then share the ways for hot groups.
    long = resolved.where(F.col("property") != ROWS).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    measured = build_candidates(long, ["value"], key=[*identity, "property"], rows_bound=rows_bound)
    wide = measured.groupBy(*identity).agg(*[
        F.max(F.when(F.col("property") == name, F.col(f"value_{what}"))).alias(f"{name}_{what}") for name in properties for what in STATISTICS
    ])
    counted = {f"{name}_n": F.coalesce(f"{name}_n", F.lit(0)) for name in properties}
    return rows.join(wide, identity, "left").withColumns(counted)


def append_rows(
    rows: DataFrame, properties: Sequence[str], path: str, *, key: str, label: str, batch: str | None = None, rows_bound: int | None = None
) -> Generation:
    """Add measured rows to the candidate table under ``path``; returns the generation that holds the batch."""
    spark = rows.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    known = generations(spark, path)
    for generation in known:
        if generation.batch == batch:
            return generation
    delta = write_shared(_bucketed(evidence(rows, properties, key, label)), "upkeep-delta")
    touched = sorted(row["_bucket"] for row in delta.select("_bucket").distinct().collect())  # at most BUCKETS
    folder = f"g-{uuid.uuid4().hex}"
    if touched:
        old = {bucket: place for bucket, place in live_folders(known).items() if bucket in touched}
        merged = delta
        if old:
            schema = delta.drop("_bucket").schema
            before = spark.read.schema(schema).parquet(*[f"{path}/{place}/evidence/_bucket={bucket}" for bucket, place in sorted(old.items())])
            merged = _bucketed(before).unionByName(delta).groupBy("key", "label", "property", "value", "_bucket").agg(F.sum("n").alias("n"))
        merged.repartition("_bucket", "key").write.partitionBy("_bucket").parquet(f"{path}/{folder}/evidence")
        stored = spark.read.schema(delta.schema).parquet(f"{path}/{folder}/evidence")
        keys = delta.select("key").distinct()
        fresh = derive(stored.drop("_bucket").join(keys, "key", "left_semi"), properties, rows_bound=rows_bound)
        if old:
            kept = spark.read.schema(fresh.schema).parquet(*[f"{path}/{place}/candidates/_bucket={bucket}" for bucket, place in sorted(old.items())])
            fresh = fresh.unionByName(kept.join(keys, "key", "left_anti"))
        _bucketed(fresh).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}/candidates")
    number = max([0, *[generation.generation for generation in known]]) + 1
    text = json.dumps({"generation": number, "batch": batch, "folder": folder, "buckets": touched}, sort_keys=True)
    if not create_once(spark, f"{path}/commits/{number:012d}.json", text):
        for generation in generations(spark, path):
            if generation.batch == batch:
                return generation
        raise Conflict(f"generation {number} of {path} was committed by another writer")
    return Generation(number, batch, folder, tuple(touched))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(key, resolved_label, n_rows, statistics) of all appends together; ValueError before the first append with a row."""
    live = live_folders(generations(spark, path))
    if not live:
        raise ValueError(f"no rows were appended to {path}")
    return spark.read.parquet(*[f"{path}/{folder}/candidates/_bucket={bucket}" for bucket, folder in sorted(live.items())])
