"""Candidate identity: scope, structure keys, label resolution and content-hash ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.columns import UNKNOWN_LABEL, content_id, known_label, normalise_label, plain_structure_key


def in_scope(df: DataFrame, second: str) -> DataFrame:
    """Rows with a single component."""
    return df.where(F.col(second).isNull())


def with_structure_key(
    df: DataFrame, raw: str, name: str = "structure_key", canonical: Callable[[Column], Column] = plain_structure_key,
    *, expensive: bool = False,
) -> DataFrame:
    """Add the structure key of ``raw``.

    An ``expensive`` canonicaliser (typically a pandas UDF) runs once per
    distinct raw text and is joined back; built-in expressions run in place.
    """
    if not expensive:
        return df.withColumn(name, canonical(F.col(raw)))
    keys = df.select(raw).where(F.col(raw).isNotNull()).distinct().withColumn(name, canonical(F.col(raw)))
    return df.join(keys, raw, "left")


def observed_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """Per key the sorted set of labels seen, ``unknown`` never among them."""
    pairs = df.select(key, known_label(normalise_label(label)).alias("_label")).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set("_label")).alias("labels"))


def _label_evidence(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that have an unlabelled row and exactly one label, with that label."""
    tidy = normalise_label(label)
    known = known_label(tidy)
    return (
        df.groupBy(key)
        .agg(F.min(known).alias("_only"), F.max(known).alias("_last"), F.bool_or(tidy == UNKNOWN_LABEL).alias("_asks"))
        .where(F.col("_asks") & (F.col("_only") == F.col("_last")))
        .select(key, "_only")
    )


def resolve_labels(df: DataFrame, key: str, label: str, name: str = "resolved_label", *, scan_again: bool = True) -> DataFrame:
    """An unknown label takes the only label its key carries anywhere in the table.

    The evidence is a map-side combined min/max: one row per key, whatever its
    size.  With ``scan_again`` the labelled rows, usually nearly all, bypass the
    join and are never shuffled; pass ``False`` where reading ``df`` twice more
    costs more than moving it.  Hot keys are split by the adaptive skew join.
    """
    tidy = normalise_label(label)
    evidence = _label_evidence(df, key, label)
    filled = F.coalesce("_only", F.lit(UNKNOWN_LABEL))
    if not scan_again:
        joined = df.join(evidence, key, "left")
        return joined.select(*df.columns, F.when(tidy == UNKNOWN_LABEL, filled).otherwise(tidy).alias(name))
    known = df.where(tidy != UNKNOWN_LABEL).withColumn(name, tidy)
    unknown = df.where(tidy == UNKNOWN_LABEL).join(evidence, key, "left").select(*df.columns, filled.alias(name))
    return known.unionByName(unknown)


def with_identity(
    df: DataFrame, *, raw: str, second: str, label: str,
    canonical: Callable[[Column], Column] = plain_structure_key, expensive: bool = False,
) -> DataFrame:
    """In-scope rows with ``structure_key``, ``resolved_label`` and ``candidate_id``."""
    keyed = with_structure_key(in_scope(df, second), raw, canonical=canonical, expensive=expensive)
    usable = keyed.where(F.col("structure_key").isNotNull())
    resolved = resolve_labels(usable, "structure_key", label, scan_again=not expensive)
    return resolved.withColumn("candidate_id", content_id("structure_key", "resolved_label"))


def label_frequency(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, most frequent first, ties by label."""
    counted = df.groupBy(normalise_label(label).alias("label")).agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), "label")


def _labels_per_key(df: DataFrame, key: str, label: str) -> DataFrame:
    tidy = normalise_label(label)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(known_label(tidy)).alias("first"),
        F.max(known_label(tidy)).alias("last"),
        F.bool_or(tidy == UNKNOWN_LABEL).alias("has_unknown"),
    )


def multi_label_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys under several labels, with and without ``unknown``, and unknown twins of labelled keys."""
    several = F.coalesce(F.col("first") != F.col("last"), F.lit(False))
    twin = F.col("has_unknown") & F.col("first").isNotNull()
    return _labels_per_key(df, key, label).agg(
        F.count_if(several | twin).alias("with_unknown"),
        F.count_if(several).alias("without_unknown"),
        F.count_if(twin).alias("unknown_twins"),
    )


def unknown_twin_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that occur both without a label and with one."""
    tidy = normalise_label(label)
    present = df.where(F.col(key).isNotNull())
    unknown = present.where(tidy == UNKNOWN_LABEL).select(key)
    return unknown.intersect(present.where(tidy != UNKNOWN_LABEL).select(key))


def with_source_label(resolved: DataFrame, source: DataFrame, *, index: str, label: str) -> DataFrame:
    """Bring back the label as read, for a table that only kept the resolved one."""
    return resolved.join(source.select(index, F.col(label).alias("source_label")), index)


def label_resolution_audit(resolved: DataFrame, *, key: str, label: str) -> DataFrame:
    """Outcome of every in-scope row whose source label was empty: ``outcome, n``.

    ``resolved`` carries the label as read beside ``resolved_label``, so nothing
    is joined.  The outcome ``unknown`` counts the unresolved rows; the outcomes
    sum to the empty rows.
    """
    tidy = normalise_label(label)
    empty = resolved.where(tidy == UNKNOWN_LABEL)
    outcomes = empty.groupBy(F.col("resolved_label").alias("outcome")).agg(F.count("*").alias("n"))
    several = (
        resolved.groupBy(key)
        .agg(F.min(known_label(tidy)).alias("first"), F.max(known_label(tidy)).alias("last"))
        .agg(F.count_if(F.col("first") != F.col("last")).alias("n"))
        .select(F.lit("(keys with several labels)").alias("outcome"), "n")
    )
    total = empty.agg(F.count("*").alias("n")).select(F.lit("(empty rows)").alias("outcome"), "n")
    return outcomes.unionByName(total).unionByName(several)


def raw_merges(df: DataFrame, raw: str, key: str) -> DataFrame:
    """Distinct raw texts, distinct structure keys and how many texts merged."""
    counts = df.agg(F.count_distinct(raw).alias("raw_texts"), F.count_distinct(key).alias("structure_keys"))
    return counts.withColumn("merged", F.col("raw_texts") - F.col("structure_keys"))
