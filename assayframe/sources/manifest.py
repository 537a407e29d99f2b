"""File manifests: parse the text, hash the files, report verified / mismatch / absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: ``<sha256>  <size_bytes>  <filename>`` and the revision comment.
ENTRY_PATTERN = r"\A\s*([0-9a-f]{64})\s+([0-9]+)\s+(\S.*?)\s*\z"
REVISION_PATTERN = r"\A\s*#\s*revision:\s*(.*?)\s*\z"


def parse_manifest(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """Manifest text (column ``value``) to ``name, sha256, n_bytes, malformed``.

    A malformed line, one of another form or for a file without a byte, fails the
    job; unless ``strict``, it is marked, with as much of it as can be read.
    """
    text = F.col("value")
    content = lines.where((F.trim(text) != "") & ~F.ltrim(text).startswith("#"))
    size = F.regexp_extract(text, ENTRY_PATTERN, 2).try_cast("bigint")
    sound = F.coalesce(text.rlike(ENTRY_PATTERN) & (size > 0), F.lit(False))
    name = F.regexp_extract(text, ENTRY_PATTERN, 3)
    if strict:
        name = F.when(sound, name).otherwise(F.raise_error(F.concat(F.lit("malformed manifest line: "), text)))
    return content.select(name.alias("name"), F.regexp_extract(text, ENTRY_PATTERN, 1).alias("sha256"), size.alias("n_bytes"), (~sound).alias("malformed"))


def manifest_revision(lines: DataFrame) -> DataFrame:
    """One row with the revision comment of the manifest, NULL when it has none."""
    return lines.agg(
        F.max(F.when(F.col("value").rlike(REVISION_PATTERN), F.regexp_extract("value", REVISION_PATTERN, 1))).alias("revision")
    )


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``name, sha256, n_bytes`` of every file under ``path``; each file is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("n_bytes"),
    )


def audit_files(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of every manifest entry; all entries are checked, none stops the audit."""
    seen = observed.select("name", F.col("sha256").alias("seen_sha256"), F.col("n_bytes").alias("seen_bytes"))
    same = (F.col("sha256") == F.col("seen_sha256")) & (F.col("n_bytes") == F.col("seen_bytes"))
    status = F.when(F.col("malformed"), "malformed").when(F.col("seen_sha256").isNull(), "absent").when(same, "verified").otherwise("mismatch")
    return manifest.join(seen, "name", "left").withColumn("status", status).drop("malformed")
