"""Measurement tables: typed CSV scan, strict Parquet sinks, provenance and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions.columns import nan_to_null


class SourceError(ValueError):
    """A source that cannot be used: missing columns or foreign provenance."""


def require_columns(df: DataFrame, required: Sequence[str], what: str = "source") -> DataFrame:
    """``df`` unchanged, or an error naming every missing column; runs no job."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SourceError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def read_measurements_csv(
    spark: SparkSession, path: str, declared: Mapping[str, str], required: Sequence[str]
) -> DataFrame:
    """CSV scan: declared columns get their type, all others stay text, NaN becomes NULL."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required, path)
    types = {name: declared.get(name, "string") for name in header.columns}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    return nans_to_null(df)


def nans_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating column is a missing value."""
    floating = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({name: nan_to_null(name) for name in floating}) if floating else df


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Contiguous positions in source order, for a DataFrame straight from Parquet or text files.

    Files count in the order of their paths.  Parquet tells the place of a row
    in its file.  For other formats the blocks of a file count by their start,
    and the place inside a block is that of the scan.  One row per file or block
    is aggregated for the offsets, and they are broadcast, as the driver lists
    the files anyway: the rows themselves never move, and no file is one task's.
    """
    try:
        tagged = df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.lit(0).cast("long"), "_id": F.col("_metadata.row_index")})
    except AnalysisException:
        tagged = df.withColumns({
            "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id(),
        })
    blocks = tagged.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per file or block
    offsets = blocks.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    indexed = tagged.join(F.broadcast(offsets), ["_file", "_start"])
    return indexed.withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")).drop("_file", "_start", "_id", "_offset", "_first")


def load_accounting(df: DataFrame, second: str | Column, key: str | Column) -> DataFrame:
    """One row: source rows, rows excluded by reason, rows in scope, and whether they balance."""
    second = F.col(second) if isinstance(second, str) else second
    key = F.col(key) if isinstance(key, str) else key
    counted = df.agg(
        F.count("*").alias("source_rows"),
        F.count_if(second.isNotNull()).alias("excluded_second"),
        F.count_if(second.isNull() & key.isNull()).alias("excluded_reject"),
        F.count_if(second.isNull() & key.isNotNull()).alias("in_scope_rows"),
    )
    balance = F.col("source_rows") - F.col("excluded_second") - F.col("excluded_reject") == F.col("in_scope_rows")
    return counted.withColumn("balanced", balance)


def cast_declared(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Strict casts of the declared columns; a value that does not fit fails the job."""
    def strict(name: str) -> Column:
        source = F.col(name)
        if name not in declared:
            return source
        tried = source.try_cast(declared[name])
        complaint = F.concat(F.lit(f"column {name} does not hold {declared[name]}: "), source.cast("string"))
        return F.when(source.isNotNull() & tried.isNull(), F.raise_error(complaint).cast(declared[name])).otherwise(tried).alias(name)

    return df.select(*[strict(name) for name in df.columns])


def provenance_row(spark: SparkSession, facts: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([dict(facts)], T.StructType([T.StructField(k, T.StringType()) for k in facts]))


def write_table(df: DataFrame, path: str, declared: Mapping[str, str], facts: Mapping[str, str]) -> None:
    """Write the table with strict casts, its provenance as column metadata and as a side table."""
    typed = cast_declared(df, declared)
    first = typed.columns[0]
    typed = typed.withMetadata(first, {"provenance": dict(facts)})
    typed.write.mode("overwrite").parquet(path)
    provenance_row(df.sparkSession, facts).coalesce(1).write.mode("overwrite").parquet(f"{path}.provenance")


def provenance_of(df: DataFrame) -> dict[str, str]:
    """The provenance stored with a table, empty when there is none."""
    for field in df.schema.fields:
        if "provenance" in field.metadata:
            return dict(field.metadata["provenance"])
    return {}


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, where: str | None = None, **expected: str
) -> DataFrame:
    """Pruned Parquet scan with NaN as NULL, refused when a named provenance fact is not the expected one.

    ``where`` is a condition that a missing value does not pass.  It is pushed
    to the scan as it is, and holds again once NaN is missing; a condition set
    on the result instead cannot be pushed for floating columns.
    """
    raw = spark.read.parquet(path)
    found = provenance_of(raw)
    for fact, value in expected.items():
        if found.get(fact) != value:
            raise SourceError(f"{path}: {fact} is {found.get(fact)!r}, expected {value!r}")
    df = nans_to_null(raw if where is None else raw.where(where))
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*[name for name in columns if name in df.columns])
