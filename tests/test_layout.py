"""Tables clustered on several columns."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayframe.sources import layout

ROWS = 60_000


@pytest.fixture(scope="module")
def rows(spark):
    """Two unrelated columns; one key holds a third of the rows, some keys and values are missing or no number."""
    hashed = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000))
    key = F.when(F.pmod("id", F.lit(3)) == 0, "k5000").when(F.pmod("id", F.lit(97)) == 0, None).otherwise(F.format_string("k%04d", hashed(1)))
    value = F.when(F.pmod("id", F.lit(101)) == 0, float("nan")).when(F.pmod("id", F.lit(103)) == 0, None).otherwise(hashed(2) / 10)
    return spark.range(ROWS).select("id", key.alias("key"), value.cast("double").alias("value"))


def groups_meeting(folder: Path, column: str, low, high) -> tuple[int, int]:
    """Row groups whose statistics meet the range, and all."""
    met = count = 0
    for file in folder.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = meta.schema.to_arrow_schema().get_field_index(column)
        for group in range(meta.num_row_groups):
            found = meta.row_group(group).column(place).statistics
            count += 1
            known = found is not None and found.has_min_max and found.min == found.min and found.max == found.max  # a NaN hides the others
            met += not known or (found.min <= high and found.max >= low)
    return met, count


def rows_scanned(df) -> int:
    """Rows that the Parquet scan handed on while ``df`` was collected."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_each_column_skips_row_groups(spark, rows, tmp_path):
    spread = rows.repartition(40)
    spread.write.parquet(str(tmp_path / "plain"))
    held = layout.write_clustered(spread, str(tmp_path / "clustered"), ["key", "value"], 40)
    assert held.exceptAll(rows).count() == 0 and held.count() == ROWS
    for column, low, high in (("key", "k2000", "k2100"), ("value", 300.0, 320.0)):
        met, count = groups_meeting(tmp_path / "clustered", column, low, high)
        plain, of = groups_meeting(tmp_path / "plain", column, low, high)
        assert plain == of and met <= 0.5 * count, (column, met, count)
        window = F.col(column).between(low, high)
        seen = rows_scanned(held.where(window).select("id"))
        assert seen <= 0.5 * ROWS < rows_scanned(spark.read.parquet(str(tmp_path / "plain")).where(window).select("id"))
        assert held.where(window).count() == rows.where(window).count()
    sizes = [pq.ParquetFile(file).metadata.num_rows for file in (tmp_path / "clustered").glob("*.parquet")]
    assert max(sizes) <= 3 * ROWS / 40  # the key with a third of the rows fills several files


def test_odd_tables(spark, rows, tmp_path):
    none = layout.write_clustered(rows.limit(0), str(tmp_path / "none"), ["key", "value"], 4)
    assert none.count() == 0 and none.columns == rows.columns
    missing = rows.limit(50).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), "id")
    assert layout.write_clustered(missing, str(tmp_path / "missing"), ["key", "value"], 4).count() == 50
    dated = spark.createDataFrame([("2020-01-01",), (None,), ("1950-06-01",)], "day string").select(F.col("day").cast("date"))
    assert layout.write_clustered(dated, str(tmp_path / "dated"), ["day"], 2).count() == 3


def test_bits_are_interleaved(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    found = pairs.select("a", "b", layout.interleaved([F.col("a"), F.col("b")], 3).alias("z")).collect()
    for row in found:
        bits = "".join(x + y for x, y in zip(f"{row['a']:03b}", f"{row['b']:03b}", strict=True))
        assert row["z"] == int(bits, 2)
