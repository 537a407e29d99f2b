"""Tables clustered on several columns at once, so that a range of any of them skips most of the files' row groups.

Each column's values are cut into ranges of about equally many rows.  The bits
of the range numbers are interleaved, and rows are written in order of that
number: rows that are close in all columns lie together, and the statistics of
a row group are narrow in each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranges per column are two to this power; their cut points are all that reaches the driver.
BITS = 6
ACCURACY = 10_000


def measure_of(name: str, kind: str) -> Column:
    """A double that follows the order of the column as far as it can: text by its first six bytes, dates by their day, NaN as missing."""
    value = F.col(f"`{name}`")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_date(value.cast("date")).cast("double")
    if kind in ("string", "binary"):
        return F.conv(F.hex(F.rpad(F.substring(value.cast("binary"), 1, 6), F.lit(6), F.lit(b"\0"))), 16, 10).cast("double")
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def range_number(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cut points are at or below the value, as nested halves; 0 for a missing value."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """One number from the bits of several, the highest bit of each first."""
    parts = [
        F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(numbers) + len(numbers) - 1 - place)
        for place, number in enumerate(numbers) for bit in range(bits)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.bitwiseOR(part)
    return whole


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = BITS, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to ``path`` as about ``files`` Parquet files clustered on ``columns``; returns the table.

    ``files`` should follow the table's size.  Rows that are equal in all the
    columns are spread by a hash of the whole row, so one value with a third of
    all rows fills several files.  Missing values and NaN lie with the lowest,
    so only those row groups lose their statistics to a NaN.  The table is read three times: for the cut points, for the sort's sample and to
    be written.  ``group_bytes`` bounds a row group (Parquet's own default else).
    """
    kinds, steps = dict(df.dtypes), [i / 2**bits for i in range(1, 2**bits)]
    measures = {name: measure_of(name, kinds[name]) for name in columns}
    cuts = df.agg(*[F.percentile_approx(value, steps, ACCURACY).alias(name) for name, value in measures.items()]).first()
    numbers = [range_number(value, sorted(set(cuts[name] or []))) for name, value in measures.items()]
    order = [interleaved(numbers, bits), *[F.col(f"`{name}`") for name in columns], F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])]
    writer = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write
    (writer if group_bytes is None else writer.option("parquet.block.size", group_bytes)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
