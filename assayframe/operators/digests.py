"""Comparing two very large tables by a tree of digests.

Every row has a 256-bit hash of its whole content.  Rows are placed in ranges of
the hash of their key; the digest of a range is the sum of its rows' hashes, so
it does not depend on their order, counts repeated rows, and the digest of a
wider range is the sum of its parts.  A table is stored once, laid out by these
ranges, with its tree of digests beside it.

Two stored tables are compared from the root down: only ranges whose digests
differ are descended into, and only the rows of the differing leaves are read and
joined.  Equal tables cost one row of each tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.sources.storage import shuffles_dropped, write_shared

# Bits by which the tree widens per level, rows a leaf should hold, and folders that the rows are laid out in.
LEVEL_BITS, LEAF_ROWS, MOST_FOLDERS = 4, 512, 256
LIMBS = 8
SLOT, FOLDER = "_slot", "_folder"
SIMPLE = ("string", "tinyint", "smallint", "int", "bigint", "double", "float", "boolean", "date", "timestamp", "decimal")


class Stored(NamedTuple):
    """A stored table: where, of which shape, with which columns."""

    path: str
    shape: Shape
    schema: T.StructType


class Shape(NamedTuple):
    """Bits of a leaf's number, and of a folder's, which are its first ones."""

    leaf_bits: int
    folder_bits: int

    @classmethod
    def for_rows(cls, rows: int, leaf_rows: int = LEAF_ROWS) -> Shape:
        leaves = max(0, math.ceil(math.log2(max(1, rows / leaf_rows))))
        return cls(leaves, min(leaves, MOST_FOLDERS.bit_length() - 1))

    def levels(self) -> list[int]:
        """Bits of the node numbers per level, from the root to the leaves."""
        return sorted({0, *range(self.leaf_bits, 0, -LEVEL_BITS)})


def _is_simple(kind: str) -> bool:
    return kind.split("(")[0] in SIMPLE


def _content(columns: Sequence[str], kinds: dict[str, str]) -> Column:
    """One text per row content: lengths keep neighbouring columns apart, and -0.0 counts as 0.0 as it does in a join."""
    parts = []
    for name in columns:
        value = F.col(name) + F.lit(0.0) if kinds[name] in ("double", "float") else F.col(name)
        text = value.cast("string") if _is_simple(kinds[name]) else F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts) if parts else F.lit("")


def _limbs(digest: Column) -> list[Column]:
    """A SHA-256 in hexadecimal as eight numbers of 32 bits, whose sums cannot overflow below 2^31 rows a range."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"d{i}") for i in range(LIMBS)]


def store(df: DataFrame, key: Sequence[str], path: str, shape: Shape | None = None) -> Stored:
    """Write ``path/rows``, laid out by ranges of the key's hash, and ``path/tree`` (bits, node, n, d0 … d7).

    A table that is to be compared with a stored one takes over its ``shape``.
    """
    written = df
    if shape is None:
        written = write_shared(df, "digest-rows")
        shape = Shape.for_rows(written.count())
    # 62 bits of the key's hash, of which the first ones number the leaf.
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(name) for name in key]), 2)
    slot = F.shiftright(hashed, 62 - shape.leaf_bits)
    # Ranges of leaves, and so of folders: a folder with many rows is written by several tasks, and row groups know their leaves.
    rows = written.repartitionByRange(slot, *key).withColumn(SLOT, slot).withColumn(FOLDER, F.shiftright(SLOT, shape.leaf_bits - shape.folder_bits))
    with shuffles_dropped(df.sparkSession):
        rows.sortWithinPartitions(FOLDER, SLOT).write.partitionBy(FOLDER).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    kinds = dict(df.dtypes)
    digest = F.sha2(_content(sorted(df.columns), kinds), 256)
    names = [f"d{i}" for i in range(LIMBS)]
    sums = [F.sum(name).alias(name) for name in names]
    leaves = stored.select(SLOT, digest.alias("_digest")).select(SLOT, *_limbs(F.col("_digest"))).groupBy(F.col(SLOT).alias("node")).agg(F.count("*").alias("n"), *sums)
    with shuffles_dropped(df.sparkSession):
        leaves.select(F.lit(shape.leaf_bits).alias("bits"), "node", "n", *names).write.partitionBy("bits").parquet(f"{path}/tree")
    below = shape.leaf_bits
    for bits in sorted(set(shape.levels()) - {shape.leaf_bits}, reverse=True):
        level = read_level(df.sparkSession, path, below)
        up = level.groupBy(F.shiftright("node", below - bits).alias("node")).agg(F.sum("n").alias("n"), *sums)
        up.select(F.lit(bits).alias("bits"), "node", "n", *names).write.mode("append").partitionBy("bits").parquet(f"{path}/tree")
        below = bits
    return Stored(path, shape, rows.schema)


def read_level(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """(node, n, d0 … d7) of one level of a stored tree."""
    spec = "node long, n long, " + ", ".join(f"d{i} long" for i in range(LIMBS)) + ", bits int"
    return spark.read.schema(spec).parquet(f"{path}/tree").where(F.col("bits") == bits).drop("bits")


def differing_leaves(spark: SparkSession, one: Stored, other: Stored) -> DataFrame:
    """(node) of the leaves whose digests differ, found from the root down: a level below an equal range is never looked at."""
    if one.shape != other.shape:
        raise ValueError(f"tables of different shapes: {one.shape} and {other.shape}")
    wanted, above = None, 0
    for bits in one.shape.levels():
        left, right = read_level(spark, one.path, bits), read_level(spark, other.path, bits)
        if wanted is not None:
            left, right = (side.join(wanted, F.shiftright(side["node"], bits - above) == wanted["_parent"], "left_semi") for side in (left, right))
        same = [F.col("n"), *[F.col(f"d{i}") for i in range(LIMBS)]]
        both = left.select("node", F.struct(*same).alias("a")).join(right.select("node", F.struct(*same).alias("b")), "node", "full")
        # One row per differing range; written, because each level starts from it.
        wanted = write_shared(both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("node").alias("_parent")), f"digest-level-{bits}")
        above = bits
        if wanted.isEmpty():
            break
    return wanted.select(F.col("_parent").alias("node"))


def rows_in_doubt(table: Stored, leaves: DataFrame) -> DataFrame:
    """The stored rows of the given leaves; other folders are not opened."""
    rows = leaves.sparkSession.read.schema(table.schema).parquet(f"{table.path}/rows")
    drop = table.shape.leaf_bits - table.shape.folder_bits
    folders = [row["f"] for row in leaves.select(F.shiftright("node", drop).alias("f")).distinct().collect()]  # at most MOST_FOLDERS
    chosen = rows.where(F.col(FOLDER).isin(folders)) if folders else rows.where(F.lit(False))
    few = [row["node"] for row in leaves.limit(MOST_FOLDERS + 1).collect()]
    if len(few) <= MOST_FOLDERS:  # a literal list reaches the statistics of the row groups
        return chosen.where(F.col(SLOT).isin(few)) if few else chosen
    return chosen.join(leaves, F.col(SLOT) == leaves["node"], "left_semi")


def differences(spark: SparkSession, one: Stored, other: Stored, key: Sequence[str], *, tolerance: float = 0.0) -> DataFrame:
    """``key``, ``column`` and both values as text (``stored``, ``computed``) where two stored tables differ.

    A row that one side lacks has the column ``(row)``.  Rows of one key are a
    bag: equal rows cancel, and what is left on both sides is compared in the
    order of its content.  Doubles within ``tolerance`` of each other are equal.
    """
    leaves = differing_leaves(spark, one, other)
    names = [name for name in one.schema.names if name not in (*key, SLOT, FOLDER)]
    kinds = {field.name: field.dataType.simpleString() for field in one.schema}
    everything = sorted([*key, *names])
    # Bags: each content with its count, so a key that repeats a row millions of times is one row here.  Plain values are their
    # own content and move without a hash, which is larger than they are.
    plain = all(_is_simple(kinds[name]) for name in everything)
    same = names if plain else ["_hash"]
    sides = []
    for stored, sign in ((one, 1), (other, -1)):
        hashed = [] if plain else [F.sha2(_content(everything, kinds), 256).alias("_hash")]
        sides.append(rows_in_doubt(stored, leaves).select(*key, *names, *hashed, F.lit(sign).alias("_sign")))
    kept = [] if plain else [F.first(name).alias(name) for name in names]
    bags = sides[0].unionByName(sides[1]).groupBy(*key, *same).agg(F.sum("_sign").alias("_left"), *kept)
    surplus = bags.where("_left <> 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_left"))))
    order = Window.partitionBy(*key, "_side").orderBy(*names, "_copy")
    surplus = surplus.withColumn("_side", F.col("_left") > 0).withColumn("_place", F.row_number().over(order))

    def side(kept: Column, mark: str) -> DataFrame:
        return surplus.where(kept).select(*[F.col(k).alias(f"{mark}{k}") for k in key], F.col("_place").alias(f"{mark}place"), *[F.col(n).alias(f"{mark}{n}") for n in names])

    left, right = side(F.col("_side"), "_s_"), side(~F.col("_side"), "_c_")
    met = F.col("_s_place") == F.col("_c_place")
    for name in key:
        met = met & F.col(f"_s_{name}").eqNullSafe(F.col(f"_c_{name}"))
    joined = left.join(right, met, "full")
    alone = F.col("_s_place").isNull() | F.col("_c_place").isNull()
    found = [F.when(alone, F.struct(F.lit("(row)").alias("column"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("computed")))]
    for name in names:
        a, b = F.col(f"_s_{name}"), F.col(f"_c_{name}")
        same = a.eqNullSafe(b)
        if kinds[name] in ("double", "float"):
            same = same | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))
        shown = F.struct(F.lit(name).alias("column"), a.cast("string").alias("stored"), b.cast("string").alias("computed"))
        found.append(F.when(~alone & ~same, shown))
    keys = [F.when(F.col("_s_place").isNotNull(), F.col(f"_s_{name}")).otherwise(F.col(f"_c_{name}")).alias(name) for name in key]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_d")).select(*key, "_d.*")
