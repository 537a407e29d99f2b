"""Exact order statistics and running aggregates that survive a hot group.

A window or ``percentile`` over a key puts the whole key into one task.  That is
fine while the key is known to be small and fatal when it holds a third of a
very large table.  Every function here therefore has two exact ways:

* where a proven upper bound of the input rows (``rows_bound``) or a counted
  group size allows it: one window or one ``percentile``;
* otherwise the ordered values of a key are cut into chunks, each chunk is
  aggregated on its own and the chunks are stitched together.

Cut points come from an approximate sketch.  They decide only how evenly the work spreads;
results are the same for any cut points.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions.columns import case
from assayframe.sources.storage import cut_lineage, write_shared

# Rows of one group that a single task may order (it can still spill).
TASK_ROWS = 4_000_000
# Rows of one group up to which ``percentile`` may keep its values in a map, and the most
# larger groups that are worth telling apart from the rest.
HOT_ROWS = 1_000_000
MOST_HOT_GROUPS = 100_000
# Buckets of groups that are counted first: if none of them is larger than a large group, no group is.
SIZE_BUCKETS = 1 << 14
# Rows up to which one ``percentile`` over a whole table beats the search for its rank.
PERCENTILE_ROWS = 100_000
# Least pieces that the values of a column are cut into, the accuracy of the sketch that places the cuts, and the most
# cuts that are searched by nested comparisons.
MIN_PIECES = 128
MOST_BRANCHES = 1024
SKETCH_ACCURACY = 2_000
# Rows of a part whose rows are brought together by key.
PLACE_ROWS = 1_000_000
# Width of a chunk over integer positions: a chunk holds at most this many distinct positions.
POSITION_WIDTH = 1_000_000

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def fits_one_task(rows_bound: int | None) -> bool:
    """Whether a proven bound allows the single-task way."""
    return rows_bound is not None and rows_bound <= TASK_ROWS


def fits_one_map(rows_bound: int | None) -> bool:
    """Whether a proven bound lets ``percentile`` hold any single group."""
    return rows_bound is not None and rows_bound <= HOT_ROWS


def percentile_pays(rows_bound: int | None) -> bool:
    """Whether a proven bound makes ``percentile`` over the whole table the cheaper way."""
    return rows_bound is not None and rows_bound <= PERCENTILE_ROWS


def cut_points(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Ascending cut points that spread each column evenly, all from one mergeable sketch pass.

    There are as many as keep every chunk within a task, however the values
    cluster; only rows of one and the same value cannot be cut, and those
    collapse to one row with a count before they are ordered.
    """
    pieces = max(MIN_PIECES, math.ceil(2 * df.count() / TASK_ROWS))
    grid = [i / pieces for i in range(pieces + 1)]
    found = df.agg(*[F.percentile_approx(name, grid, max(SKETCH_ACCURACY, 16 * pieces)).alias(f"q_{name}") for name in columns]).first()
    return {name: sorted(set(found[f"q_{name}"] or [])) for name in columns}


def chunk_of(column: Column, points: Sequence) -> Column:
    """Chunk number of a value, monotone in the value: a balanced tree of comparisons, or a vectorised search for very many points."""
    if len(points) > MOST_BRANCHES:
        ordered = np.array(points)

        @F.pandas_udf("int")
        def search(values: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(ordered, values.to_numpy(), side="right")).where(values.notna().to_numpy()).astype("Int32")

        return search(column)

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(points[middle]), branch(low, middle)).otherwise(branch(middle + 1, high))

    return branch(0, len(points))


def together(df: DataFrame, keys: Sequence[str], rows_bound: int) -> DataFrame:
    """The rows of a key in one place, in parts of about ``PLACE_ROWS`` rows, so that what unfolds from a part can be ordered in memory."""
    parts = math.ceil(rows_bound / PLACE_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def position_chunk(column: str | Column) -> Column:
    """Chunk of an integer position."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(POSITION_WIDTH)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Mapping[str, tuple[str, Column]],
    *,
    chunk: Column | None,
    inclusive: bool = True,
    totals: Sequence[str] = (),
) -> DataFrame:
    """Add one running aggregate per measure over ``order`` within ``keys``.

    ``measures`` maps an output name to ``(sum | max | min, input)``.  ``chunk``
    is monotone in ``order``; with ``None`` each key is one window.  With
    ``inclusive=False`` the current row is left out.  A name in ``totals`` also
    gets ``<name>_all``, the aggregate over the whole key.
    """
    last = Window.currentRow if inclusive else -1
    prepared = df.select("*", *[value.alias(f"_in_{name}") for name, (_, value) in measures.items()])
    if chunk is None:
        whole = Window.partitionBy(*keys)
        ordered = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        out = {name: _COMBINE[how](f"_in_{name}").over(ordered) for name, (how, _) in measures.items()}
        out |= {f"{name}_all": _COMBINE[measures[name][0]](f"_in_{name}").over(whole) for name in totals}
        return prepared.withColumns(out).drop(*[f"_in_{name}" for name in measures])

    # A struct key equals another one member by member, NULLs included, so no row is lost.
    prepared = prepared.withColumn("_place", F.struct(*[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)], chunk.alias("chunk")))
    per_chunk = prepared.groupBy("_place").agg(
        *[_COMBINE[how](f"_in_{name}").alias(f"_sum_{name}") for name, (how, _) in measures.items()]
    )
    whole = Window.partitionBy(*[f"_place.k{i}" for i in range(len(keys))])
    earlier = whole.orderBy("_place.chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        "_place",
        *[_COMBINE[how](f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name, (how, _) in measures.items()],
        *[_COMBINE[measures[name][0]](f"_sum_{name}").over(whole).alias(f"{name}_all") for name in totals],
    )
    inside = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = prepared.join(carried, "_place")
    out = {}
    for name, (how, _) in measures.items():
        local = _COMBINE[how](f"_in_{name}").over(inside)
        carry = F.col(f"_carry_{name}")
        if how == "sum":
            out[name] = F.coalesce(carry + local, carry, local)
        else:
            out[name] = (F.greatest if how == "max" else F.least)(carry, local)
    helpers = [f"{part}_{name}" for name in measures for part in ("_in", "_carry")]
    return joined.withColumns(out).drop("_place", *helpers)


# Bits of a double that one scan decides, and entries of a histogram that a task holds before it compacts them.
RADIX_BITS, HELD_BINS = 16, 1 << 19
# Rows of an Arrow batch that a task hands back.
ENTRY_ROWS = 10_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """The bits of doubles as unsigned integers in the order of the values; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def value_of_bits(bits: int) -> float:
    """The double that ``ordered_bits`` turned into ``bits``."""
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def _compacted(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Entries (group, bin, n, low, high) with one per group and bin."""
    group, bins, n, low, high = (np.concatenate(some) for some in zip(*parts, strict=True))
    key, at = np.unique(group.astype(np.int64) << RADIX_BITS | bins, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    least, most = np.full(len(key), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(key), np.uint64)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    return [(key >> RADIX_BITS, key & (1 << RADIX_BITS) - 1, total, least, most)]


def _histogram(df: DataFrame, groups: Sequence[tuple[str, int]], level: int) -> DataFrame:
    """(group, bin, n, low, high): how many values of a column begin with the group's prefix, by their next ``RADIX_BITS`` bits.

    ``groups`` are (column, prefix); a prefix has ``level * RADIX_BITS`` bits.
    ``low`` and ``high`` are the least and greatest value of a bin, as bits.
    One scan serves all groups, and a task holds a bounded histogram, whatever the values.
    """
    columns = sorted({column for column, _ in groups})
    wanted = {column: sorted((prefix, place) for place, (source, prefix) in enumerate(groups) if source == column) for column in columns}
    shift = np.uint64(64 - RADIX_BITS * (level + 1))
    mask = np.uint64((1 << RADIX_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for column in columns:
                bits = ordered_bits(np.asarray(batch.column(column).drop_null(), dtype=np.float64))
                if level:
                    prefixes = np.array([prefix for prefix, _ in wanted[column]], np.uint64)
                    places = np.array([place for _, place in wanted[column]], np.int64)
                    mine = bits >> (shift + np.uint64(RADIX_BITS))
                    at = np.minimum(np.searchsorted(prefixes, mine), len(prefixes) - 1)
                    inside = prefixes[at] == mine
                    bits, group = bits[inside], places[at[inside]]
                else:
                    group = np.full(len(bits), wanted[column][0][1], np.int64)
                if len(bits):
                    one = _compacted([(group, (bits >> shift & mask).astype(np.int64), np.ones(len(bits)), bits, bits)])[0]
                    parts.append(one)
                    held += len(one[0])
            if held > HELD_BINS:
                parts = _compacted(parts)
                held = len(parts[0][0])
        if parts:
            group, bins, n, low, high = _compacted(parts)[0]
            # Unsigned bits travel as long, moved so that their order stays.
            moved = [(x ^ np.uint64(1 << 63)).view(np.int64) for x in (low, high)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), pa.array(bins, pa.int32()), pa.array(n, pa.int64()), *[pa.array(x, pa.int64()) for x in moved]],
                names=["group", "bin", "n", "low", "high"],
            )

    parts = df.select(*[F.col(column).cast("double").alias(column) for column in columns]).mapInArrow(count, "group int, bin int, n long, low long, high long")
    return parts.groupBy("group", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def values_at_ranks(df: DataFrame, spots: Mapping[str, Callable[[int], Iterable[int]]]) -> dict[str, dict[int, float]]:
    """Per column the values at the zero-based ranks that ``spots`` names for its number of values, in at most four scans of all columns.

    Radix selection: the first scan counts the values by their first 16 bits, in
    an order that follows the values; each further scan counts by the next 16
    bits, only below the bins that hold a wanted rank.  A bin of equal values
    ends its search at once.  Histograms are summed and searched in Spark; one
    row per rank comes back.
    """
    found: dict[str, dict[int, float]] = {column: {} for column in spots}
    # What is left to find: per (column, prefix) the ranks, counted from the first value with that prefix, and their real ranks.
    todo: dict[tuple[str, int], dict[int, int]] = {(column, 0): {} for column in spots}
    for level in range(64 // RADIX_BITS):
        groups = sorted(todo)
        bins = cut_lineage(_histogram(df, groups, level))
        if level == 0:
            sizes = {row["group"]: row["n"] for row in bins.groupBy("group").agg(F.sum("n").alias("n")).collect()}
            for place, (column, prefix) in enumerate(groups):
                todo[column, prefix] = {rank: rank for rank in (spots[column](sizes[place]) if place in sizes else ())}
        ranks = [(place, rank) for place, group in enumerate(groups) for rank in todo[group]]
        if not ranks:
            break
        asked = df.sparkSession.createDataFrame(ranks, "group int, rank long")
        # A group has at most 65,536 bins.
        upto = F.sum("n").over(Window.partitionBy("group").orderBy("bin"))
        placed = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        hits = placed.join(asked, "group").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))).collect()
        later: dict[tuple[str, int], dict[int, int]] = {}
        for row in hits:
            column, prefix = groups[row["group"]]
            real = todo[column, prefix][row["rank"]]
            if row["low"] == row["high"]:
                found[column][real] = value_of_bits((row["low"] + (1 << 64)) % (1 << 64) ^ 1 << 63)
            else:
                later.setdefault((column, prefix << RADIX_BITS | row["bin"]), {})[row["rank"] - row["before"]] = real
        todo = later
        if not todo:
            break
    return found


def _percentiles(wanted: Mapping[str, tuple[str, float]]) -> tuple[list[Column], list[Column]]:
    """Aggregates and result columns; quantiles of one column share its value map."""
    columns = sorted({column for column, _ in wanted.values()})
    mine = {column: [(name, q) for name, (source, q) in wanted.items() if source == column] for column in columns}
    aggregates = [F.percentile(c, F.array(*[F.lit(float(q)) for _, q in mine[c]])).alias(f"_q_{c}") for c in columns]
    results = {name: F.col(f"_q_{c}")[i].alias(name) for c in columns for i, (name, _) in enumerate(mine[c])}
    return aggregates, [results[name] for name in wanted]


def quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], *, rows_bound: int | None = None
) -> DataFrame:
    """One row with an exact, linearly interpolated quantile per entry of ``wanted``: ``(column, probability)`` by output name."""
    if percentile_pays(rows_bound):
        aggregates, results = _percentiles(wanted)
        return df.agg(*aggregates).select(*results)
    mine = {column: {name: q for name, (source, q) in wanted.items() if source == column} for column in sorted({column for column, _ in wanted.values()})}
    sizes: dict[str, int] = {}

    def ranks_of(column: str) -> Callable[[int], set[int]]:
        def ranks(n: int) -> set[int]:
            sizes[column] = n
            return {place for q in mine[column].values() for place in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}

        return ranks

    values = values_at_ranks(df, {column: ranks_of(column) for column in mine})
    results: dict[str, float | None] = {}
    for column, names in mine.items():
        for name, q in names.items():
            if column not in sizes:
                results[name] = None
                continue
            spot = q * (sizes[column] - 1)
            low, high = values[column][math.floor(spot)], values[column][math.ceil(spot)]
            results[name] = low if low == high else low + (high - low) * (spot - math.floor(spot))
    return df.sparkSession.range(1).select(
        *[F.lit(results[name]).cast("double").alias(name) for name in wanted]
    )


class Split(NamedTuple):
    """The rows of small groups and of large ones; ``None`` for a side without rows."""

    calm: DataFrame | None
    hot: DataFrame | None


def split_by_group_size(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None, *, sized: DataFrame | None = None) -> Split:
    """Tell groups of more than ``hot_rows`` rows from the rest, by one narrow count.

    Buckets of groups are counted before anything moves; groups are counted only if a bucket may hold a large one.
    ``sized`` may stand in for ``df`` in the count: rows with the same keys that
    are cheaper to read and at least as many per group.  The large groups are named in a broadcast, which their number allows: there
    are at most ``MOST_HOT_GROUPS``, or else all rows count as hot.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if limit <= 0:
        return Split(None, df)
    counted = df if sized is None else sized
    buckets = counted.groupBy(F.pmod(F.xxhash64(*keys), F.lit(SIZE_BUCKETS)).alias("_bucket")).agg(F.count("*").alias("_n"))
    if (buckets.agg(F.max("_n")).first()[0] or 0) <= limit:
        return Split(df, None)
    sizes = counted.groupBy(*[F.col(key).alias(f"_hot_{key}") for key in keys]).agg(F.count("*").alias("_n"))
    large = cut_lineage(sizes.where(F.col("_n") > limit).drop("_n"))
    n = large.count()
    if n == 0:
        return Split(df, None)
    if n > MOST_HOT_GROUPS:
        return Split(None, df)
    named = F.broadcast(large)
    same = [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    return Split(df.join(named, same, "left_anti"), df.join(named, same, "left_semi"))


def running_by_size(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], measures: Mapping[str, tuple[str, Column]], *, chunk: Column,
    rows_bound: int | None, sized: DataFrame | None = None,
) -> DataFrame:
    """``running`` for keys of any size: one window a key, chunks only for the keys that a count finds large."""
    if fits_one_task(rows_bound):
        return running(df, keys, order, measures, chunk=None)
    calm, hot = split_by_group_size(df, keys, sized=sized)
    parts = [running(part, keys, order, measures, chunk=how) for part, how in ((calm, None), (hot, chunk)) if part is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def group_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], *, rows_bound: int | None = None,
    hot_rows: int | None = None, split: Split | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key; ``wanted`` maps a name to ``(column, probability)``, ``split`` tells large keys if that is known.

    A key without any value may be absent.  Small groups use ``percentile``, the
    rows of large ones (more than ``hot_rows``, normally ``HOT_ROWS``) are ranked
    in chunks.
    """
    aggregates, results = _percentiles(wanted)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*aggregates).select(*keys, *results)

    if fits_one_map(rows_bound):
        return plain(df)
    calm, hot = split_by_group_size(df, keys, hot_rows) if split is None else split
    if hot is None:
        return plain(calm)
    ranked = chunked_quantiles(hot, keys, wanted)
    return ranked if calm is None else plain(calm).unionByName(ranked)


def _chunk_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cuts: Mapping[str, list]) -> DataFrame:
    """(keys, _c, _chunk, _n, _low, _high): how many values of a key and a column lie in each chunk, with the least and the greatest.

    A task counts before anything moves, so a key sends at most one row per chunk
    and task's share however many rows it has, and it can be brought together by
    one shuffle, which serves all that follows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    values = [F.col(name).cast("double") + F.lit(0.0) for name in columns]  # -0.0 counts as 0.0
    # NaN is the greatest value and has a chunk of its own.
    chunks = [F.when(F.isnan(v), F.lit(len(cuts[name]) + 1)).otherwise(chunk_of(v, cuts[name])) for name, v in zip(columns, values, strict=True)]
    entry = [*names, "_c", "_chunk", "_n", "_low", "_high"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for place in range(len(columns)):
                mine = table.select([*names, f"_chunk{place}", f"_v{place}"]).rename_columns([*names, "_chunk", "_v"])
                mine = mine.filter(pc.is_valid(mine["_v"])).group_by([*names, "_chunk"], use_threads=False).aggregate([("_v", "count"), ("_v", "min"), ("_v", "max")])
                mine = mine.append_column("_c", pa.array(np.full(mine.num_rows, place), pa.int32()))
                # Built anew, because a column that never is null in one batch has another schema there.
                held.append(pa.Table.from_arrays(mine.select([*names, "_c", "_chunk", "_v_count", "_v_min", "_v_max"]).columns, names=entry))
                rows += mine.num_rows
            if rows > HELD_BINS:
                yield from summed(held).to_batches(max_chunksize=ENTRY_ROWS)
                held, rows = [], 0
        if held:
            yield from summed(held).to_batches(max_chunksize=ENTRY_ROWS)

    def summed(tables: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(tables).group_by([*names, "_c", "_chunk"], use_threads=False).aggregate([("_n", "sum"), ("_low", "min"), ("_high", "max")])
        return total.select([*names, "_c", "_chunk", "_n_sum", "_low_min", "_high_max"]).rename_columns(entry)

    kinds = {field.name: field.dataType.simpleString() for field in df.schema}
    spec = ", ".join(f"{name} {kinds[key]}" for name, key in zip(names, keys, strict=True)) + ", _c int, _chunk int, _n long, _low double, _high double"
    narrow = df.select(
        *[F.col(key).alias(name) for name, key in zip(names, keys, strict=True)],
        *[part for i, (v, chunk) in enumerate(zip(values, chunks, strict=True)) for part in (v.alias(f"_v{i}"), chunk.cast("int").alias(f"_chunk{i}"))],
    )
    parts = narrow.mapInArrow(count, spec).repartition(*names)
    counts = parts.groupBy(*names, "_c", "_chunk").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    unordered = case((F.col("_c") == i, F.lit(len(cuts[name]) + 1)) for i, name in enumerate(columns)) == F.col("_chunk")
    return counts.withColumns({side: F.when(unordered, F.lit(float("nan"))).otherwise(F.col(side)) for side in ("_low", "_high")})


def chunked_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Group quantiles from counts per chunk: a running count finds the chunk of a rank.

    The rank is the chunk's least or greatest value, or else the values of that
    chunk alone are ordered.
    """
    columns = sorted({column for column, _ in wanted.values()})
    cuts = cut_points(df, columns)
    names = [f"_k{i}" for i in range(len(keys))]
    whole = Window.partitionBy(*names, "_c")
    upto = F.sum("_n").over(whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = _chunk_counts(df, keys, columns, cuts).withColumns({"_upto": upto, "_all": F.sum("_n").over(whole)})
    picks, sides = [], []
    for name, (column, q) in wanted.items():
        spot = (F.col("_all") - 1) * F.lit(float(q))
        mine = F.col("_c") == columns.index(column)
        picks.append(F.max(F.when(mine, spot)).alias(f"_{name}_spot"))
        for side, rank in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            inside = rank - (F.col("_upto") - F.col("_n"))
            covers = mine & (inside >= 0) & (inside < F.col("_n"))
            known = F.when((inside == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).when(inside == F.col("_n") - 1, F.col("_high"))
            sides.append((f"_{name}_{side}", columns.index(column)))
            picks.append(F.max(F.when(covers, known)).alias(sides[-1][0]))
            picks.append(F.max(F.when(covers & known.isNull(), F.struct(F.col("_chunk").alias("chunk"), inside.alias("rank")))).alias(f"{sides[-1][0]}_in"))
    picked = write_shared(ranked.groupBy(*names).agg(*picks), "chunked-quantiles")
    spots = [F.struct(F.lit(i).alias("_side"), F.lit(c).alias("_c"), F.col(f"{side}_in.chunk").alias("_chunk"), F.col(f"{side}_in.rank").alias("_rank")) for i, (side, c) in enumerate(sides)]
    left = picked.select(*names, F.inline(F.array(*spots))).where(F.col("_chunk").isNotNull())
    n = left.count()
    if n:
        found = _within_chunks(df, keys, columns, cuts, F.broadcast(left) if n <= MOST_HOT_GROUPS else left)
        values = found.groupBy(*[F.col(name).alias(f"_of{name}") for name in names]).agg(*[F.max(F.when(F.col("_side") == i, F.col("_v"))).alias(f"{side}_v") for i, (side, _) in enumerate(sides)])
        same = [F.col(name).eqNullSafe(F.col(f"_of{name}")) for name in names]
        picked = picked.join(values, same, "left").withColumns({side: F.coalesce(side, f"{side}_v") for side, _ in sides})
    outputs = []
    for name in wanted:
        low, high, spot = F.col(f"_{name}_low"), F.col(f"_{name}_high"), F.col(f"_{name}_spot")
        outputs.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*[F.col(name).alias(key) for name, key in zip(names, keys, strict=True)], *outputs)


def _within_chunks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cuts: Mapping[str, list], asked: DataFrame) -> DataFrame:
    """(keys, _side, _v) for ``asked`` (keys, _side, _c, _chunk, _rank): the value at a rank of one key's values in one chunk of a column."""
    names = [f"_k{i}" for i in range(len(keys))]
    cells = [
        F.struct(F.lit(i).alias("_c_"), (F.col(name).cast("double") + F.lit(0.0)).alias("_v"), chunk_of(F.col(name).cast("double"), cuts[name]).cast("int").alias("_chunk_"))
        for i, name in enumerate(columns)
    ]
    rows = df.select(*[F.col(key).alias(f"_own{name}") for name, key in zip(names, keys, strict=True)], F.inline(F.array(*cells))).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    place = [*[F.col(f"_own{name}").eqNullSafe(F.col(name)) for name in names], F.col("_c_") == F.col("_c"), F.col("_chunk_") == F.col("_chunk")]
    # A chunk holds few enough distinct values for one task; a repeated one is one row.
    counted = rows.join(asked, place).groupBy(*names, "_side", "_rank", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*names, "_side").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_upto", upto).where((F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))).select(*names, "_side", "_v")
