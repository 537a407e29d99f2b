"""Hard negatives by Strassen multiplication of integer tiles.

Every usable row is quantised to whole numbers.  Rows are packed into tiles of a
few hundred vectors, sorted by label, and anchors into blocks of the same kind.
A block times a tile is one recursive Strassen product on int64, padded with
zeros to even sides, so all sums are exact.

Two rounds use it.  The first multiplies a block with the tiles of its own label
and keeps each anchor's best rows in heaps.  The second multiplies every block
with every tile and keeps, per anchor and positive, the best rows of other labels
within the positive's window of scores.  Heaps of different tiles are merged
within a task, and those of different tasks by a ranked window, whose partial
limit Spark applies before the shuffle.

A label that holds a third of all rows has as many tiles as its rows need, dealt
out over cells of ``CELL_TILES`` tiles, so no task depends on its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.sources.storage import write_shared

# Vectors of a tile and of a block of anchors, tiles per cell of the grid, and the side at which the recursion stops.
TILE_ROWS, BLOCK_ROWS, CELL_TILES, LEAF = 512, 512, 4, 16
# Blocks whose heaps a task holds before it hands them on.
HELD_BLOCKS = 32
LOWEST = np.iinfo(np.int64).min
ROW = "uid long, id long, label long, vector array<long>"
TILE = "n int, width int, least long, most long, labels binary, ids binary, uids binary, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of their quarters; odd sides get one line of zeros."""
    (rows, inner), columns = a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if (rows | inner | columns) & 1:
        a = np.pad(a, ((0, rows & 1), (0, inner & 1)))
        b = np.pad(b, ((0, inner & 1), (0, columns & 1)))
        return strassen(a, b, leaf)[:rows, :columns]
    r, i, c = rows // 2, inner // 2, columns // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    out = np.empty((rows, columns), np.int64)
    product = strassen(a11 + a22, b11 + b22, leaf)
    out[:r, :c] = product
    out[r:, c:] = product
    product = strassen(a21 + a22, b11, leaf)
    out[r:, :c] = product
    out[r:, c:] -= product
    product = strassen(a11, b12 - b22, leaf)
    out[:r, c:] = product
    out[r:, c:] += product
    product = strassen(a22, b21 - b11, leaf)
    out[:r, :c] += product
    out[r:, :c] += product
    product = strassen(a11 + a12, b22, leaf)
    out[:r, :c] -= product
    out[:r, c:] += product
    out[r:, c:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:r, :c] += strassen(a12 - a22, b21 + b22, leaf)
    return out


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer vectors; the shorter kind counts as followed by zeros."""
    width = max(anchors.shape[1], rows.shape[1])
    left, right = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    return strassen(left, np.ascontiguousarray(right.T))


class Heaps:
    """The ``k`` best (score, id) of each slot, higher scores and then smaller ids first; two sets of heaps merge into one."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(slots, LOWEST)  # the last score that is still in, once a heap is full

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises, and cannot overflow
        slot = slot[order]
        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
        place = np.arange(len(slot))
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        stay = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.slot, self.score, self.id = slot[rank < self.k], score[stay], ids[stay]
        self.worst[slot[rank == self.k - 1]] = score[full]

    def merge(self, other: Heaps) -> None:
        self.offer(other.slot, other.score, other.id)

    def offer_tile(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Offer a product: row i goes to ``slots[i]``, as far as allowed and within [low, high]; ids ascend."""
        fits = allowed & (scores >= np.maximum(low, self.worst[slots])[:, None]) & (scores <= high[:, None])
        many = fits.sum(axis=1) > 4 * self.k
        if many.any():  # only what reaches the k-th best score of its row can stay; of equals, the first k ids
            rows = np.flatnonzero(many)
            part = np.where(fits[rows], scores[rows], LOWEST)
            cut = np.partition(part, part.shape[1] - self.k, axis=1)[:, -self.k][:, None]
            level = fits[rows] & (part == cut)
            fits[rows] = (fits[rows] & (part > cut)) | (level & (np.cumsum(level, axis=1) <= self.k))
        row, column = np.nonzero(fits)
        if len(row):
            self.offer(slots[row], scores[row, column], ids[column])


def usable_rows(embeddings: DataFrame, vec_id: str, vector: str, label: str, shift: tuple[int, int, int]) -> DataFrame:
    """(uid, id, label, vector of whole numbers) of the rows that take part, written once in ranges of the label."""
    every, step, labels = shift
    values = F.col("vector").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    moved = F.when(F.col("id") % every == 0, (F.col("label") + step) % labels).otherwise(F.col("label"))
    whole = F.transform(values, lambda x: F.least(F.greatest(F.floor(x * 256.0), F.lit(-(1 << 62))), F.lit(1 << 62)))
    rows = rows.select("id", moved.alias("label"), whole.alias("vector")).withColumn("place", F.monotonically_increasing_id())
    # The place spreads a hot label, and rows that repeat, over ranges.
    sorted_rows = rows.repartitionByRange("label", "place").sortWithinPartitions("label", "id")
    return write_shared(sorted_rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "vector"), "negatives-rows")


def packed(rows: DataFrame, size: int, one_label: bool, extra: str | None = None) -> DataFrame:
    """Tiles of at most ``size`` rows in their order, ids ascending inside; with ``one_label`` no tile holds two labels.

    ``extra`` names a long array column that travels with its row.
    """
    fields = [("n", pa.int32()), ("width", pa.int32()), ("least", pa.int64()), ("most", pa.int64())]
    fields += [(name, pa.binary()) for name in ("labels", "ids", "uids", "vectors")] + ([("extra", pa.list_(pa.list_(pa.int64())))] if extra else [])
    schema = pa.schema(fields)

    def tile(ids, labels, uids, vectors, more) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        width = max(map(len, vectors))
        matrix = np.zeros((len(ids), width), np.int64)
        for row, one in enumerate(order.tolist()):
            matrix[row, : len(vectors[one])] = vectors[one]
        values = [len(ids), width, int(labels.min()), int(labels.max()), *(x[order].tobytes() for x in (labels, ids, uids)), matrix.tobytes()]
        values += [[more[i] for i in order.tolist()]] if extra else []
        return pa.RecordBatch.from_arrays([pa.array([value], kind.type) for value, kind in zip(values, schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, uids = (np.asarray(batch.column(name)) for name in ("id", "label", "uid"))
            vectors, more = batch.column("vector").to_numpy(zero_copy_only=False), batch.column(extra).to_pylist() if extra else None
            cuts = set(range(0, len(ids), size))
            if one_label:
                cuts = {0, *(np.flatnonzero(np.diff(labels)) + 1).tolist()} if len(ids) else set()
                ends = [*sorted(cuts)[1:], len(ids)]
                cuts |= {at for start, end in zip(sorted(cuts), ends, strict=True) for at in range(start, end, size)}
            starts = sorted(cuts)
            for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                part = slice(start, end)
                yield tile(ids[part], labels[part], uids[part], vectors[part], more[part] if extra else None)

    chosen = rows.select("id", "label", "uid", "vector", *([extra] if extra else []))
    return chosen.mapInArrow(pack, TILE + (", extra array<array<long>>" if extra else ""))


def opened(record: dict, side: str) -> tuple[np.ndarray, ...]:
    """Labels, ids, uids and vectors of a packed tile."""
    labels, ids, uids = (np.frombuffer(record[f"{side}_{name}"], np.int64) for name in ("labels", "ids", "uids"))
    return labels, ids, uids, np.frombuffer(record[f"{side}_vectors"], np.int64).reshape(record[f"{side}_n"], record[f"{side}_width"])


def named(tiles: DataFrame, side: str) -> DataFrame:
    return tiles.select([F.col(name).alias(f"{side}_{name}") for name in tiles.columns])


def best_of_products(pairs: DataFrame, k: int, windows: bool) -> DataFrame:
    """(uid, place, id, score): heaps over the products of joined blocks (``a_…``) and tiles (``t_…``).

    Without ``windows`` a slot is an anchor, and rows of its own label with
    another id may enter.  With them a slot is an anchor and one of its
    positives, and rows of other labels whose score lies in [low, high] of it.
    """
    schema = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, Heaps]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for uids, places, heaps in held.values():
                columns = [uids[heaps.slot], places[heaps.slot], heaps.id, heaps.score]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(columns, schema, strict=True)], schema=schema)
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                record = batch.slice(row, 1).to_pylist()[0]
                labels, ids, uids, anchors = opened(record, "a")
                tile_labels, tile_ids, _, vectors = opened(record, "t")
                if windows:
                    slot_row = np.repeat(np.arange(len(ids)), [len(some) for some in record["a_extra"]])
                    positive = np.array([score for some in record["a_extra"] for score in some], np.int64)
                    low, high = positive - positive // 5, positive  # 80 p <= 100 n, without a product that could overflow
                    places = np.concatenate([np.arange(len(some)) for some in record["a_extra"]]).astype(np.int64)
                else:
                    slot_row, places = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                    low, high = np.full(len(ids), LOWEST), np.full(len(ids), np.iinfo(np.int64).max)
                key = int(uids[0])
                if key not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from flush()
                    held[key] = (uids[slot_row], places, Heaps(len(slot_row), k))
                scores = scores_of(anchors, vectors)
                same = labels[:, None] == tile_labels[None, :]
                allowed = ~same if windows else same & (ids[:, None] != tile_ids[None, :])
                slots = np.arange(len(slot_row))
                for place in range(int(places.max(initial=-1)) + 1):
                    some = slots[places == place]
                    held[key][2].offer_tile(scores[slot_row[some]], tile_ids, allowed[slot_row[some]], some, low[some], high[some])
        yield from flush()

    return pairs.mapInArrow(run, "uid long, place int, id long, score long")


def cells_of(tiles: int) -> int:
    return max(1, -(-tiles // CELL_TILES))


def hard_negatives(
    embeddings: DataFrame, vec_id="vec_id", vector="embedding", label="label", every: int = 100, positives: int = 5, negatives: int = 5, shift=(7, 1, 10)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id ``every`` divides.

    An anchor's positives are the ``positives`` best other rows of its label, by
    the inner product of the whole-number vectors and then the smaller id.  Per
    anchor and positive come the ``negatives`` best rows of other labels whose
    score is at most the positive's and at least four fifths of it.  ``shift``
    says which labels are moved first: where its first number divides the id,
    the label grows by its second, modulo its third.

    Rows without an id, a label or a vector, or with a missing or non-finite
    component, take no part.  A shorter vector counts as followed by zeros, so an
    empty one scores 0.  Components are held within 2^62, and products wrap
    around as int64 does.  Rows that repeat an id stay candidates of their own,
    never positives of an anchor with that id, and each is an anchor of its own.
    """
    rows = usable_rows(embeddings, vec_id, vector, label, shift)
    anchors = rows.where(F.col("id") % every == 0)

    # Round one: blocks and tiles of one label meet by equi-join; a label's tiles are dealt over its cells.
    label_tiles = write_shared(packed(rows, TILE_ROWS, one_label=True), "negatives-label-tiles")
    cells = label_tiles.groupBy(F.col("least").alias("label")).agg(F.ceil(F.count("*") / CELL_TILES).alias("cells"))
    tiles = named(label_tiles, "t").join(cells.withColumnRenamed("label", "t_label"), F.col("t_least") == F.col("t_label"))
    tiles = tiles.withColumn("t_cell", F.pmod(F.xxhash64("t_uids"), F.col("cells"))).drop("cells", "t_label")
    blocks = named(packed(anchors, BLOCK_ROWS, one_label=True), "a").join(cells.withColumnRenamed("label", "a_label"), F.col("a_least") == F.col("a_label"))
    blocks = blocks.withColumn("a_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells", "a_label")
    # Sorted blocks spill; Spark must not build a hash table or a broadcast from rows that were exploded.
    pairs = tiles.join(blocks.hint("merge"), (F.col("t_least") == F.col("a_least")) & (F.col("t_cell") == F.col("a_cell")))
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    found = best_of_products(pairs, positives, windows=False).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= positives)
    best = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best"))  # at most ``positives`` each
    best = write_shared(best.select(F.col("uid").alias("_uid"), F.col("best.id").alias("positive_ids"), F.col("best.score").alias("positive_scores")), "negatives-positives")

    # Round two: a grid of blocks and groups of tiles; every block meets every tile once.
    with_scores = anchors.join(best, F.col("uid") == F.col("_uid")).drop("_uid", "positive_ids").sortWithinPartitions("label", "id")
    all_blocks = write_shared(packed(with_scores, BLOCK_ROWS, one_label=False, extra="positive_scores"), "negatives-blocks")
    all_tiles = write_shared(packed(rows, TILE_ROWS, one_label=False), "negatives-tiles")
    across, down = max(1, all_blocks.count()), cells_of(all_tiles.count())
    numbered = named(all_blocks, "a").withColumn("a_column", F.pmod(F.xxhash64("a_uids"), F.lit(across)))
    numbered = numbered.withColumn("a_cell", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    dealt = named(all_tiles, "t").withColumn("t_cell", F.pmod(F.xxhash64("t_uids"), F.lit(down)).cast("int"))
    dealt = dealt.withColumn("t_column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    alone = (F.col("t_least") == F.col("t_most")) & (F.col("a_least") == F.col("a_most")) & (F.col("t_least") == F.col("a_least"))
    grid = dealt.join(numbered.hint("merge"), (F.col("t_cell") == F.col("a_cell")) & (F.col("t_column") == F.col("a_column")) & ~alone)
    ranked = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "id")
    hard = best_of_products(grid, negatives, windows=True).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)

    names = anchors.select(F.col("uid").alias("_anchor"), F.col("id").alias("anchor_id")).join(best, F.col("_anchor") == F.col("_uid"))
    joined = hard.join(names, F.col("uid") == F.col("_anchor"))
    at = F.col("place") + 1
    return joined.select(
        "anchor_id", F.element_at("positive_ids", at).alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.element_at("positive_scores", at).alias("positive_score"), F.col("score").alias("negative_score"),
    )


def negatives_sql(every: int = 100, positives: int = 5, negatives: int = 5) -> str:
    """The same over ``embeddings``, by scoring every anchor against every row."""
    return f"""
WITH usable AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT uid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable),
scored AS (
    SELECT a.uid AS auid, c.uid AS cuid, CAST(sum(a.x * c.x) AS BIGINT) AS score
    FROM (SELECT p.* FROM parts p JOIN usable u USING (uid) WHERE u.vec_id % {every} = 0) a JOIN parts c USING (i) GROUP BY 1, 2),
pairs AS (
    SELECT a.uid AS auid, a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, s.score
    FROM scored s JOIN usable a ON a.uid = s.auid JOIN usable c ON c.uid = s.cuid),
positive AS (
    SELECT auid, anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score, n FROM (
        SELECT *, row_number() OVER (PARTITION BY auid ORDER BY score DESC, vec_id) AS n FROM pairs WHERE label = anchor_label AND vec_id <> anchor_id)
    WHERE n <= {positives})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.positive_id, p.positive_score, c.vec_id AS negative_id, c.score AS negative_score,
           row_number() OVER (PARTITION BY p.auid, p.n ORDER BY c.score DESC, c.vec_id) AS rank
    FROM positive p JOIN pairs c ON c.auid = p.auid AND c.label <> p.anchor_label AND 80 * p.positive_score <= 100 * c.score AND c.score <= p.positive_score)
WHERE rank <= {negatives}"""
