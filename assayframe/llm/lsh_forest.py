"""MinHash near-duplicates by an LSH forest.

A document is the set of its distinct five-word shingles.  Equal sets are one
node.  Every node has a MinHash signature, cut into several sequences (trees).
The nodes are sorted by each sequence; neighbours in a sorted order share the
longest prefixes.  A region is a stretch that shares a prefix.  In a sparse
region all pairs are candidates from a shallow depth on; a dense region is
split deeper until its parts are small, and where even the deepest part is
large, each node is paired with its next neighbours in every order.  A sketch
of the whole signature drops pairs that cannot reach the similarity (five
standard deviations below it).

What a dense region leaves out is found exactly: all nodes that ever stood in
one are joined by the rarest shingles of their whole sets (a prefix filter with
sizes and positions), as far as they are not in one component yet.

Candidates are confirmed on whole shingle sets, in three rounds, so that a
large group is joined by about one comparison per node instead of all pairs:
each node's best candidate first, then the best between each two components,
then all that still join different components.

A global range sort deals the orders out, so no region and no group of copies
ends up in one task; pairs across the cut between two tasks are found from the
few rows at the cut.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import sliced, small_batches, texts_of, tidy
from assayframe.llm.components import components
from assayframe.sources.storage import write_shared

SHINGLE = 5
TREES, DEPTH = 12, 8
SHALLOW = 3  # the depth from which a region counts
REGION = 24  # nodes of a region of which all pairs are candidates
NEIGHBOURS = 3  # next nodes in an order that a node of a dense region is paired with
ORDER_ROWS = 40_000  # rows of a sorted order that one task holds
CACHE_WORDS = 150_000
ORDER_SLOTS = 1 << 20  # counters that put shingles in an order from rare to frequent
BLOCK = 512  # rows of one shingle that a task joins with the others
SLOTS = 1 << 22  # bits of the filter that spares texts of documents without a candidate a shuffle
DEVIATIONS = 5.0

_rng = np.random.default_rng(20)
FLIP = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
TIMES = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Matching half-bytes in a byte of two sketches laid over each other by exclusive or.
MATCHES = np.array([(byte & 15 == 0) + (byte >> 4 == 0) for byte in range(256)], np.uint8)


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; one for a text of fewer than five words, none without a word."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    word = hashes.of(words)
    if len(word) < SHINGLE:
        return mixed(np.array([int((word * SALTS[: len(word)]).sum(dtype=np.uint64)) ^ len(word)], np.uint64) * SALTS[SHINGLE])
    count = len(word) - SHINGLE + 1
    every = np.zeros(count, np.uint64)
    for shift in range(SHINGLE):
        every += word[shift : shift + count] * SALTS[shift]
        every = (every << np.uint64(21)) | (every >> np.uint64(43))
    return np.unique(mixed(every))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash signature of each non-empty set, as big-endian 32-bit values, so that bytes sort like numbers."""
    flat = np.concatenate(sets)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(lengths) - lengths
    found = np.empty((len(sets), TREES * DEPTH), ">u4")
    for k in range(TREES * DEPTH):
        found[:, k] = np.minimum.reduceat((flat ^ FLIP[k]) * TIMES[k], starts) >> np.uint64(32)
    return found


def sign(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_shingles, node, signature): the node is a digest of the set, NULL for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        hashes = WordHashes()
        for batch in sliced(batches, "text"):
            sets = [shingles(value, hashes) for value in texts_of(batch.column("text"))]
            filled = [one for one in sets if len(one)]
            marks = iter(signatures(filled)) if filled else iter(())
            node = [hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None for one in sets]
            mark = [next(marks).tobytes() if len(one) else None for one in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.binary()), pa.array(mark, pa.binary())],
                schema=schema,
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), "doc_id long, n_shingles long, node binary, signature binary")


def least_matches(similarity: float) -> int:
    """Matching half-bytes below which a pair is ``DEVIATIONS`` away from the similarity."""
    share = similarity + (1 - similarity) / 16
    return math.floor(TREES * DEPTH * (share - DEVIATIONS * math.sqrt(share * (1 - share) / (TREES * DEPTH))))


def _leaves(prefix: np.ndarray, start: int, stop: int, depth: int):
    """Parts of a region, each small or as deep as the order goes."""
    if stop - start <= REGION or depth == DEPTH:
        if stop - start > 1:
            yield start, stop
        return
    column = prefix[start:stop, depth]
    cuts = np.flatnonzero(column[1:] != column[:-1]) + 1 + start
    for a, b in zip([start, *cuts.tolist()], [*cuts.tolist(), stop], strict=True):
        yield from _leaves(prefix, a, b, depth + 1)


def _regions(prefix: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a sorted order that share a prefix of ``SHALLOW`` values."""
    if len(prefix) < 2:
        return []
    joined = (prefix[1:, :SHALLOW] == prefix[:-1, :SHALLOW]).all(axis=1)
    edges = np.flatnonzero(np.diff(np.r_[0, joined.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True))


def crowded(prefix: np.ndarray) -> list[int]:
    """Indexes in dense regions, of which not all pairs are candidates."""
    return [at for start, stop in _regions(prefix) if stop - start > REGION for at in range(start, stop)]


def neighbours(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of candidates in a sorted order."""
    left, right = [], []
    for start, stop in _regions(prefix):
        if stop - start > REGION:
            for step in range(1, NEIGHBOURS + 1):
                left.append(np.arange(start, stop - step))
                right.append(np.arange(start + step, stop))
        for a, b in _leaves(prefix, start, stop, SHALLOW):
            if b - a <= REGION:
                i, j = np.triu_indices(b - a, 1)
                left.append(i + a)
                right.append(j + a)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _candidates(nodes: list[bytes], prefix: np.ndarray, sketch: np.ndarray, least: int):
    """(a, b, matches) of the candidates that pass the sketch, the lesser node first."""
    left, right = neighbours(prefix)
    for start in range(0, len(left), 200_000):
        i, j = left[start : start + 200_000], right[start : start + 200_000]
        matches = MATCHES[sketch[i] ^ sketch[j]].sum(axis=1, dtype=np.int64)
        for a, b, m in zip(i[matches >= least].tolist(), j[matches >= least].tolist(), matches[matches >= least].tolist(), strict=True):
            if nodes[a] != nodes[b]:
                yield min(nodes[a], nodes[b]), max(nodes[a], nodes[b]), m


def candidate_pairs(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, matches): candidate pairs of nodes, each once; and the nodes that stood in a dense region."""
    least = least_matches(similarity)
    count = nodes.count()
    tasks = max(1, math.ceil(count * TREES / ORDER_ROWS))
    kinds = [("a", pa.binary()), ("b", pa.binary()), ("matches", pa.int64()), ("tree", pa.int32()), ("prefix", pa.binary()), ("sketch", pa.binary())]
    schema, spec = pa.schema(kinds), "a binary, b binary, matches long, tree int, prefix binary, sketch binary"

    def spread(batches):
        """A row per node and tree."""
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            low = marks[:, 3::4] & 15
            sketch = (low[:, ::2] | (low[:, 1::2] << 4)).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in sketch], pa.binary())
            for tree in range(TREES):
                prefix = marks[:, tree * DEPTH * 4 : (tree + 1) * DEPTH * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array([row.tobytes() for row in prefix], pa.binary()), batch.column("node"), packed],
                    names=["tree", "prefix", "node", "sketch"],
                )

    def rows(pairs, edges):
        pairs, edges = list(pairs), list(edges)
        columns = [[p[i] for p in pairs] + [None] * len(edges) for i in range(3)]
        columns[0] = [p[0] for p in pairs] + [e[1] for e in edges]
        columns += [[None] * len(pairs) + [e[i] for e in edges] for i in (0, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], schema=schema)

    def forest(batches):
        """Candidates of one task's stretch of the orders, and the rows of the regions at its two ends."""
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        trees = whole.column("tree").to_numpy()
        names, prefixes = whole.column("node").to_pylist(), whole.column("prefix").to_pylist()
        sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint8).reshape(len(names), -1)
        prefix = np.frombuffer(b"".join(prefixes), ">u4").astype(np.uint32).reshape(len(names), DEPTH)
        cuts, dense = np.flatnonzero(np.diff(trees)) + 1, set()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
            yield rows(_candidates(names[a:b], prefix[a:b], sketch[a:b], least), [])
            dense.update(names[a + at] for at in crowded(prefix[a:b]))
        yield rows([(node, None, 0) for node in dense], [])
        kept = set()
        for end, step in ((0, 1), (len(names) - 1, -1)):
            at = end
            while 0 <= at < len(names) and abs(at - end) < REGION and trees[at] == trees[end] and (prefix[at, :SHALLOW] == prefix[end, :SHALLOW]).all():
                kept.add(at)
                at += step
        yield rows([], [(int(trees[i]), names[i], prefixes[i], sketch[i].tobytes()) for i in sorted(kept)])

    def at_cuts(frame):
        """Candidates among the rows at the ends of tasks, one tree at a time."""
        frame = frame.sort_values(["prefix", "a"])
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        prefix = np.frombuffer(b"".join(frame["prefix"]), ">u4").astype(np.uint32).reshape(len(frame), DEPTH)
        import pandas as pd

        names = list(frame["a"])
        dense = [(names[at], None, 0) for at in crowded(prefix)]
        return pd.DataFrame([*_candidates(names, prefix, sketch, least), *dense], columns=["a", "b", "matches"])

    ordered = nodes.select("node", "signature").mapInArrow(tidy(spread), "tree int, prefix binary, node binary, sketch binary")
    ordered = ordered.repartitionByRange(tasks, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = write_shared(ordered.mapInArrow(tidy(forest), spec), "forest")
    ends = found.where("tree IS NOT NULL").groupBy("tree").applyInPandas(at_cuts, "a binary, b binary, matches long")
    every = found.where("tree IS NULL").select("a", "b", "matches").union(ends).groupBy("a", "b").agg(F.max("matches").alias("matches"))
    every = write_shared(every, "pairs")
    return every.where("b IS NOT NULL"), every.where("b IS NULL").select(F.col("a").alias("node"))


def _rank_slots(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(ORDER_SLOTS - 1)).astype(np.int64)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """About how many of the texts hold a shingle, in ``ORDER_SLOTS`` counters.  It decides an order only."""

    def run(batches):
        hashes = WordHashes()
        for batch in sliced(batches, "text"):
            sets = [shingles(value, hashes) for value in texts_of(batch.column("text"))]
            if sets:
                slots, n = np.unique(_rank_slots(np.concatenate(sets)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    counted = small_batches(texts.select("text")).mapInArrow(tidy(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    filled = np.zeros(ORDER_SLOTS, np.int64)
    table = counted.toArrow()
    filled[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return filled


def rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(node, size, token, pos, short): the rarest shingles of each set, so many that two similar sets share one.

    Of two sets the larger one needs all rows, the smaller one those with ``short``.
    """
    held = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))
    spec = "node binary, size long, token long, pos long, short boolean"

    def run(batches):
        hashes = WordHashes()
        for batch in sliced(batches, "text"):
            columns = [[], [], [], [], []]
            for node, value in zip(batch.column("node").to_pylist(), texts_of(batch.column("text")), strict=True):
                every = shingles(value, hashes)
                size = len(every)
                probe = size - -(-percent * size // 100) + 1
                index = size - -(-2 * percent * size // (100 + percent)) + 1
                chosen = every[np.lexsort((every, held.value[_rank_slots(every)]))[:probe]]
                for column, part in zip(columns, ([node] * len(chosen), [size] * len(chosen), chosen.view(np.int64).tolist(), range(len(chosen)), [at < index for at in range(len(chosen))]), strict=True):
                    column.extend(part)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["node", "size", "token", "pos", "short"])

    return write_shared(small_batches(texts.select("node", "text")).mapInArrow(tidy(run), spec), "rare-shingles")


def prefix_pairs(rare: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, matches): every pair in different components that can reach the similarity, by an exact prefix filter.

    A shingle that all its nodes' components have in common tells nothing new and
    goes at once.  Rows of a frequent one are dealt out in blocks.
    """
    named = known.select(F.col("node").alias("_node"), "root")
    rows = rare.join(named, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    rows = write_shared(rows, "rare-rooted")
    several = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    several = several.where("_low <> _high").select("token", F.floor(F.col("n") / BLOCK).cast("int").alias("last"))
    rows = rows.join(several, "token")
    probe = rows.select("token", F.explode(F.sequence(F.lit(0), "last")).alias("block"), *[F.col(name).alias(f"{name}_a") for name in ("node", "size", "pos", "root")])
    index = rows.where("short").select(
        "token", F.pmod(F.hash("node"), F.col("last") + 1).alias("block"), *[F.col(name).alias(f"{name}_b") for name in ("node", "size", "pos", "root")]
    )
    larger = F.struct("size_b", "node_b") < F.struct("size_a", "node_a")
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    can = (rest * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))) & (100 * F.col("size_b") >= percent * F.col("size_a"))
    met = probe.join(index, ["token", "block"]).where((F.col("root_a") != F.col("root_b")) & larger & can)
    pairs = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.count("*").alias("matches"))
    return write_shared(pairs, "prefix-pairs")


def bit_filter(ids: DataFrame, name: str) -> np.ndarray:
    """A fixed-size bit filter of a column of ids, at most ``SLOTS / 8`` bytes."""
    bits = ids.select(slot_of(name).alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("block")).agg(
        F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bits")
    )
    filled = np.zeros(SLOTS // 8, np.uint8)
    for row in bits.toLocalIterator():
        filled[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return filled


def slot_of(name: str):
    return F.pmod(F.xxhash64(name), F.lit(SLOTS))


def sift(rows: DataFrame, name: str, filled: np.ndarray, hit: bool = True) -> DataFrame:
    """The rows whose id may be in the filter (all that are in it), or with ``hit=False`` those that cannot be."""
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        for batch in batches:
            slots = batch.column("_slot").to_numpy()
            yield batch.filter(pa.array(((shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1) == hit))

    marked = small_batches(rows).withColumn("_slot", slot_of(name))
    return marked.mapInArrow(tidy(run), marked.schema).drop("_slot")


def texts_of_nodes(docs: DataFrame, signed: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text): the text of one document of every wanted node.

    A bit filter of the document ids keeps most other texts from being
    shuffled; the join after it is exact.
    """
    chosen = signed.groupBy("node").agg(F.min("doc_id").alias("_doc_id")).join(wanted, "node")
    chosen = write_shared(chosen, "chosen")
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc_id"), F.col(text).cast("string").alias("text"))
    joined = sift(rows, "_doc_id", bit_filter(chosen, "_doc_id")).join(chosen, "_doc_id").select("node", "text")
    # A document id that several rows share has several texts: the node says which one is meant.
    return write_shared(joined.mapInArrow(tidy(_with_node), "node binary, text string").dropDuplicates(["node"]), "node-texts")


def _with_node(batches):
    hashes = WordHashes()
    for batch in sliced(batches, "text"):
        same = [
            hashlib.blake2b(shingles(value, hashes).tobytes(), digest_size=16).digest() == node
            for value, node in zip(texts_of(batch.column("text")), batch.column("node").to_pylist(), strict=True)
        ]
        yield batch.filter(pa.array(same, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs with 100 x intersection >= percent x union of their whole sets."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column("text_a"))).sum() + np.asarray(pc.binary_length(batch.column("text_b"))).sum()
            step = max(1, int(batch.num_rows * (4 << 20) / max(size, 1)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                same = []
                for a, b in zip(texts_of(part.column("text_a")), texts_of(part.column("text_b")), strict=True):
                    x, y = shingles(a, hashes), shingles(b, hashes)
                    shared = len(x) + len(y) - len(np.union1d(x, y)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else -1
                    same.append(shared >= 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return write_shared(both.mapInArrow(tidy(run), "a binary, b binary"), "confirmed")


def links(docs: DataFrame, signed: DataFrame, similarity_percent: int, doc_id: str, text: str) -> DataFrame | None:
    """Confirmed links (a, b) between nodes that join every component; None where there is no candidate."""
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("signature").alias("signature"))
    pairs, dense = candidate_pairs(nodes, similarity_percent / 100)
    if pairs.isEmpty() and dense.isEmpty():
        return None
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(dense).distinct()
    texts = texts_of_nodes(docs, signed, wanted, doc_id, text)
    # Round one: the best candidate of every node.
    best = pairs.select("a", "b", "matches", F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(
        F.max_by(F.struct("a", "b"), F.struct("matches", "a", "b")).alias("p")
    )
    tried = write_shared(best.select("p.a", "p.b").distinct(), "tried")
    found = _join_rest(pairs, tried, confirm(tried, texts, similarity_percent), texts, similarity_percent)
    if dense.isEmpty():
        return found
    # The pairs that dense regions left out, as far as they would join two components.
    rare = rare_shingles(texts.join(dense, "node", "left_semi"), similarity_percent)
    known = write_shared(components(found), "components")
    return _join_rest(prefix_pairs(rare, known, similarity_percent), tried, found, texts, similarity_percent)


def _join_rest(pairs: DataFrame, tried: DataFrame, found: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links found so far, and those of the untried pairs that join two components: first the best between each two, then every other."""
    for only_best in (True, False):
        left = _across(pairs.join(tried, ["a", "b"], "left_anti"), found)
        if only_best:
            left = left.groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("matches", "a", "b")).alias("p")).select("p.a", "p.b")
        left = write_shared(left.select("a", "b"), "tried")
        if left.isEmpty():
            break
        tried = tried.union(left)
        found = found.union(confirm(left, texts, percent))
    return found


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components of the links found so far, with the components as (ca, cb)."""
    known = write_shared(components(found), "components")
    a = known.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = known.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return both.where("ra <> rb").select("a", "b", "matches", F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))


def near_duplicates(docs: DataFrame, similarity_percent: int = 80, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, ``kept`` marks it.
    A missing, empty or blank text has no shingle and is linked with nothing.
    Repeated rows are copies of each other; those that share the kept id are all
    marked as kept.  A row without an id is linked with its exact copies only.
    """
    signed = write_shared(sign(docs, doc_id, text), "signed")
    found = links(docs, signed, similarity_percent, doc_id, text)
    least = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    if found is not None:
        known = write_shared(components(found), "components").withColumnRenamed("node", "_node")
        joined = least.join(known, F.col("node") == F.col("_node"), "left").drop("_node")
        lowest = joined.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("lowest"))
        joined = joined.join(lowest, F.col("root") == F.col("_root"), "left")
        least = joined.select("node", F.coalesce("lowest", "least").alias("least"))
    least = least.withColumnRenamed("node", "_node")
    rows = signed.select("doc_id", "n_shingles", "node").join(least, F.col("node") == F.col("_node"), "left")
    component = F.coalesce("least", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, similarity_percent: int = 80, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest doc_id.

    Ids are taken to name one text; wholly repeated rows stay once.  Most rows
    pass by a bit filter of the ids of components with more than one row and
    are not shuffled.
    """
    found = write_shared(near_duplicates(docs, similarity_percent, doc_id, text), "near-duplicates")
    grouped = found.where("n_shingles > 0").groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    grouped = grouped.withColumnRenamed("component_id", "_component")
    members = found.where("n_shingles > 0").join(grouped, F.col("component_id") == F.col("_component")).select(
        F.col("doc_id").alias("_doc_id"), F.col("kept").alias("_kept")
    )
    members = write_shared(members.groupBy("_doc_id").agg(F.max("_kept").alias("_kept")), "members")
    filled = bit_filter(members, "_doc_id")
    packed = docs.select(  # whatever the documents' columns are called, they cannot clash
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"), F.col(doc_id).cast("long").alias("_own")
    )
    alone = sift(packed, "_own", filled, hit=False).select("doc.*")
    others = sift(packed, "_own", filled).join(members, F.col("_own") == F.col("_doc_id"), "left")
    lone = others.where("_kept IS NULL").select("doc.*")
    once = others.where("_kept").dropDuplicates(["_own"]).select("doc.*")
    return alone.unionByName(lone).unionByName(once)
