"""Language-model scoring by online logistic context mixing.

The text is taken as its lower-cased words and an end mark, each word as its
bytes and a blank.  Every bit of every byte is predicted by several tables of
hashed contexts: one, two and four bytes back, the beginning of the word, and
the beginning of the word with the kind of word before it.  A table holds how
often each bit value followed its context in the training texts.  The
predictions are mixed in the logistic domain with weights that a gate (byte and
bit place, and how often the word's beginning was seen) chooses; the weights are
learned online, batch by batch, by Newton steps.  A last table refines the mixed probability by
bit-tree node.  The total of ``-log2 p`` over all bits is the size of the text.

Contexts reach into the word before by its kind only, so a (kind, word) pair
costs the same wherever it stands, and each is predicted once for all texts.
Training is on counts of distinct (kind, word) pairs over all training texts;
a pair is predicted with its own occurrence taken out of the tables, so
weights are learned as for unseen text.

Tables, weights and the refinement have fixed sizes; they are summed or
averaged by Spark and broadcast.  Counts and sizes of pairs are not: the most
frequent pairs (up to ``HEAD_PAIRS``) are broadcast, all others are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import crc_fold, sliced, small_batches
from assayframe.sources.storage import write_shared

END = b"\n"
KINDS = 8
# Bits of the slot number of each context table.
TABLE_BITS = (16, 18, 19, 21, 20)
PREFIX = 3  # the table whose counts choose the gate
# How often the beginning was seen: levels of the gate.
SEEN = (1, 2, 3, 5, 10, 40, 400)
SEEN_LEVELS = len(SEEN) + 1
LEVEL_OF = np.searchsorted(SEEN, np.arange(SEEN[-1] + 1), side="right")
GATES = 3 * 8 * SEEN_LEVELS
STEPS = 33  # of the refinement, over stretched probabilities from -8 to 8
BASE_COUNT = 0.05
CHUNK = 1 << 16
HEAD_PAIRS = 1 << 18
# Parts of a factor of two by which counts of pairs are told apart when the most frequent are chosen.
HEAD_LEVELS = 16
COUNTED_PAIRS = 1_000_000
OUT_ROWS = 1 << 16
BLOCK_BYTES = 80_000
# Bytes of pairs whose contexts are counted at once, and that are put in order at once to be predicted.
COUNTED_BYTES = 240_000
PRICED_BYTES = 4 << 20
# One batch in so many adds to the curvature of the mixing weights, with that weight.
CURVE_EVERY = 4
BATCH = 1 << 15
# The curvature that the first weights start with: how firmly they are held.
FIRM = 50.0

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _kinds() -> list[int]:
    """The kind of a word by its last byte."""
    kind = [7] * 256
    for letters, value in ((b".!?", 1), (b",;:", 2), (b"0123456789", 3), (b"bcdfghjklmpqvwxz", 6), (b"nrst", 5), (b"aeiouy", 4)):
        for letter in letters:
            kind[letter] = value
    return kind


KIND_OF = _kinds()


def pairs_of(text: bytes | None) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    """The words of a text with the end mark, and each with the kind of the word before; 0 at the start."""
    words = text.lower().split() if text else []
    kinds = [0, *[KIND_OF[word[-1]] for word in words]]
    words.append(END)
    return words, list(zip(kinds, words, strict=True))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_KIND_OF = np.array(KIND_OF, np.uint8)


def pairs_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pairs of all texts as ``pairs_of`` gives them, each as the byte of its kind and its word; and how many of each text."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = _LOWER[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = ~_BLANK[data]
    # A word begins or ends where its neighbour is blank or lies in another text.
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~letter[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(letter & edge[:-1])
    edge[:-1] = ~letter
    edge[offsets] = True
    ends = np.flatnonzero(letter & edge[1:])
    upto = np.searchsorted(starts, offsets)
    numbers = np.diff(upto) + 1
    marks = np.cumsum(numbers) - 1
    is_word = np.ones(len(starts) + len(marks), bool)
    is_word[marks] = False
    lengths, kinds = np.full(len(is_word), 2, np.int64), np.zeros(len(is_word) + 1, np.uint8)
    lengths[is_word] = ends - starts + 2
    kinds[1:][is_word] = _KIND_OF[data[ends]]
    out_offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out_offsets[1:])
    out, from_text = np.empty(out_offsets[-1], np.uint8), np.ones(out_offsets[-1], bool)
    out[out_offsets[:-1]], out[out_offsets[marks] + 1] = kinds[:-1], END[0]
    from_text[out_offsets[:-1]] = from_text[out_offsets[marks] + 1] = False
    out[from_text] = data[letter]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(out_offsets.astype(np.int32)), pa.py_buffer(out)]), numbers


def parted(keys: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Kinds and words of pairs that are held as one value each."""
    if len(keys) == 0:
        return pa.array([], pa.int32()), keys
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    in_word = np.ones(len(data), bool)
    in_word[offsets[:-1]] = False
    words = [None, pa.py_buffer(offsets - np.arange(len(offsets), dtype=np.int32)), pa.py_buffer(data[in_word])]
    return pa.array(data[offsets[:-1]].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(keys), words)


# Per byte value: its bits, its bit-tree nodes, and the nodes of its two halves of four bits.
_BYTES, _DEPTH = np.arange(256)[:, None], np.arange(8)
VALUES = ((_BYTES >> (7 - _DEPTH)) & 1).astype(np.float32)
NODES = ((1 << _DEPTH) | (_BYTES >> (8 - _DEPTH))).astype(np.int32)
PLACES = (np.arange(3)[:, None] * 8 + _DEPTH).astype(np.int32)
HALVES = np.concatenate([(1 << _DEPTH[:4]) | (half >> (4 - _DEPTH[:4])) for half in (_BYTES >> 4, _BYTES & 15)], axis=1).astype(np.int32)


class Bits:
    """All bit decisions of some (kind, word) pairs: values, bit-tree nodes and table slots, eight per byte.

    A byte's bits and contexts are the same in all pairs of one kind that begin
    alike.  With ``once``, a byte that the pair before has too is held once (so
    pairs should come in order); ``byte`` leads from the bytes of the pairs to
    those held.  The slots of half a byte lie side by side.
    """

    def __init__(self, pairs: list[tuple[int, bytes]], tables=range(len(TABLE_BITS)), once: bool = False) -> None:
        stream = [word if word == END else word + b" " for _, word in pairs]
        self.lengths = np.fromiter(map(len, stream), np.int64, len(stream))
        data = np.frombuffer(b"".join(stream), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = np.repeat(self.starts, self.lengths)
        place = np.arange(len(data)) - first
        kind = np.repeat(np.fromiter((k + 1 for k, _ in pairs), np.uint64, len(pairs)) * np.uint64(0xD6E8FEB86659FD93), self.lengths)
        wide = data.astype(np.uint64)
        powers = np.cumprod(np.full(len(data), _PRIME))
        sums = np.r_[np.uint64(0), np.cumsum((wide + np.uint64(1)) * powers)]
        undo = np.cumprod(np.full(len(data), _INVERSE))
        at = np.arange(len(data))
        self.byte = at
        if once:
            upto = (sums[1:] - sums[first]) * undo[first] + kind
            before, length = np.r_[0, self.starts[:-1]], np.r_[0, self.lengths[:-1]]
            above = np.repeat(before, self.lengths) + place
            new = (place >= np.repeat(length, self.lengths)) | (upto != upto[np.minimum(above, len(data) - 1)])
            # Place by place, a byte held before follows directly on its like.
            order = np.argsort(np.minimum(place, 65_535).astype(np.uint16), kind="stable")
            order = order if len(place) == 0 or place.max() < 65_535 else np.argsort(place, kind="stable")
            new = new[order]
            at, self.byte = order[new], np.empty(len(data), np.int64)
            self.byte[order] = np.cumsum(new) - 1
        place, first = place[at], first[at]

        def back(steps: int) -> np.ndarray:
            out = wide[at - np.minimum(steps, place)]
            out[place < steps] = 0
            return out

        prefix = (sums[at] - sums[first]) * undo[first]
        one, data = back(1), data[at]
        two = one | back(2) << np.uint64(8)
        four = two | back(3) << np.uint64(16) | back(4) << np.uint64(24)
        self.node, self.value = NODES.take(data, axis=0).ravel(), VALUES.take(data, axis=0).ravel()
        halves, high = HALVES.take(data, axis=0).ravel(), ((data >> 4).astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
        contexts = (one, two, four, prefix, prefix + kind[at])
        self.slots: dict[int, np.ndarray] = {}
        for k in tables:
            if k == 0:
                self.slots[k] = np.repeat(one.astype(np.int32) << 8, 8) | self.node
                continue
            mixed = (contexts[k] ^ (contexts[k] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            begin = np.empty((len(data), 2), np.int32)
            begin[:, 0], begin[:, 1] = (x * _PRIME >> np.uint64(64 - TABLE_BITS[k]) for x in (mixed, mixed + high))
            slots = np.repeat(begin.ravel(), 4)
            slots += halves
            slots &= (1 << TABLE_BITS[k]) - 1
            self.slots[k] = slots
        # The gate without how often the beginning was seen: place of the byte in the word and of the bit in the byte.
        self.place = PLACES.take(np.minimum(place, 2), axis=0).ravel()

    def weights(self, numbers: np.ndarray) -> np.ndarray:
        """The weight of each bit, where each pair has that of ``numbers``."""
        return np.repeat(np.bincount(self.byte, np.repeat(numbers, self.lengths)), 8)

    def gate(self, seen: np.ndarray) -> np.ndarray:
        return self.place * SEEN_LEVELS + LEVEL_OF[np.minimum(seen, SEEN[-1]).astype(np.int32)]


def in_order(pairs: list[tuple[int, bytes]]) -> np.ndarray:
    """Places of the pairs, by kind and word."""
    return np.asarray(pc.array_sort_indices(pa.array([b"%c%b" % pair for pair in pairs], pa.binary())))


def step_of(stretched: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((stretched + 8) * ((STEPS - 1) / 16)), 0, STEPS - 1).astype(np.int32)


class Model:
    """Stretched predictions per slot, mixing weights per gate, and the refinement."""

    def __init__(self, counts: list[np.ndarray], weights: np.ndarray, refined: np.ndarray) -> None:
        self.stretched = [np.log((c[1] + BASE_COUNT) / (c[0] + BASE_COUNT)).astype(np.float32) for c in counts]
        self.level = np.searchsorted(SEEN, counts[PREFIX][0] + counts[PREFIX][1], side="right").astype(np.uint8)
        self.weights = np.ascontiguousarray(weights.T, dtype=np.float32)
        first, second = refined
        self.refined = ((second + 1e-9) / (first + second + 2e-9)).astype(np.float32)

    def sizes(self, pairs: list[tuple[int, bytes]]) -> np.ndarray:
        """Bits of each pair."""
        order, out, start = in_order(pairs), [], 0
        pairs = [pairs[i] for i in order.tolist()]
        while start < len(pairs):
            stop, held = start, 0
            while stop < len(pairs) and (stop == start or held + len(pairs[stop][1]) < BLOCK_BYTES):
                held += len(pairs[stop][1]) + 1
                stop += 1
            out.append(self._sizes(Bits(pairs[start:stop], once=True)))
            start = stop
        found = np.zeros(len(pairs))
        found[order] = np.concatenate(out) if out else []
        return found

    def _sizes(self, bits: Bits) -> np.ndarray:
        gate = bits.place * SEEN_LEVELS + self.level.take(bits.slots[PREFIX])
        total = np.zeros(len(gate), np.float32)
        for k, slots in bits.slots.items():
            total += self.weights[k].take(gate) * self.stretched[k].take(slots)
        mixed = 1 / (1 + np.exp(-np.clip(total, -15, 15)))
        final = np.clip((mixed + self.refined.take(bits.node * STEPS + step_of(total))) / 2, 2.0**-18, 1 - 2.0**-18)
        cost = -np.log2(np.where(bits.value > 0, final, 1 - final))
        return np.add.reduceat(cost.reshape(-1, 8).sum(axis=1, dtype=np.float64)[bits.byte], bits.starts)


def count_pairs(docs: DataFrame) -> DataFrame:
    """(word, k0 ... k7, kinds): how often each word follows each kind in texts to learn from, and a bit for each kind that it follows in any text.

    ``docs`` has a text and whether to learn from it; an end mark counts as a word.
    """
    def run(batches):
        parts, held = [], 0

        def merged():
            coded = pa.concat_arrays([keys for keys, _ in parts]).dictionary_encode()
            numbers = np.concatenate([numbers for _, numbers in parts])
            return coded.dictionary, np.bincount(coded.indices.to_numpy(), numbers, len(coded.dictionary))

        def rows():
            keys, numbers = merged()
            for start in range(0, len(keys), OUT_ROWS):
                kinds, words = parted(keys.slice(start, OUT_ROWS))
                yield pa.RecordBatch.from_arrays([words, kinds, pa.array(numbers[start : start + OUT_ROWS].astype(np.int64))], names=["word", "kind", "n"])

        for batch in sliced(batches, "text"):
            keys, numbers = pairs_in(batch.column("text"))
            coded = keys.dictionary_encode()
            learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False).astype(np.float64), numbers)
            parts.append((coded.dictionary, np.bincount(coded.indices.to_numpy(), learn, len(coded.dictionary))))
            held += len(coded.dictionary)
            if held > COUNTED_PAIRS:
                parts = [merged()]
                held = len(parts[0][0])
                if held > COUNTED_PAIRS // 2:
                    yield from rows()
                    parts, held = [], 0
        if parts:
            yield from rows()

    parts = docs.mapInArrow(run, "word binary, kind int, n long")
    of_kind = lambda i: F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0))
    return parts.groupBy("word").agg(*[of_kind(i).alias(f"k{i}") for i in range(KINDS)], F.expr("bit_or(shiftleft(1, kind))").alias("kinds"))


def _blocks(batches, most: int = BLOCK_BYTES, across: bool = False):
    """(pairs, counts) of rows of the vocabulary, of bounded size, each in order; of several batches if ``across``."""
    def ordered(pairs, numbers):
        order = in_order(pairs)
        return [pairs[i] for i in order.tolist()], np.array(numbers, np.float64)[order]

    pairs, numbers, held = [], [], 0
    for batch in batches:
        words = batch.column("word").to_pylist()
        counts = np.stack([batch.column(f"k{i}").to_numpy() for i in range(KINDS)], axis=1)
        for row, kind in zip(*(x.tolist() for x in np.nonzero(counts)), strict=True):
            pairs.append((kind, words[row]))
            numbers.append(counts[row, kind])
            held += len(words[row]) + 1
            if held >= most:
                yield ordered(pairs, numbers)
                pairs, numbers, held = [], [], 0
        if pairs and not across:
            yield ordered(pairs, numbers)
            pairs, numbers, held = [], [], 0
    if pairs:
        yield ordered(pairs, numbers)


def count_contexts(vocabulary: DataFrame) -> list[np.ndarray]:
    """Per table the counts of zeros and ones per slot, summed over all training texts."""

    def run(batches):
        tables = [np.zeros(2 << bits) for bits in TABLE_BITS]  # zeros and ones of a slot side by side
        last = len(TABLE_BITS) - 1

        def count(pairs, numbers, chosen):
            bits = Bits(pairs, chosen, once=True)
            weight = bits.weights(numbers)
            ones = bits.value.astype(np.int32)
            for k, slots in bits.slots.items():
                tables[k] += np.bincount(slots * 2 + ones, weight, len(tables[k]))

        for pairs, numbers in _blocks(batches, COUNTED_BYTES, across=True):
            count(pairs, numbers, [last])
            # All other contexts lie within the word: its kinds count together.  A block holds all kinds of a word but for its ends.
            total: dict[bytes, float] = {}
            for (_, word), number in zip(pairs, numbers.tolist(), strict=True):
                total[word] = total.get(word, 0.0) + number
            count([(0, word) for word in total], np.fromiter(total.values(), np.float64, len(total)), range(last))
        for k, table in enumerate(tables):
            both = table.reshape(-1, 2).T
            for start in range(0, both.shape[1], CHUNK):
                part = both[:, start : start + CHUNK].astype(np.float32)
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([start], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "start", "counts"]
                    )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(part, np.float32).astype(np.float64) for part in rows["counts"])
        return pd.DataFrame({"k": rows["k"][:1], "start": rows["start"][:1], "counts": [total.astype(np.float32).tobytes()]})

    spec = "k int, start int, counts binary"
    tables = [np.zeros((2, 1 << bits), np.float32) for bits in TABLE_BITS]
    for row in vocabulary.mapInArrow(run, spec).groupBy("k", "start").applyInPandas(add, spec).collect():
        part = np.frombuffer(row["counts"], np.float32).reshape(2, -1)
        tables[row["k"]][:, row["start"] : row["start"] + part.shape[1]] = part
    return tables


def first_refinement() -> np.ndarray:
    """Pseudo counts that leave the mixed probability as it is."""
    center = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    return np.stack([np.tile(20 * (1 - center), (256, 1)), np.tile(20 * center, (256, 1))])


def learn_mixing(vocabulary: DataFrame, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gated weights, learned online by each task over its words and averaged; and the refinement's summed counts."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(tables)
    size = len(TABLE_BITS)
    start_weight = 0.25

    def run(batches):
        counts = shared.value
        weights, curve = np.full((GATES, size), start_weight), np.tile(FIRM * np.eye(size), (GATES, 1, 1))
        refined, mass, turn = np.zeros((2, 256, STEPS)), np.zeros(GATES), 0
        for pairs, numbers in _blocks(batches):
            bits = Bits(pairs, once=True)
            weight = bits.weights(numbers)
            value = bits.value
            inputs = np.empty((size, len(value)), np.float32)
            for k, slots in bits.slots.items():  # the occurrence itself is taken out
                zeros = np.maximum(counts[k][0].take(slots) - (1 - value), 0)
                ones = np.maximum(counts[k][1].take(slots) - value, 0)
                inputs[k] = np.log((ones + np.float32(BASE_COUNT)) / (zeros + np.float32(BASE_COUNT)))
                if k == PREFIX:
                    gate = bits.gate(zeros + ones)
            for start in range(0, len(value), BATCH):
                part = slice(start, start + BATCH)
                at, x, y, n = gate[part], inputs[:, part], value[part], weight[part]
                total = np.clip(sum(weights[:, k].astype(np.float32).take(at) * x[k] for k in range(size)), -15, 15)
                guess = 1 / (1 + np.exp(-total))
                gap = n * (y - guess)
                move = np.stack([np.bincount(at, gap * x[k], GATES) for k in range(size)], axis=1)
                if turn % CURVE_EVERY == 0:
                    bend = CURVE_EVERY * n * np.maximum(guess * (1 - guess), 1e-4)
                    for k, l in zip(*np.tril_indices(size), strict=True):  # the curvature, summed so far
                        add = np.bincount(at, bend * x[k] * x[l], GATES)
                        curve[:, k, l] += add
                        if k != l:
                            curve[:, l, k] += add
                turn += 1
                weights += np.linalg.solve(curve, move[:, :, None])[:, :, 0]
                mass += np.bincount(at, n, GATES)
                spot = bits.node[part] * STEPS + step_of(total)
                for v, chosen in ((0, y == 0), (1, y > 0)):
                    refined[v] += np.bincount(spot[chosen], n[chosen], 256 * STEPS).reshape(256, STEPS)
        rows = [(0, g, np.r_[weights[g] * mass[g], mass[g]]) for g in range(GATES)] + [(1, node, refined[:, node].ravel()) for node in range(256)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
            names=["what", "place", "sums"],
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(part) for part in rows["sums"])
        return pd.DataFrame({"what": rows["what"][:1], "place": rows["place"][:1], "sums": [total.tobytes()]})

    spec = "what int, place int, sums binary"
    weights, refined = np.full((GATES, size), start_weight), first_refinement()
    for row in vocabulary.mapInArrow(run, spec).groupBy("what", "place").applyInPandas(add, spec).collect():  # one row per gate and node
        sums = np.frombuffer(row["sums"])
        if row["what"] == 1:
            refined[:, row["place"]] += sums.reshape(2, STEPS)
        elif sums[-1] > 0:
            weights[row["place"]] = sums[:-1] / sums[-1]
    shared.unpersist()
    return weights, refined


def price_pairs(vocabulary: DataFrame, model: Model) -> DataFrame:
    """(word, kind, n, times, bits): the size of each (kind, word) pair of any text, and how often its word and itself occur in texts to learn from."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        parts, held = [], 0

        def rows():
            words, kinds, n, times = (np.concatenate(x) if i else [word for part in x for word in part] for i, x in enumerate(zip(*parts, strict=True)))
            bits = model.sizes(list(zip(kinds.tolist(), words, strict=True)))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(n), pa.array(times), pa.array(bits)], names=["word", "kind", "n", "times", "bits"]
            )
            for start in range(0, len(words), OUT_ROWS):
                yield batch.slice(start, OUT_ROWS)

        for batch in batches:
            row, kind = np.nonzero((batch.column("kinds").to_numpy()[:, None] >> np.arange(KINDS)) & 1)
            counts = np.stack([batch.column(f"k{i}").to_numpy() for i in range(KINDS)], axis=1)
            words = batch.column("word").take(pa.array(row)).to_pylist()
            parts.append((words, kind, batch.column("n").to_numpy()[row], counts[row, kind]))
            held += sum(map(len, words)) + len(words)
            if held >= PRICED_BYTES:
                yield from rows()
                parts, held = [], 0
        if parts:
            yield from rows()

    return vocabulary.mapInArrow(run, "word binary, kind int, n long, times long, bits double")


def head_of(pairs: DataFrame) -> pa.Table:
    """(word, kind, n, bits) of the most frequent pairs, at most ``HEAD_PAIRS``, as many as a bound on their frequency gives."""
    level = F.floor(F.log2("times") * HEAD_LEVELS)
    total, least = 0, None
    for row in pairs.where("times > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("level")).collect():
        total += row["pairs"]
        if total > HEAD_PAIRS:
            break
        least = row["level"]
    return pairs.where((F.col("times") > 0) & (level >= F.lit(least))).select("word", "kind", "n", "bits").toArrow()


def score(docs: DataFrame, doc_id="doc_id", text="text", held_out=(5, 1)) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row per row of ``docs``.

    A missing text counts as empty: one token, the end mark.  Without training
    texts nothing is known, the base score is 0 and every bit costs one.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = count_pairs(rows.select("text", (crc_fold(F.col("doc_id"), held_out[0]) != held_out[1]).alias("learn")))
    counted = counted.withColumn("n", sum(F.col(f"k{i}") for i in range(KINDS)))
    vocabulary = write_shared(counted.sortWithinPartitions(F.xxhash64("word")), "vocabulary")
    learned = vocabulary.where("n > 0")
    whole = learned.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = whole["n"] or 0, whole["v"]
    below = tokens + 0.5 * (kinds + 1)
    tables = count_contexts(learned)
    model = Model(tables, *learn_mixing(learned, tables))
    del tables
    pairs = write_shared(price_pairs(vocabulary, model), "pairs")
    head = head_of(pairs).combine_chunks()
    head = [
        pa.array([b"%c%b" % pair for pair in zip(head["kind"].to_pylist(), head["word"].to_pylist(), strict=True)], pa.binary()),
        np.r_[np.log10((head["n"].to_numpy() + 0.5) / below), 0.0], np.r_[head["bits"].to_numpy(), 0.0],
    ]
    shared = docs.sparkSession.sparkContext.broadcast(head)
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("bits", pa.float64()),
        ("bytes", pa.int64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("kind", pa.int32()), ("times", pa.int32())]))),
    ])
    spec = (
        "row long, doc_id long, n_tokens long, n_known long, base_score double, bits double, bytes long, "
        "tail array<struct<word:binary,kind:int,times:int>>"
    )

    def run(batches):
        head, base, bits = shared.value  # the last of base and bits, 0, stands for pairs that have to be joined
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for batch in sliced(batches, "text"):
            keys, numbers = pairs_in(batch.column("text"))
            coded = keys.dictionary_encode()
            distinct, codes = coded.dictionary, coded.indices.to_numpy()
            place = pc.fill_null(pc.index_in(distinct, value_set=head), -1).to_numpy()
            starts = np.cumsum(numbers) - numbers
            per_text = lambda values: np.add.reduceat(values[codes], starts)  # noqa: B023, E731
            sizes = np.asarray(pc.binary_length(distinct)).astype(np.int64)
            rare = np.flatnonzero((place < 0)[codes])
            spots, times = np.unique(np.repeat(np.arange(len(numbers)), numbers)[rare] * len(distinct) + codes[rare], return_counts=True)
            kinds, words = parted(distinct.take(pa.array(spots % len(distinct))))
            tail = pa.StructArray.from_arrays([words, kinds, pa.array(times.astype(np.int32))], names=["word", "kind", "times"])
            offsets = np.searchsorted(spots, np.arange(len(numbers) + 1) * len(distinct)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + len(numbers))), batch.column("doc_id"), pa.array(numbers), pa.array(per_text((place >= 0).astype(np.int64))),
                pa.array(per_text(base[place])), pa.array(per_text(bits[place])), pa.array(per_text(sizes) - 1), pa.ListArray.from_arrays(pa.array(offsets), tail),
            ], schema=schema)
            number += len(numbers)

    scored = write_shared(rows.mapInArrow(run, spec), "scored")
    tail = scored.select("row", F.inline("tail")).join(pairs.select("word", "kind", "n", "bits"), ["word", "kind"])
    value = F.log10((F.col("n") + 0.5) / F.lit(below))
    tail = tail.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * value).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.col("bits")).alias("tail_bits"),
    )
    joined = scored.join(tail, F.col("row") == F.col("_row"), "left")
    bits = F.col("bits") + F.coalesce("tail_bits", F.lit(0.0))
    return joined.select(
        "doc_id", (crc_fold(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        (-bits * math.log10(2)).alias("score"), (bits / F.col("bytes")).alias("bits_per_byte"),
    )
