"""Token ids in files of fixed-width bits.

An id takes the least number of bits that hold the largest id of the vocabulary.
64 ids fill exactly ``bits`` machine words, so packing and unpacking are a fixed
number of numpy operations on whole columns, however many ids there are.

A shard is one standalone image of bytes, little-endian throughout:

====================  =====================================================
8 bytes               ``AFIDS01`` and a zero byte
4 x uint32            bits per id, ids per block, documents, blocks
uint64                ids
documents x int64     document ids, 0 where missing
documents x uint8     1 where the document has an id
documents x uint64    where each document ends, in ids from the shard's start
blocks x uint64       where each block begins, in bytes from the payload's start
payload               the blocks; each fills up whole groups of 64 ids
====================  =====================================================

Shards are written in ascending order of document id as rows of a Parquet
folder, so Spark's committer and any store it can write to serve them, and lost
tasks leave nothing behind.  ``export`` turns them into one plain file each.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.llm.batches import sliced
from assayframe.sources.storage import shared_folder

MAGIC, HEAD = b"AFIDS01\x00", struct.Struct("<8s4IQ")
GROUP = 64
# Ids of a block, and of a shard; a document is never cut, so a longer one is a shard of its own.
BLOCK_IDS, SHARD_IDS = 4096, 1 << 20
# Bytes of text encoded at once, and distinct words that a Python worker remembers.
SLICE_BYTES, CACHE_WORDS = 4 << 20, 500_000
# Words whose ids are gathered at once, and bytes of ids of a range.
GATHER_WORDS, PART_BYTES = 1 << 20, 32 << 20
END_ID = 1


def bits_for(largest: int) -> int:
    """The least width that holds every id up to ``largest``."""
    return max(1, int(largest).bit_length())


def whole_bytes(bits: int) -> str:
    """The least little-endian integer type that holds ids of this width."""
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` side by side in ``bits`` each, filled up with zeros to whole groups of 64."""
    groups = -(-len(ids) // GROUP)
    columns = np.zeros((groups, GROUP), np.uint64)
    columns.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for place in range(GROUP):
        word, shift = divmod(place * bits, 64)
        words[:, word] |= columns[:, place] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= columns[:, place] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes | memoryview, bits: int) -> np.ndarray:
    """The ids of whole groups, those that fill up included."""
    words = np.frombuffer(payload, "<u8").reshape(-1, bits)
    columns = np.empty((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for place in range(GROUP):
        word, shift = divmod(place * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        columns[:, place] = value & mask
    return columns.reshape(-1)


def shard_image(doc_ids: list[int | None], parts: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of a shard with these documents; ``block_ids`` is a multiple of 64."""
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ends = np.cumsum([len(part) for part in parts], dtype=np.uint64)
    blocks = -(-len(ids) // block_ids)
    offsets = np.arange(blocks, dtype=np.uint64) * np.uint64(block_ids * bits // 8)
    head = HEAD.pack(MAGIC, bits, block_ids, len(parts), blocks, len(ids))
    keys = np.array([0 if key is None else key for key in doc_ids], "<i8")
    known = np.array([key is not None for key in doc_ids], np.uint8)
    return b"".join([head, keys.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), pack(ids, bits)])


class Shard:
    """Reads a shard from bytes, or from a memory map of its file; only the blocks asked for are unpacked."""

    def __init__(self, image: bytes | memoryview) -> None:
        self.image = memoryview(image)
        magic, self.bits, self.block_ids, documents, blocks, self.n_ids = HEAD.unpack_from(self.image)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at = HEAD.size
        self.keys, at = np.frombuffer(self.image, "<i8", documents, at), at + 8 * documents
        self.known, at = np.frombuffer(self.image, np.uint8, documents, at), at + documents
        self.ends, at = np.frombuffer(self.image, "<u8", documents, at).astype(np.int64), at + 8 * documents
        self.offsets, at = np.frombuffer(self.image, "<u8", blocks, at).astype(np.int64), at + 8 * blocks
        self.payload = self.image[at:]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else len(self.payload)
        found = unpack(self.payload[int(self.offsets[first]) : end], self.bits)
        base = first * self.block_ids
        return found[start - base : stop - base]

    def document(self, number: int) -> np.ndarray:
        """The ids of one document of the shard."""
        return self.ids(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))

    def doc_id(self, number: int) -> int | None:
        return int(self.keys[number]) if self.known[number] else None


@lru_cache(maxsize=2)
def tokenizer(file: str):
    """The vocabulary file as the tokenizers library reads it, without truncation or padding; one thread per task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(file)
    found.no_truncation()
    found.no_padding()
    return found


def largest_id(file: str) -> int:
    return max(max(tokenizer(file).get_vocab(with_added_tokens=True).values()), END_ID)


def byte_letters() -> dict[int, int]:
    """What the vocabulary writes for each byte: printable ones stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {byte: 256 + place for place, byte in enumerate(sorted(set(range(256)) - set(shown)))}


class WordIds:
    """Ids of texts, each distinct word encoded once while a bounded cache holds it.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its words in order.  A word of Latin letters, perhaps with
    punctuation after it, needs no normal form but lower case and falls into
    those two pieces, so its letters go straight to the library's merges; any
    other word goes through the library as a whole.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS) -> None:
        self.tokenizer, self.cache_words = tokenizer(file), cache_words
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.held: dict[bytes, bytes] = {}
        # Letters are shared by words in other cases and with other punctuation.
        self.merged: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {"": b""}

    def letters_ids(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters and punctuation after them; None for any other word."""
        letters = word.rstrip(".,;:!?")
        lower = letters.lower()
        ids = self.merged.get(lower)
        if ids is None or len(lower) != len(letters):
            if not lower.isalpha() or not (lower.isascii() or max(lower) < "\u0250") or len(lower) != len(letters):
                return None
            shown = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [token.id for token in self.merge(shown)]).tobytes()
            if len(self.merged) >= self.cache_words // 2:
                self.merged = {}
            self.merged[lower] = ids
        if len(letters) == len(word):
            return ids
        rest = word[len(letters) :]
        if rest not in self.rest:
            if len(self.rest) >= self.cache_words:
                self.rest = {"": b""}
            self.rest[rest] = array("I", self.tokenizer.encode(rest, add_special_tokens=False).ids).tobytes()
        return ids + self.rest[rest]

    def words(self, asked: list[bytes]) -> list[bytes]:
        """The ids of distinct words, as 32-bit integers of this machine's byte order."""
        new = [word for word in asked if word not in self.held]
        if len(self.held) + len(new) > self.cache_words:
            self.held = {word: self.held[word] for word in asked if word in self.held}
        others: list[tuple[bytes, str]] = []
        for word in new:
            shown = word.decode("utf-8", "replace")
            ids = self.letters_ids(shown)
            if ids is None:
                others.append((word, shown))
            else:
                self.held[word] = ids
        encoded = self.tokenizer.encode_batch_fast([shown for _, shown in others], add_special_tokens=False)
        for (word, _), one in zip(others, encoded, strict=True):
            self.held[word] = array("I", one.ids).tobytes()
        return [self.held[word] for word in asked]

    def encode(self, texts: pa.Array, end: int = END_ID) -> Iterator[np.ndarray]:
        """Per text its ids, the end id last."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        parts = [*self.words(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()), array("I", [end]).tobytes()]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, starts = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(lengths) - lengths
        flat, starts = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(lengths) - lengths
        ends = np.cumsum(np.asarray(pc.list_value_length(split)))
        words = np.insert(np.asarray(coded.indices), ends, len(parts) - 1)
        upto = np.r_[0, np.cumsum(lengths[words])]
        ids = np.empty(upto[-1], np.uint32)
        for at in range(0, len(words), GATHER_WORDS):
            some, before = words[at : at + GATHER_WORDS], upto[at : at + GATHER_WORDS + 1]
            from_ = np.repeat(starts[some] - before[: len(some)], lengths[some])
            ids[before[0] : before[len(some)]] = flat[from_ + np.arange(before[0], before[len(some)])]
        yield from np.split(ids, upto[ends + np.arange(1, len(ends) + 1)][:-1]) if len(ends) else []


@lru_cache(maxsize=1)
def engine_of(file: str) -> WordIds:
    """One per Python worker: tasks that follow find the words of those before."""
    return WordIds(file)


def encoded_docs(docs: DataFrame, file: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tie, n_tokens, ids): every text's ids with the end id, in whole bytes; ``tie`` orders documents of one id."""
    kind = whole_bytes(bits_for(largest_id(file)))
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = engine_of(file)
        for batch in sliced(batches, "text", SLICE_BYTES):
            parts = list(engine.encode(batch.column("text")))
            columns = [
                batch.column("doc_id"), batch.column("tie"), pa.array([len(part) for part in parts], pa.int64()),
                pa.array([part.astype(kind).tobytes() for part in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def write_ids(docs: DataFrame, file: str, path: str, doc_id="doc_id", text="text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write their shards under ``path``, in ascending order of document id.

    ``path/shards`` has (part, number, n_ids, n_docs, image) and ``path/index``
    (part, number, first, n_ids, n_docs), where ``first`` counts the ids of all
    shards before; ``path/encoded`` holds the ids before they were ordered.  Missing document ids come first; documents of one id are in
    the order of their text's hash.  A missing text counts as empty: its only id
    is the end.
    """
    spark = docs.sparkSession
    bits = bits_for(largest_id(file))
    kind = whole_bytes(bits)
    encoded_docs(docs, file, doc_id, text).write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    size = encoded.agg(F.sum(F.col("n_tokens") * int(kind[2]) + 24)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def shard() -> pa.RecordBatch:
            values = [part, number, size, len(keys), shard_image(keys, held, bits)]
            return pa.RecordBatch.from_arrays([pa.array([value], kind.type) for value, kind in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, count, raw in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "n_tokens", "ids")), strict=True):
                if keys and size + count > shard_ids:
                    yield shard()
                    keys, held, size, number = [], [], 0, number + 1
                keys.append(key)
                held.append(np.frombuffer(raw, kind))
                size += count
        if keys:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranges = encoded.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    ranges.mapInArrow(build, "part int, number int, n_ids long, n_docs long, image binary").write.option("compression", "zstd").parquet(f"{path}/shards")
    # Two levels of running counts: over the parts (one row each), and over the shards of a part.
    shards = spark.read.parquet(f"{path}/shards").select("part", "number", "n_ids", "n_docs")
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).withColumn("base", F.coalesce(F.sum("part_ids").over(parts_before), F.lit(0)))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    counted = shards.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(bases.select("part", "base"), "part")
    counted.select("part", "number", (F.col("base") + F.col("within")).alias("first"), "n_ids", "n_docs").write.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the shards under ``path``."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, first in enumerate(batch.column("first").to_pylist()):
                shard = Shard(memoryview(batch.column("image")[row].as_buffer()))
                raw = memoryview(shard.ids().astype("<u4")).cast("B")
                starts = np.r_[0, shard.ends[:-1]] if len(shard.ends) else shard.ends
                sums = [zlib.crc32(raw[4 * start : 4 * end]) for start, end in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                columns = [[shard.doc_id(i) for i in range(len(sums))], starts + first, shard.ends - starts, sums]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(columns, schema, strict=True)], schema=schema)

    shards, index = spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/index")
    joined = shards.select("part", "number", "image").join(index.select("part", "number", "first"), ["part", "number"])
    return joined.select("first", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """The ids from position ``start`` of all shards under ``path``: only the shards that hold them are read, only their blocks unpacked.

    Meant for a window of training; the result comes to the driver.
    """
    stop = start + count
    index = spark.read.parquet(f"{path}/index").where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))
    wanted = index.select("part", "number", "first").orderBy("first").collect()
    if not wanted:
        return np.zeros(0, np.uint32)
    chosen = [(F.col("part") == row["part"]) & (F.col("number") == row["number"]) for row in wanted]
    condition = chosen[0]
    for other in chosen[1:]:
        condition = condition | other
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("ids", pa.binary())])
    firsts = {(row["part"], row["number"]): row["first"] for row in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (part, number) in enumerate(zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), strict=True)):
                first = firsts[part, number]
                ids = Shard(memoryview(batch.column("image")[row].as_buffer())).ids(max(0, start - first), stop - first)
                yield pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip([part, number, ids.tobytes()], schema, strict=True)], schema=schema)

    rows = spark.read.parquet(f"{path}/shards").where(condition).select("part", "number", "image").mapInArrow(run, "part int, number int, ids binary")
    found = {(row["part"], row["number"]): row["ids"] for row in rows.collect()}
    return np.frombuffer(b"".join(found[row["part"], row["number"]] for row in wanted), np.uint32)


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(file, first, n_ids): each shard under ``path`` as one plain file of ``folder``, which all tasks can open, for memory maps.

    A file appears whole or not at all, under a name that a repeated task gives again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for row, (part, number) in enumerate(zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), strict=True)):
                name = os.path.join(folder, f"{part:06d}-{number:06d}.ids")
                with open(f"{name}.{uuid.uuid4().hex}", "wb") as target:
                    target.write(batch.column("image")[row].as_buffer())
                os.replace(target.name, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("first"), batch.column("n_ids")], names=["file", "first", "n_ids"])

    shards, index = spark.read.parquet(f"{path}/shards").select("part", "number", "image"), spark.read.parquet(f"{path}/index")
    return shards.join(index, ["part", "number"]).select("part", "number", "first", "n_ids", "image").mapInArrow(run, "file string, first long, n_ids long")


def round_trip(docs: DataFrame, file: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, written to the shared folder as packed ids and read back.

    ``start`` counts the ids of all documents before, in ascending order of
    document id: missing ids first, rows of one id by the hash of their text.  A
    missing or blank text holds the end id only.  Every row counts, repeated ones
    too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/packed-ids-{uuid.uuid4().hex}"
    write_ids(docs, file, path, doc_id, text)
    return read_documents(spark, path)
