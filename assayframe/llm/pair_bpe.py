"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch are laid out as one row of symbols.  An index maps the
rank of every mergeable pair to all its positions.  Active ranks are taken in
ascending order; all occurrences of a pair are merged at once, and the pairs
that come into being left and right of them are added to the lists of their
own ranks.  No rule of a BPE vocabulary can use a symbol that a later rule
makes, so a new pair always has a higher rank, and one pass in ascending order
gives what merging word by word gives.

A word's ids do not depend on its neighbours, so each distinct word is encoded
once per cache; texts are then joined from words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import sliced, small_batches, texts_of, tidy

# Distinct words, and distinct pieces of words, that a task remembers.
CACHE_WORDS = 120_000
# Bytes of text whose new words are encoded together.
SLICE_BYTES = 6 << 20
# White space as Unicode has it, and the pieces of a text that are encoded on their own.
BLANKS = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANKS}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(byte) if byte in shown else chr(next(free)) for byte in range(256)]


class Vocabulary:
    """Ids and merge ranks of a BPE file in the JSON form of the tokenizers library."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as source:
            whole = json.load(source)
        model = whole["model"]
        ids, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        letters = byte_letters()
        self.inner = np.array([ids[letter] for letter in letters], dtype=np.int64)
        self.last = np.array([ids[letter + self.end] for letter in letters], dtype=np.int64)
        self.tokens = {number: token for token, number in ids.items()}
        self.special = {token["content"]: token["id"] for token in whole.get("added_tokens", [])}
        self.tokens |= {number: token for token, number in self.special.items()}
        self.shown = [self.tokens.get(i, "").encode() + b" " for i in range(max(self.tokens) + 1)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no rule."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def pieces(self, words: list[bytes]) -> Iterator[list[str]]:
        """The pieces of each word's normal form; a special token is a piece of its own, in capitals as written."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        parts = self.split.split(joined) if self.split else [joined]
        held: list[str] = []
        for part in parts:
            if part in self.special:
                held.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form
            for piece in PIECE.findall(part.lower()):
                if piece == "\n":
                    yield held
                    held = []
                else:
                    held.append(piece)
        yield held


def merge_all(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The ids of all pieces in a row, and where each piece ends, by the pair occurrence index over all of them."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    total = len(raw)
    ends = np.cumsum(lengths)
    symbol = vocabulary.inner[raw]
    symbol[ends - 1] = vocabulary.last[raw[ends - 1]]
    after = np.arange(1, total + 1)  # the next symbol of the same piece, or total
    after[ends - 1] = total
    before = np.arange(-1, total - 1)
    before[ends - lengths] = -1
    alive = np.ones(total, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions into the lists of their ranks."""
        at = at[after[at] < total]
        if not len(at):
            return
        rank = vocabulary.rank_of(symbol[at], symbol[after[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for value, group in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if value not in index:
                index[value] = []
                heapq.heappush(active, value)
            index[value].append(group)

    add(np.arange(total))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        following = after[at]
        valid = alive[at] & (symbol[at] == a) & (following < total)
        at = at[valid]
        at = np.unique(at[symbol[after[at]] == b])
        if a == b and len(at) > 1:  # in a run of the same symbol every other pair, from the left
            joined = after[at[:-1]] == at[1:]
            start = np.r_[True, ~joined]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = vocabulary.made[rank]
        alive[gone] = False
        onward = after[gone]
        after[at] = onward
        inside = onward < total
        before[onward[inside]] = at[inside]
        left = before[at]
        add(np.concatenate([at, left[left >= 0]]))
    ids = symbol[alive].astype("<u4")
    counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
    return ids, np.cumsum(counts).tolist()


class Encoder:
    """Encodes texts word by word, new words slice by slice.

    Two bounded caches hold ids and decoded forms of words and of their pieces.
    When one is full, what the current slice asked for again stays.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS) -> None:
        self.vocabulary, self.cache_words = vocabulary(file), cache_words
        self.ids: dict[bytes, bytes] = {b"": b""}
        self.shown: dict[bytes, bytes] = {b"": b""}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def room(self, cache: dict, wanted, new: int) -> dict:
        return cache if len(cache) + new <= self.cache_words else {key: cache[key] for key in wanted if key in cache}

    def learn_pieces(self, asked: dict[str, None]) -> None:
        missing = [piece for piece in asked if piece not in self.pieces]
        self.pieces = self.room(self.pieces, asked, len(missing))
        special, shown = self.vocabulary.special, self.vocabulary.shown
        plain = []
        for piece in missing:
            if piece in special:
                self.pieces[piece] = (special[piece].to_bytes(4, "little"), shown[special[piece]])
            else:
                plain.append(piece)
        if plain:
            ids, ends = merge_all(self.vocabulary, [piece.encode() for piece in plain])
            packed, texts, start = ids.tobytes(), [shown[i] for i in ids.tolist()], 0
            for piece, end in zip(plain, ends, strict=True):
                self.pieces[piece] = (packed[4 * start : 4 * end], b"".join(texts[start:end]))
                start = end

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that are not in the cache yet."""
        new = [word for word in words if word not in self.ids]
        if not new:
            return
        self.ids, self.shown = self.room(self.ids, words, len(new)), self.room(self.shown, words, len(new))
        parts = list(self.vocabulary.pieces(new))
        self.learn_pieces({piece: None for some in parts for piece in some})
        known, ids, shown = self.pieces, self.ids, self.shown
        for word, some in zip(new, parts, strict=True):
            if len(some) == 1:
                ids[word], shown[word] = known[some[0]]
            else:
                both = [known[piece] for piece in some]
                ids[word], shown[word] = b"".join([i for i, _ in both]), b"".join([t for _, t in both])

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, bytes]]:
        """Per text its ids as little-endian 32-bit integers and its decoded form in UTF-8."""
        split = [text.split() if text else [] for text in texts]
        asked: set[bytes] = set()
        for words in split:
            asked.update(words)
        self.learn(asked)
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        for words in split:
            yield b"".join(map(ids, words)), b"".join(map(shown, words))[:-1]


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    """One vocabulary per Python worker; the caches of words go with their task."""
    return Vocabulary(file)


def encode_texts(docs: DataFrame, file: str, doc_id="doc_id", text="text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    A missing text counts as empty: no ids, an empty decoded text.  Every row is
    encoded, repeated ones too.  ``file`` is a path that every executor can read.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary())] if keep_ids else []
    schema = pa.schema(fields)

    def run(batches):
        engine = Encoder(file)
        for batch in sliced(batches, "text", SLICE_BYTES):
            both = list(engine.encode(texts_of(batch.column("text"))))
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(ids) // 4 for ids, _ in both], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in both], pa.string()),
                pa.array([hashlib.sha256(shown).hexdigest() for _, shown in both], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.array([ids for ids, _ in both], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), spec)


def decode_ids(ids: bytes, file: str) -> str:
    """The text that stands for the ids: their tokens with one blank between them, special tokens included."""
    shown = vocabulary(file).shown
    return b"".join([shown[i] for i in np.frombuffer(ids, "<u4").tolist()])[:-1].decode()
