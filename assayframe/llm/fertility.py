"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes every word of a text.  Three
figures follow: characters per token, the share of byte-fallback tokens and the
entropy of the tokens.  What is usual differs by language and, for the entropy,
by length, so medians and quartile ranges are taken per language and length
class over all texts that pass the base rules, and a text far outside its band
is rejected.  Where a language has too few texts for a band (or is not known),
the band of the text's script counts, and where that has too few, a wide fixed
one.  Texts of other scripts never enter a band.

Pieces of the vocabulary never span two words, so each distinct word is encoded
once per cache.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import sliced, small_batches, texts_of
from assayframe.sources.storage import write_shared

CACHE_WORDS = 150_000
# Base rules: fewest words, and the percentage of words in repeated three-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
# The bands, in quartile ranges from the median: each figure alone, their sum, and the upper side.
LOW, LOW_SUM, HIGH = -4.0, -4.0, 8.0
MOST_BYTES_OVER = 0.2
# Texts that a band needs; with fewer, the band of the language, then of the script, then the wide one is used.
FEWEST_TEXTS = 40
# Rows that a quartile of a band may be off, as a share of the band's texts: at most one in this many.
ACCURACY = 2000
# The wide bands: middle and range of characters per token and entropy, usual byte share.  Scripts beyond the vocabulary fall back to bytes altogether.
WIDE_LATIN, WIDE_OTHER = (2.8, 0.4, 7.0, 1.5, 0.0), (1.2, 0.6, 7.0, 1.5, 1.0)
# Least quartile ranges, so that a band of equal texts is not a line.
LEAST_RANGE = {"chars_per_token": 0.02, "entropy": 0.04}
SYMBOLS = re.compile(rb"[#*$%&|<>]")
EDGES = b" \t\n\x0b\x0c\r"
# First code points of the scripts told apart, in ascending order.
SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0x1000, "other"), (0x1E00, "Latin"), (0x2000, "other"), (0x3040, "Kana"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other")]


def script_of(text: bytes) -> str:
    """The script of most letters of the whole text."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    points = points[(points >= 128) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(points):
        return "none"
    at = np.searchsorted([start for start, _ in SCRIPTS], points, side="right") - 1
    return SCRIPTS[int(np.bincount(at, minlength=len(SCRIPTS)).argmax())][1]


def repeated_words(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    base = int(ids.max()) + 1
    if base < 1 << 21:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        key = pair[:-1] * base + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 2, bool)
    marked = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for shift in range(3):
        twice[marked + shift] = True
    return int(twice.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(EDGES)]
    return len(lines) - len(set(lines))


class Fertility:
    """Token ids of words by a sentencepiece model, with a bounded cache."""

    def __init__(self, file: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}

    def learn(self, words: dict[bytes, int]) -> None:
        new = [word for word in words if word not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {word: self.cache[word] for word in words if word in self.cache}
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            ids = self.model.encode([word.decode("utf-8", "replace") for word in part], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            packed = np.fromiter((i for some in ids for i in some), self.kind, int(lengths.sum())).tobytes()
            stops = (np.cumsum(lengths) * self.kind.itemsize).tolist()
            at = 0
            for word, stop in zip(part, stops, strict=True):
                self.cache[word] = packed[at:stop]
                at = stop

    def figures(self, words: list[bytes]) -> tuple[int, int, float]:
        """Tokens, byte tokens and the entropy of the tokens in bits."""
        tokens = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), self.kind)
        if not len(tokens):
            return 0, 0, 0.0
        counts = np.bincount(tokens) if len(tokens) > 4000 else np.unique(tokens, return_counts=True)[1]
        share = counts[counts > 0] / len(tokens)
        return len(tokens), int(self.is_byte[tokens].sum()), float(-(share * np.log2(share)).sum())


SPEC = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "language string, script string, n_tokens long, byte_share double, chars_per_token double, entropy double"
)


def measure(docs: DataFrame, file: str, doc_id="doc_id", text="text", lang: str | None = "lang") -> DataFrame:
    """Base counts and fertility figures of every whole text; a missing or empty text has zeros and no figures."""
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([field.split()[0] for field in SPEC.split(", ")], kinds, strict=True)))

    def run(batches):
        engine = Fertility(file)
        for batch in sliced(batches, "text"):
            texts = texts_of(batch.column("text"))
            split = [text.split() if text else [] for text in texts]
            place: dict[bytes, int] = {}
            ids = [np.fromiter([place.setdefault(word, len(place)) for word in words], np.int64, len(words)) for words in split]
            engine.learn(place)
            rows = []
            for key, text, language, words, places in zip(
                batch.column("doc_id").to_pylist(), texts, batch.column("lang").to_pylist(), split, ids, strict=True
            ):
                text = text or b""
                raw = np.frombuffer(b"".join(words), np.uint8)
                chars = int(((raw & 0xC0) != 0x80).sum())  # bytes that begin a code point
                repeated, (tokens, fallback, entropy) = repeated_words(places), engine.figures(words)
                failed = len(words) < FEWEST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
                rows.append((
                    key, len(words), chars, len(SYMBOLS.findall(text)), repeated_lines(text), repeated, failed,
                    language, script_of(text), tokens,
                    fallback / tokens if tokens else None, chars / tokens if tokens else None, entropy if tokens else None,
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema
            )

    language = F.lit(None).cast("string") if lang is None else F.col(lang).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), language.alias("lang"))
    return small_batches(rows).mapInArrow(run, SPEC)


def length_class(tokens: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(tokens, F.lit(1)))), F.lit(6)), F.lit(14)).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """Median and quartile range of each figure per language and length class, per language, per script and length class, and per script."""
    quartiles = lambda name: F.percentile_approx(name, [0.25, 0.5, 0.75], ACCURACY)
    wanted = [quartiles(name).alias(name) for name in ("chars_per_token", "entropy", "byte_share")] + [F.count(F.lit(1)).alias("n")]
    good = measured.where(~F.col("base_failed")).withColumn("size", length_class(F.col("n_tokens")))
    # Each text counts in four groups; map-side aggregation leaves one row per task and group.
    groups = F.array(*[
        F.struct(F.lit(by).alias("by"), F.col(by).alias("name"), size.alias("size"))
        for by in ("language", "script") for size in (F.col("size"), F.lit(-1))
    ])
    good = good.select("chars_per_token", "entropy", "byte_share", F.explode(groups).alias("group")).where("group.name IS NOT NULL")
    return good.groupBy("group").agg(*wanted).where(F.col("n") >= FEWEST_TEXTS).select("group.*", "chars_per_token", "entropy", "byte_share")


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: false where a base rule fails or a figure leaves its band.

    A quartile may be off by one in ``ACCURACY`` of its band's texts, so a text
    at the very edge of a band can be judged either way by another dealing of rows.
    """
    spread = lambda name: F.greatest(F.col(name)[2] - F.col(name)[0], F.lit(LEAST_RANGE.get(name, 0.0)))
    band = F.struct(
        *[x for name in ("chars_per_token", "entropy") for x in (F.col(name)[1].alias(f"{name}_mid"), spread(name).alias(f"{name}_range"))],
        F.col("byte_share")[1].alias("byte_mid"),
    )
    known = write_shared(bands(measured).select("by", "name", "size", band.alias("band")), "fertility-bands")
    figures = known.schema["band"].dataType.names
    rows = measured.withColumn("size", length_class(F.col("n_tokens")))
    held = []
    for by in ("language", "script"):
        for fine in (True, False):
            held.append(f"_{by}_{fine}")
            one = known.where((F.col("by") == by) & (F.col("size") >= 0 if fine else F.col("size") < 0))
            one = one.select(F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("band").alias(held[-1]))
            match = F.col(by) == F.col("_name")
            rows = rows.join(one, match & (F.col("size") == F.col("_size")) if fine else match, "left").drop("_name", "_size")
    wide = [F.struct(*[F.lit(x).alias(name) for name, x in zip(figures, values, strict=True)]) for values in (WIDE_LATIN, WIDE_OTHER)]
    last = F.when(F.col("script").isin("Latin", "none"), wide[0]).otherwise(wide[1])
    rows = rows.withColumn("_band", F.coalesce(*held, last))
    far = {name: (F.col(name) - F.col(f"_band.{name}_mid")) / F.col(f"_band.{name}_range") for name in LEAST_RANGE}
    outside = (F.col("byte_share") > F.col("_band.byte_mid") + MOST_BYTES_OVER) | (sum(far.values()) < LOW_SUM)
    for value in far.values():
        outside = outside | (value < LOW) | (value > HIGH)
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))  # a text without a token has failed before
    return rows.select(*measured.columns, kept.alias("kept"))


def judge(docs: DataFrame, file: str, **names) -> DataFrame:
    """Base counts, fertility figures and the verdict for every document, one row per row of ``docs``.

    A missing, empty or blank text has zeros and no figures and fails the base
    rules.  Repeated rows are judged alike and all count in their band; a missing
    language leaves the band of the script; a very long text is measured whole.
    """
    return verdicts(write_shared(measure(docs, file, **names), "fertility"))
