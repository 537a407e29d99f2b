"""Language ID by a byte convolutional network.

A text is lower-cased, encoded as UTF-8 and cut into windows of fixed length
that together cover all of it.  Each window goes through a byte embedding,
filters of several widths, maximum pooling over its positions and a softmax.
The windows of a text vote with their log-probabilities, weighted by the
letters they hold.  Training is plain numpy with Adam on a bounded sample of
labelled texts (``DOCS_PER_LANGUAGE``, ``WINDOWS_PER_DOC``); prediction is an
Arrow batch function over every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import crc_fold, sliced, small_batches, tidy

LENGTH = 192
CHANNELS = 8
WIDTHS = {2: 8, 3: 14, 4: 16, 5: 14}
# The bound of the training sample: labelled texts per language, and windows of each.
DOCS_PER_LANGUAGE = 1500
WINDOWS_PER_DOC = 4
MOST_LANGUAGES = 256
EPOCHS = 5
UNKNOWN = "und"
# Bytes of a lower-cased text that belong to letters: a to z and everything outside ASCII.
LETTER = np.zeros(256, np.float32)
LETTER[ord("a") : ord("z") + 1] = 1
LETTER[128:] = 1
HAS_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights; ``kernel`` holds all filters at the largest width, the narrow ones padded with zeros."""

    languages: list[str]
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filter responses of each window and the patches they come from."""
        wide = max(WIDTHS)
        padded = np.zeros((len(windows), windows.shape[1] + wide - 1), np.uint8)
        padded[:, : windows.shape[1]] = windows
        embedded = self.embedding[padded].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.sliding_window_view(embedded, wide * CHANNELS, axis=1)[:, ::CHANNELS]
        patches = np.ascontiguousarray(patches)
        return patches, patches.reshape(-1, wide * CHANNELS) @ self.kernel

    def log_probabilities(self, windows: np.ndarray, chunk: int = 96) -> np.ndarray:
        found = np.empty((len(windows), len(self.languages)), np.float32)
        for start in range(0, len(windows), chunk):
            part = windows[start : start + chunk]
            _, response = self.hidden(part)
            pooled = np.maximum(response.reshape(len(part), -1, response.shape[1]).max(axis=1) + self.bias, 0)
            logits = pooled @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            found[start : start + chunk] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return found


def cut(text: bytes, length: int = LENGTH) -> np.ndarray:
    """All windows of a text; the last one is padded with zero bytes."""
    count = max(1, -(-len(text) // length))
    flat = np.zeros(count * length, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return flat.reshape(count, length)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy, classes weighted evenly; the embedding of the padding byte stays zero."""
    rng = np.random.default_rng(seed)
    wide, filters = max(WIDTHS), sum(WIDTHS.values())
    mask = np.zeros((wide, CHANNELS, filters), np.float32)
    at = 0
    for width, count in WIDTHS.items():
        mask[:width, :, at : at + count] = 1
        at += count
    mask = mask.reshape(wide * CHANNELS, filters)
    scale = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    net = Network(
        languages, scale(256, CHANNELS, s=0.5), scale(wide * CHANNELS, filters, s=0.25) * mask, np.zeros(filters, np.float32),
        scale(filters, len(languages), s=0.2), np.zeros(len(languages), np.float32),
    )
    net.embedding[0] = 0
    names = ["embedding", "kernel", "bias", "out", "out_bias"]
    first = {name: np.zeros_like(getattr(net, name)) for name in names}
    second = {name: np.zeros_like(getattr(net, name)) for name in names}
    share = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    weight = (len(labels) / np.maximum(share, 1) / len(languages))[labels]
    batch, step = 64, 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            patches, response = net.hidden(windows[rows])
            response = response.reshape(len(rows), -1, filters)
            best = response.argmax(axis=1)
            pooled = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.bias
            active = np.maximum(pooled, 0)
            logits = active @ net.out + net.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            delta = odds / odds.sum(axis=1, keepdims=True)
            delta[np.arange(len(rows)), labels[rows]] -= 1
            delta *= (weight[rows] / len(rows))[:, None]
            back = (delta @ net.out.T) * (pooled > 0)
            picked = patches[np.arange(len(rows))[:, None], best]  # rows x filters x patch
            d_patch = back[:, :, None] * net.kernel.T[None]
            d_embedding = np.zeros_like(net.embedding)
            spots = best[:, :, None] + np.arange(wide)
            inside = spots < windows.shape[1]
            chars = np.where(inside, windows[rows][np.arange(len(rows))[:, None, None], np.minimum(spots, windows.shape[1] - 1)], 0)
            np.add.at(d_embedding, chars.ravel(), d_patch.reshape(-1, CHANNELS))
            d_embedding[0] = 0
            grads = {
                "embedding": d_embedding, "kernel": np.einsum("nfp,nf->pf", picked, back) * mask, "bias": back.sum(axis=0),
                "out": active.T @ delta, "out_bias": delta.sum(axis=0),
            }
            step += 1
            rate = 0.004 * (1 - epoch / (epochs + 1))
            for name, grad in grads.items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad * grad - second[name])
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - np.float32(rate) * move.astype(np.float32))
    return net


def fit(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", held_out=(3, 1)) -> Network | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold; None where nothing is labelled."""
    learn = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), held_out[0]) != held_out[1]))
    counts = {row["lang"]: row["count"] for row in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, DOCS_PER_LANGUAGE / n)))])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = learn.where(draw < share).select("text", "lang")

    def windows(batches):
        for batch in sliced(batches, "text"):
            out, names = [], []
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                data = value.lower().encode()
                rng = np.random.default_rng(len(data))
                for turn in range(WINDOWS_PER_DOC):
                    size = LENGTH if turn else int(rng.integers(12, LENGTH))  # one short window, as short texts give
                    start = int(rng.integers(0, max(1, len(data) - size + 1)))
                    piece = data[start : start + size]
                    if piece:
                        out.append(piece)
                        names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["window", "lang"])

    rows = small_batches(sample).mapInArrow(tidy(windows), "window binary, lang string").collect()
    rows.sort(key=lambda row: (row["lang"], bytes(row["window"])))  # the order of arrival must not matter
    languages = sorted({row["lang"] for row in rows})
    if not rows:
        return None
    place = {name: i for i, name in enumerate(languages)}
    data = np.concatenate([cut(bytes(row["window"])) for row in rows])
    return train(data, np.array([place[row["lang"]] for row in rows]), languages)


def label(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of whole texts; ``und`` with score 0 for a text that is missing or has no letter."""
    found = [(UNKNOWN, 0.0)] * len(texts)
    wanted = [i for i, value in enumerate(texts) if network is not None and value and HAS_LETTER.search(value)]
    if wanted:
        pieces = [cut(texts[i].lower().encode()) for i in wanted]
        every = np.concatenate(pieces)
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(counts) - counts
        weight = LETTER[every].sum(axis=1) + np.float32(1e-3)
        total = np.add.reduceat(network.log_probabilities(every) * weight[:, None], starts, axis=0)
        mean = total / np.add.reduceat(weight, starts)[:, None]
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, one in zip(wanted, odds, strict=True):
            best = int(one.argmax())
            found[i] = (network.languages[best], float(min(1.0, one[best])))
    return found


def predict(docs: DataFrame, network: Network | None, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text, one row per row of ``docs``.

    ``und`` with score 0 where the text is missing, has no letter, or nothing
    could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in sliced(batches, "text"):
            found = label(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=schema,
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network | None, text="text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text has a language that the network is at least that sure of; all rows where nothing was learned."""
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in sliced(batches, text):
            found = label(shared.value, batch.column(text).to_pylist())
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", held_out=(3, 1)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn outside the held-out fold, predict every row."""
    found = predict(docs, fit(docs, doc_id, text, lang, held_out), doc_id, text)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "lang_pred", "score")
