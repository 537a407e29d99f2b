"""Toxicity by weak supervision.

Many lexicon and pattern voters say "toxic" or abstain.  A generative label
model estimates, by expectation maximisation, how often each voter fires on
toxic and on clean texts, and how strongly voters are correlated beyond what
the label explains; correlated voters share their say.  The given labels of
the training fold are one more voter.  Its posterior labels train a linear
classifier on the presence of words and word beginnings, which then scores
every text.

The lexicons are a fixed seed list and word beginnings mined from a bounded
sample of labelled rows (``MOST_LABELLED``), counted with Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.batches import crc_fold, sliced, small_batches, texts_of, tidy
from assayframe.sources.storage import write_shared

# The bound of the labelled sample, per class.
MOST_LABELLED = 6000
# Words and beginnings that the classifier looks at, and voters of the label model.
MOST_FEATURES = 1200
MOST_VOTERS = 160
SHORTEST, LONGEST, LONGEST_REST = 3, 8, 4
CACHE_WORDS = 150_000
# A seed lexicon of common insults.
SEED = (
    "idiot moron stupid dumb loser trash garbage scum clown pathetic worthless disgusting vermin bastard bitch retard freak filth "
    "idiota imbécil estúpido basura asco imbécile connard salaud ordure débile dummkopf arschloch abschaum schwachkopf widerlich"
).split()
DISGUISE = str.maketrans("0134578@$", "oieastbas")
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
PATTERNS = (
    re.compile(r"[!?]{3,}"), re.compile(r"\b(?:you|du|tu|vous|usted)\b.{0,24}\b(?:idiot\w*|moron\w*|loser\w*|scum)", re.I | re.S),
    re.compile(r"([a-z])\1{3,}", re.I), re.compile(r"\b[a-z]+[013457@$][a-z]+\b", re.I),
)


def normal(word: str) -> str:
    """Lower-cased, without signs at its ends, common digit and sign disguises undone."""
    word = EDGE.sub("", word.lower())
    return word.translate(DISGUISE) if not word.isalpha() and any(map(str.isalpha, word)) else word


def forms(word: str) -> list[str]:
    """The word, its beginnings, and each beginning with the letters that are left if they are few (an inflected stem)."""
    size = len(word)
    starts = range(SHORTEST, min(LONGEST, size) + 1)
    few = [f"{word[:n]}+{size - n}" for n in starts if 0 < size - n <= LONGEST_REST]
    return [word + "="] + [word[:n] for n in starts] + few if word else []


@dataclass
class Classifier:
    """Weights of word forms; a text's log-odds are the bias and the weights of the distinct forms it holds."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.place = {form: i for i, form in enumerate(self.weights)}
        self.values = np.array(list(self.weights.values()), np.float64)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def places(self, word: bytes) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            place = self.place
            found = self.cache[word] = tuple(place[f] for f in forms(normal(word.decode("utf-8", "replace"))) if f in place)
        return found

    def score(self, text: bytes | None) -> float:
        held: set[int] = set()
        if text:
            for some in map(self.places, set(text.split())):
                if some:
                    held.update(some)
        odds = self.bias + float(self.values[sorted(held)].sum() if held else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "toxic" per text, firing rates (voters x classes) and the correlation of voters within a class.

    ``votes`` is texts x voters, 1 where a voter fires; ``gold`` is the given
    label, a voter like the others whose error rates are estimated too.
    """
    posterior = np.where(gold == 1, 0.95, 0.05)
    errors = np.array([0.05, 0.05])
    correlation = np.eye(votes.shape[1])
    rates = np.full((votes.shape[1], 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior], axis=1)
        mass = weight.sum(axis=0)
        rates = np.clip((votes.T @ weight + [0.5, 0.5]) / (mass + [50.0, 1.0]), 1e-5, 1 - 1e-5)
        prior = np.clip(mass[1] / mass.sum(), 1e-3, 1 - 1e-3)
        errors = np.clip(np.array([(weight[:, 0] * (gold == 1)).sum() / max(mass[0], 1), (weight[:, 1] * (gold == 0)).sum() / max(mass[1], 1)]), 0.01, 0.3)
        residual = votes - weight @ rates.T
        spread = residual.std(axis=0) + 1e-9
        correlation = (residual.T @ residual) / len(votes) / spread[:, None] / spread
        shared = 1 + np.clip(correlation - 0.1, 0, 1).sum(axis=1) - np.clip(np.diag(correlation) - 0.1, 0, 1)
        fire, quiet = np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        odds = np.log(prior / (1 - prior)) + votes @ (fire / shared) + (1 - votes) @ (quiet / shared)
        odds += np.where(gold == 1, np.log((1 - errors[1]) / errors[0]), np.log(errors[1] / (1 - errors[0])))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, rates, correlation


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 900, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, classes weighted evenly, by accelerated gradient descent."""
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
    balance /= balance.sum()
    weights, bias, last, last_bias = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    ray = np.ones(x.shape[1])
    for _ in range(12):  # the largest curvature, by power iteration
        ray = x.T @ (balance * (x @ ray))
        ray /= max(float(np.linalg.norm(ray)), 1e-12)
    step = 1.0 / (0.3 * max(1.0, float(ray @ (x.T @ (balance * (x @ ray))))) + ridge)
    for turn in range(rounds):
        pull = turn / (turn + 3)
        ahead, ahead_bias = weights + pull * (weights - last), bias + pull * (bias - last_bias)
        gap = balance * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - target)
        last, last_bias = weights, bias
        weights, bias = ahead - step * (x.T @ gap + ridge * ahead), ahead_bias - step * gap.sum()
    return weights, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, held_out) -> DataFrame:
    """(doc_id, text, toxic): at most about ``MOST_LABELLED`` labelled texts per class outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    known = known.where(crc_fold(F.col("doc_id"), held_out[0]) != held_out[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for t in (0, 1) for x in (t, min(1.0, MOST_LABELLED / max(1, counts.get(t, 0))))])[F.col("toxic")]
    chosen = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20) < share)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id")  # at most about 2 x MOST_LABELLED short rows


def evidence(sample: DataFrame) -> DataFrame:
    """(words, patterns, toxic): the distinct words of each labelled text; texts of one class with the same set of words once, by their least id."""

    def gather(batches):
        for batch in sliced(batches, "text"):
            rows = []
            for value in texts_of(batch.column("text")):
                words = {normal(w.decode("utf-8", "replace")) for w in set(value.split())} - {""}
                whole = value.decode("utf-8", "replace")
                rows.append((sorted(words), [i for i, p in enumerate(PATTERNS) if p.search(whole)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.string())),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32()),
                ],
                names=["doc_id", "words", "patterns", "toxic"],
            )

    rows = small_batches(sample).select("doc_id", "text", "toxic").mapInArrow(tidy(gather), "doc_id long, words array<string>, patterns array<int>, toxic int")
    # The words are sorted and hold no blank, so equal digests are equal sets: a copied text is no evidence on its own.
    rows = rows.groupBy(F.sha2(F.array_join("words", " "), 256).alias("digest"), "toxic").agg(F.min(F.struct("doc_id", "patterns", "words")).alias("least"))
    return rows.select("least.words", "least.patterns", "toxic")


def fit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", toxic="toxic", held_out=(3, 1)) -> Classifier:
    """Mine forms, weigh voters, train the classifier; without both classes every text scores 0."""
    # Written once: sizes, counts and votes come from the same texts.
    rows = write_shared(evidence(labelled_sample(docs, labels, doc_id, text, toxic, held_out)), "labelled")

    def count(batches):
        held = Counter(), Counter()
        for batch in batches:
            for words, label in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held[label].update({form for word in words for form in forms(word)})
        every = list(held[0].keys() | held[1].keys())
        for start in range(0, len(every), 50_000):
            part = every[start : start + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([held[0][f] for f in part], pa.int64()), pa.array([held[1][f] for f in part], pa.int64())],
                names=["form", "clean", "toxic"],
            )

    sizes = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Classifier({}, -40.0)
    counted = rows.mapInArrow(tidy(count), "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    ranked = counted.where((F.col("toxic") >= 4) & (lift > 1.6)).withColumn("merit", lift * F.sqrt("toxic"))
    ranked = ranked.orderBy(F.desc("merit"), F.length("form"), "form").limit(MOST_FEATURES).select("form", "clean", "toxic").collect()
    names = [row["form"] for row in ranked]
    names += [word + "=" for word in SEED if word + "=" not in set(names)]
    place = {form: i for i, form in enumerate(names)}

    def present(batches):
        for batch in batches:
            held = [sorted({place[f] for w in words for f in forms(w) if f in place}) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), batch.column("patterns"), batch.column("toxic")], names=["held", "patterns", "toxic"])

    collected = rows.mapInArrow(tidy(present), "held array<int>, patterns array<int>, toxic int").collect()
    collected.sort(key=lambda row: (row["toxic"], row["held"], row["patterns"]))
    x = np.zeros((len(collected), len(names)), np.float32)
    marks = np.zeros((len(collected), len(PATTERNS)))
    for i, row in enumerate(collected):
        x[i, row["held"]] = 1
        marks[i, row["patterns"]] = 1
    gold = np.array([row["toxic"] for row in collected])
    posterior, _, _ = label_model(np.concatenate([x[:, : MOST_VOTERS].astype(np.float64), x[:, len(ranked) :], marks], axis=1), gold)
    weights, bias = fit_linear(x.astype(np.float64), posterior)
    return Classifier({name: float(w) for name, w in zip(names, weights, strict=True) if w}, bias)


def score(docs: DataFrame, classifier: Classifier, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, score): every whole text, one row per row of ``docs``; a missing text scores like an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        engine = Classifier(*shared.value)
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(map(engine.score, texts_of(batch.column("text"))), pa.float64())], schema=schema
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, classifier: Classifier, text="text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))

    def run(batches):
        engine = Classifier(*shared.value)
        for batch in sliced(batches, text):
            yield batch.filter(pa.array([engine.score(value) < threshold for value in texts_of(batch.column(text))], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out=(3, 1), **names) -> DataFrame:
    """(doc_id, held_out, score, predicted): learn outside the held-out fold, score every row."""
    found = score(docs, fit(docs, labels, held_out=held_out, **names), names.get("doc_id", "doc_id"), names.get("text", "text"))
    return found.select(
        "doc_id", (crc_fold(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
