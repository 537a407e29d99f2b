"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents are put
in ranges of that key, word counts are summed per range, prefix sums over the
ranges say where each range starts, and only inside a range are documents
ordered.  A source's budget is cut exactly at its last word: whole epochs
first, then the documents below the cut, the one at the cut in part.

The ranges are the leading bits of the key, so a source that holds a third of
all rows is spread over its ranges like any other, and a rerun cuts at the same
place.  Two levels of ranges keep every prefix sum short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.batches import WORD
from assayframe.sources.storage import write_shared

# Rows that one range of one source holds at most, on average.
RANGE_ROWS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0


def word_count(text: Column) -> Column:
    """Words of a text; 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """63 hash bits of the document, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Targets per source: ``share`` of all words, dealt by weight, none above ``most`` times its source.

    ``totals`` has (source, source_size), one row per source, the missing source
    among them.  Sources are numbered by code point, the missing one last, and
    take the weights in turn.  The level words-per-weight is raised until no
    source is above its limit: each round is one distributed sum.
    """
    spark = totals.sparkSession
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    numbered = spark.createDataFrame(
        ordered.rdd.zipWithIndex().map(lambda pair: (pair[0]["source"], pair[0]["source_size"], pair[1])),
        "source string, source_size long, place long",
    )
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1
    weighed = write_shared(
        numbered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight")), "mix-sources"
    )
    limit = F.lit(float(most)) * F.col("source_size")
    everything = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (everything["size"] or 0)
    level, capped_before = (budget / everything["weight"] if everything["weight"] else 0.0), 0
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        state = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if state["n"] == capped_before or not state["open"]:
            break
        capped_before, level = state["n"], (budget - state["capped"]) / state["open"]
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def mix_plan(
    docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, epochs, part): what the mix takes of every document.

    ``epochs`` whole copies and ``part`` words of one more.  A missing or empty
    text has size 0 and nothing is taken of it; a missing source is a source;
    repeated rows are separate documents; an empty table gives an empty plan.
    """
    sized = write_shared(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
            random_key(F.col(doc_id), F.col(text)).alias("key"),
        ),
        "mix-sizes",
    )
    totals = write_shared(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-totals")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, rows / range_rows))))
    coarse_bits = bits // 2
    ranged = sized.withColumns({"span": F.shiftright("key", 63 - bits), "wide": F.shiftright("key", 63 - coarse_bits)})
    targets = source_targets(totals.select("source", "source_size"), weights, share, most).withColumn(
        "budget", F.floor("target").cast("long")
    )
    targets = targets.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"),
    }).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("budget")

    spans = ranged.groupBy("source", "wide", "span").agg(F.sum("size").alias("held"))
    wides = spans.groupBy("source", "wide").agg(F.sum("held").alias("wide_held"))
    by_wide = Window.partitionBy("source").orderBy("wide").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wides = wides.withColumn("wide_start", F.sum("wide_held").over(by_wide) - F.col("wide_held")).drop("wide_held")
    wides = _same(wides, targets, ["source"])
    by_span = Window.partitionBy("source", "wide").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = _same(spans, wides, ["source", "wide"]).withColumn(
        "start", F.col("wide_start") + F.sum("held").over(by_span) - F.col("held")
    ).drop("held", "wide_start")
    within = Window.partitionBy("source", "wide", "span").orderBy("key", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("start") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before))
    return _same(ranged, spans, ["source", "wide", "span"]).select(
        "doc_id", "key", "source", "size", "source_size", "target", "epochs", part.alias("part")
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which a missing value equals a missing value."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    on = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return left.join(renamed, on).drop(*(f"_{key}" for key in keys))


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words taken of every document, repeats counted."""
    return mix_plan(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    )


def mix_documents(docs: DataFrame, doc_id="doc_id", text="text", source="source", **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, the one at the cut whole if half of it is inside.

    Only the cut of each source (a key) goes back to the documents, so texts
    are not shuffled.  The columns are those of ``docs``.
    """
    plan = mix_plan(docs, doc_id, text, source, **options)
    inside = (F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))
    cuts = write_shared(
        plan.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(inside, F.col("key"))).alias("_cut")), "mix-cuts"
    ).withColumnRenamed("source", "_source")
    packed = docs.select(  # whatever the documents' columns are called, they cannot clash
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"), F.col(source).cast("string").alias("_of"),
        random_key(F.col(doc_id), F.col(text)).alias("_key"), word_count(F.col(text)).alias("_size"),
    )
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False)).cast("long")).otherwise(0)
    joined = packed.join(cuts, F.col("_of").eqNullSafe(F.col("_source")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_copy")).select("doc.*")
