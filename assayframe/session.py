"""Session settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session somebody else made.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time; a later shuffle is a fair price for it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


# Rows a shuffle partition should hold.
ROWS_PER_PARTITION = 2_000_000


def shuffle_partitions(rows: int) -> int:
    """Shuffle partitions for an input of ``rows``, to pass to ``build_session``; adaptive coalescing undoes any excess."""
    return max(1, -(-rows // ROWS_PER_PARTITION))


def build_session(app: str = "assayframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword settings use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**RUNTIME_SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())
