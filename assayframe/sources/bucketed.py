"""Tables laid out for joins on one key: a batch that is joined with them shuffles only itself."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, path: str, key: str | Sequence[str], buckets: int, name: str | None = None) -> DataFrame:
    """Write ``df`` under ``path`` in hash buckets of ``key``, each sorted by it, and register it as table ``name``; returns the table.

    Joins and groupings on exactly these columns then read the buckets in place.
    ``buckets`` should follow the size of the table (one to a few hundred
    megabytes each); rows are dealt to their bucket before the write, so there
    is one file per bucket.
    """
    keys = [key] if isinstance(key, str) else list(key)
    name = f"bucketed_{uuid.uuid4().hex}" if name is None else name
    # The hash that Spark buckets by, so that one task writes one bucket.
    dealt = df.repartition(buckets, *[F.col(column) for column in keys])
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
