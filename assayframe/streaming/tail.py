"""Row-local log checks over an append-only directory of JSONL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayframe.operators.logchecks import line_violations


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New log files as a stream of lines; ``line`` is unknown until the file is read as a whole."""
    lines = spark.readStream.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line"), "value")


def watch_lines(spark: SparkSession, path: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the violations of the files present and stop; run again to pick up new ones."""
    broken = line_violations(stream_lines(spark, path))
    return (
        broken.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
