"""Structured Streaming over text files: stateless, so a restart resumes from the checkpoint.

Back-pressure is ``max_files`` for each trigger; flushing is the trigger; progress carries the counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Engine


def document_stream(spark: SparkSession, path: str, whole_files: bool = False, max_files: int | None = None) -> DataFrame:
    """path, json from the files that arrive below ``path``: a document per line, or per file."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path, wholetext=whole_files).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def run_available(stream: DataFrame, engine: Engine, target: str, checkpoint: str, column: str = "json") -> StreamingQuery:
    """Transform all that is there now, write it as Parquet, and stop; call again for what arrived since."""
    out = engine.run(stream, column).where(F.col(column).isNotNull())
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_rates(query: StreamingQuery) -> dict[str, float]:
    """rows, seconds, average and peak rows a second over the batches that the query still remembers."""
    batches = [(p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000) for p in query.recentProgress if p["numInputRows"]]
    rows, seconds = sum(n for n, _ in batches), sum(s for _, s in batches)
    rates = [n / s for n, s in batches if s]
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else 0.0, "peak_rows_per_second": max(rates, default=0.0)}
