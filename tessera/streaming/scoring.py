"""Stream scoring: apply a saved model package to a Structured Streaming source.

Scoring is stateless (a ``PipelineModel``/feature projection per micro-batch),
so it runs as a plain streaming ``select`` — no state store, no watermark.
High-cardinality vocabularies are stream–static joins against the saved
vocabulary tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.sinks import load_package


def score_stream(spark: SparkSession, package_path: str, source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame of predictions for a streaming ``source``."""
    pkg = load_package(spark, package_path)
    return pkg.score(source, keep=keep)


def start_scoring(spark: SparkSession, package_path: str, source_dir: str, schema, out_dir: str,
                  checkpoint_dir: str, keep: list[str] | None = None, trigger_once: bool = True) -> StreamingQuery:
    """Parquet folder in → predictions appended as Parquet (exactly-once via the checkpoint)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    scored = score_stream(spark, package_path, stream, keep)
    w = scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()
