"""Incremental embedding as a stream: each new chunk file is embedded once, with progress kept in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Embedder
from ..operators.vectors import add_round, embed, pending, read_cache


def embed_new_chunks(spark: SparkSession, chunk_path: str, cache_path: str, checkpoint: str, embedder: Embedder, batch_size: int = 16) -> None:
    """Process all chunk files that are there and stop. A batch that is repeated after a failure adds nothing twice."""
    schema = spark.read.parquet(chunk_path).schema

    def add(batch: DataFrame, number: int) -> None:
        known = read_cache(batch.sparkSession, cache_path).where(F.col("round") != f"stream-{number:06d}")  # that one is written anew
        add_round(embed(pending(batch.dropDuplicates(["cache_key"]), known), embedder, batch_size), cache_path, f"stream-{number:06d}")

    query = spark.readStream.schema(schema).parquet(chunk_path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
