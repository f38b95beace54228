"""Neighbours of new entities, batch by batch, against a fixed index. An addition: the operators themselves are for batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieval
from pyspark.sql import functions as F


def neighbours_of(new: DataFrame, index: DataFrame, limit: int = 25) -> DataFrame:
    """The best entities of the index for each new one (entity_id, feature_id, axis)."""
    a, b = new.alias("a"), index.select("entity_id", "feature_id", "ic").alias("b")
    met = a.join(b, (F.col("a.feature_id") == F.col("b.feature_id")) & (F.col("a.entity_id") != F.col("b.entity_id")))
    scores = met.groupBy(F.col("a.entity_id").alias("l"), F.col("b.entity_id").alias("r"), F.col("a.axis").alias("axis")).agg(F.sum("b.ic").cast(retrieval.IC).alias("ic"), F.count("*").alias("shared"))
    return retrieval.candidates(scores, limit)


def stream_neighbours(features: DataFrame, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int = 25) -> StreamingQuery:
    """Start a query that hands each micro-batch's neighbours to `sink`, with the batch's number for idempotent writes."""
    return features.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: sink(neighbours_of(batch, index, limit), i)).start()
