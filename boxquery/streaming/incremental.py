"""Incremental forms of the merges. An extension: batch runs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def running_label_counts(dets: DataFrame, label: str = "raw_label") -> DataFrame:
    """Counts per label of a stream of detections (output mode update or complete)."""
    return dets.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def upsert_sets(dets: DataFrame, path: str, checkpoint: str, by: str = "prompt_set") -> DataStreamWriter:
    """Each micro-batch replaces the sets that it brings; a batch that is repeated changes nothing."""
    from boxquery.sources.writers import write_sets

    def put(batch: DataFrame, _: int) -> None:
        write_sets(batch, path, by)

    return dets.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
