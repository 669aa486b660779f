"""Metrics of label files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formlens.operators.evaluate import measured, per_class
from formlens.sources.readers import TOKEN_LABELS


def label_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tokens, bboxes, ner_tags) of JSON lines, file by file as they arrive."""
    return spark.readStream.schema(f"doc_id string, {TOKEN_LABELS}").json(path)


def counts_of(gt: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums over documents by class; documents are whole in one batch, so sums of batches add up."""
    each = per_class(gt, pred, keys)
    return each.groupBy("category").agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("fp")).alias("correct"))


def keep_counts(predictions: DataFrame, gt: DataFrame, to_entities, path: str, checkpoint: str, keys: Sequence[str] = ("doc_id",)) -> StreamingQuery:
    """Stores the counts of each batch of predictions under its batch id, so that a batch that is run again replaces itself."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        pred = to_entities(rows)
        own = gt.join(rows.select(*keys).distinct(), list(keys), "left_semi")
        counts_of(own, pred, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return predictions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def so_far(spark: SparkSession, path: str) -> DataFrame:
    """Metrics by class over all batches."""
    rows = spark.read.parquet(path)
    return measured(rows.groupBy("category").agg(*[F.sum(x).alias(x) for x in ("n_gt", "n_pred", "tp", "correct")]), 0.0)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time, with a watermark that lets rows be late by so much."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
