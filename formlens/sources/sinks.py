"""Writers of labels, splits, catalogues and experiment logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.sources import files


def token_labels(labelled: DataFrame, path: str) -> None:
    """One JSON line a document."""
    labelled.select("doc_id", "tokens", "bboxes", "ner_tags").write.json(path)


def text_labels(lines: DataFrame, path: str, key: str = "doc_id", position: str | None = None, batch: str = "all") -> None:
    """The lines of each document as one text file, by position if given; a batch that is there already isn't added again."""
    files.register(lines.sparkSession)
    placed = lines.select(F.col(key).cast("string").alias("name"), "value", (F.col(position) if position else F.lit(0)).alias("position"))
    by_name = placed.repartition("name").sortWithinPartitions("name", "position").select("name", "value")
    by_name.write.format("document_files").mode("append").option("batch", batch).save(path)


def splits(rows: DataFrame, path: str) -> None:
    """Parquet by split."""
    rows.write.partitionBy("split").parquet(path)


def appended(documents: DataFrame, path: str) -> None:
    """More documents of a catalogue, added without reading what is there."""
    documents.write.mode("append").json(path)


def saved(documents: DataFrame, known: DataFrame, path: str) -> None:
    """documents and those that are known already, told apart by the column known; files of a parallel write have no order, so a reader that wants known ones last sorts by it."""
    documents.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True)), allowMissingColumns=True).write.json(path)


def value_pool(pool: DataFrame, path: str) -> None:
    """(key, values) lines."""
    pool.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values")).write.json(path)


def mapping(files: DataFrame, path: str) -> None:
    """Each document with the list of files made from it."""
    files.groupBy("orig").agg(F.array_sort(F.collect_list("aug")).alias("aug")).write.json(path)


def metrics(tidy: DataFrame, path: str) -> None:
    """Rows of an experiment log, added to those of other runs."""
    tidy.write.mode("append").partitionBy("run").parquet(path)
