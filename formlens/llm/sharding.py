"""Sharding by sampled splitters, so that shards hold nearly the same number of bytes.

The key of a record is a hash of its text, so equal texts lie side by side. A
size-weighted sample of keys gives quantile boundaries of small ranges; exact
bytes per range then lay the ranges out over the shards in order, and ranges that hold
more than their part are divided by a second key. The number of ranges is fixed for a
number of shards, and with it the sample and the table of ranges, whatever the input.
Both keys come from doc_id and text, so a row's place does not depend on how the input
is split into partitions; rows that are equal in both are interchangeable, and only where
over ALIKE of these overfill a range are they told apart by a row number.

Defined cases: null text has no bytes and size 1, as has the empty text; repeated rows
are records of their own; a null doc_id is kept; an empty table gives no rows; where all rows are alike
one range holds them and is divided; of the input's columns those named size, text_crc32,
shard and slot are replaced, and all others stay. A task holds one text at a time.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import documents, nested, stored

SHARDS = 8
#: Ranges a shard is laid out from; one task ranks the rows of one range, which Spark sorts outside memory where they are many.
RANGES_A_SHARD = 256
#: Sampled keys a range.
SAMPLE = 8
#: A range is divided when it holds this many times the mean.
OVERFULL = 2.0
#: So many rows that are equal in doc_id and text stay in one piece.
ALIKE = 64
UNIT = float(1 << 53)
ADDED = ("size", "text_crc32", "shard", "slot")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, size, text_crc32, key, second, row_id): docs as one column, two keys in [0, 2^53) and an id of the row."""
    bits = lambda x: F.shiftrightunsigned(x, 11).cast("double")
    text = F.coalesce(F.col("text"), F.lit(""))
    return nested(docs, "doc_id", "text").select(
        "row",
        F.monotonically_increasing_id().alias("row_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        bits(F.xxhash64(text)).alias("key"),
        bits(F.xxhash64(F.lit("second"), F.col("doc_id"), text)).alias("second"),
    )


def boundaries(records: DataFrame, total: int, ranges: int) -> list[float]:
    """The inner quantiles of a size-weighted sample of keys, about SAMPLE keys a range; rows that are alike are drawn together, as one row with their number."""
    chance = F.lit(float(SAMPLE * ranges)) * F.col("size") / F.lit(float(total))
    drawn = sorted((x.key, x.n) for x in records.filter(F.col("second") / F.lit(UNIT) < chance).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect())
    all_drawn, upto, picked = sum(n for _, n in drawn), 0, []
    for key, n in drawn:
        first = max(1, -(-upto * ranges // all_drawn))  # the first quantile at or behind this key's first row
        upto += n
        if first < ranges and all_drawn * first // ranges < upto:
            picked.append(key)
    return picked


def sharded(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """records (of keyed(), stored) with shard and slot."""
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return records.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    ranges = shards * RANGES_A_SHARD
    inner = boundaries(records, total, ranges)
    bucketed = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="key", outputCol="__range").transform if inner else lambda x: x.withColumn("__range", F.lit(0.0))
    in_range = bucketed(records)
    mean = total / ranges
    sums = in_range.groupBy("__range").agg(F.sum("size").alias("__bytes"))
    overfull = F.col("__bytes") > F.lit(OVERFULL * mean)
    parts = F.greatest(F.when(overfull, F.ceil(F.col("__bytes") / F.lit(mean))).otherwise(1), F.lit(1)).cast("int")
    alike = in_range.join(F.broadcast(sums.filter(overfull).select("__range")), "__range").groupBy("key", "second").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n")).filter((F.col("__bytes") > F.lit(mean)) & (F.col("__n") > ALIKE))  # fewer than the ranges, as each is over the mean
    alike = F.broadcast(alike.select("key", "second", F.lit(True).alias("__alike")))
    shared = F.shiftrightunsigned(F.xxhash64("row_id"), 11).cast("double")
    divided = in_range.join(F.broadcast(sums.select("__range", parts.alias("__parts"))), "__range").join(alike, ["key", "second"], "left")  # a row a range
    divided = divided.withColumn("__part", F.floor(F.when(F.col("__alike"), shared).otherwise(F.col("second")) / F.lit(UNIT) * F.col("__parts")).cast("int")).drop("__alike")
    pieces = stored(divided.groupBy("__range", "__part").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n")), "shard-pieces")
    before = Window.orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)  # pieces, three times the ranges at most
    middle = F.coalesce(F.sum("__bytes").over(before), F.lit(0)) + F.col("__bytes") / 2
    placed = pieces.select("__range", "__part", "__n", F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int").alias("shard"))
    ahead = Window.partitionBy("shard").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    within = Window.partitionBy("__range", "__part").orderBy("key", "second", "row_id")
    slotted = divided.join(F.broadcast(placed), ["__range", "__part"]).withColumn("slot", (F.row_number().over(within) - 1 + F.col("__first")).cast("long"))
    return slotted.drop("__range", "__part", "__parts", "__first")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole records as Parquet, one folder a shard."""
    records = stored(keyed(docs), "shard-records")
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ADDED]
    sharded(records, shards).select(*own, *ADDED).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly the same bytes."""
    records = stored(keyed(documents(spark, sf_dir)).select("row.doc_id", "size", "text_crc32", "key", "second", "row_id"), "shard-keys")
    found = sharded(records)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
