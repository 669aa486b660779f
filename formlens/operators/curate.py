"""Curation of tags, splits without leaks, and reports of rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.draws import below, uniform
from formlens.functions.geometry import Box, well_formed
from formlens.functions.text import PII_CLASSES, TAGS, last_part, stem_before_last


def without_signatures(tokens: DataFrame, *keys: str) -> DataFrame:
    """Rows without signatures, idx counted anew in each document."""
    order = Window.partitionBy(*keys).orderBy("idx")
    return tokens.filter(F.col("tag") != "B-signature").withColumn("idx", F.row_number().over(order) - 1)


def curated(tokens: DataFrame) -> DataFrame:
    """Cards and accounts become payment information, dates become O."""
    merged = F.regexp_replace("tag", "^([BI])-(iban|credit_card_number)$", "$1-payment_information")
    return tokens.withColumn("tag", F.when(F.col("tag").isin("B-dates", "I-dates"), "O").otherwise(merged))


def allowed(tokens: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Tags of other labels become O."""
    return tokens.withColumn("tag", F.when(last_part(F.col("tag")).isin(*labels), F.col("tag")).otherwise("O"))


def routed(files: DataFrame, catalogue: DataFrame, known: Sequence[str] = ("train", "val")) -> DataFrame:
    """Each file with the split of the document it was made from; what is neither of known is test."""
    stem = files.withColumn("file_id", stem_before_last(F.col("file_name")))
    split = F.when(F.col("split").isin(*known), F.col("split")).otherwise("test")
    return stem.join(catalogue.select(F.col("file_id"), F.col("split")), "file_id").withColumn("split", split)


def split_by_layout(files: DataFrame, train: float = 0.8, val: float = 0.5, seed: str = "split") -> DataFrame:
    """Files of one layout share a split, drawn by the layout; of those outside train, one file a layout is kept."""
    layout = stem_before_last(F.col("file_name"))
    draw, second = uniform(seed, layout), uniform(f"{seed}-val", layout)
    split = F.when(draw < train, "train").when(second < val, "val").otherwise("test")
    rows = files.withColumns({"layout": layout, "split": split})
    order = Window.partitionBy("layout").orderBy(uniform(f"{seed}-file", F.col("file_name")), "file_name")
    return rows.withColumn("__n", F.row_number().over(order)).filter((F.col("split") == "train") | (F.col("__n") == 1)).drop("__n")


def label_list(tokens: DataFrame) -> DataFrame:
    """Different tags with their place in order."""
    return tokens.select("tag").distinct().withColumn("pos", F.row_number().over(Window.orderBy("tag")) - 1)  # a row a tag


def missing_classes(found: DataFrame, *keys: str) -> DataFrame:
    """The classes that a document doesn't have, as many times as the reference list has them more often."""
    names = found.sparkSession.createDataFrame([(x,) for x in PII_CLASSES], "category string")
    every = found.select(*keys).distinct().withColumn("category", F.explode(F.array(*[F.lit(x) for x in PII_CLASSES])))
    known = found.join(F.broadcast(names), "category", "left_semi").select(*keys, "category")
    return every.exceptAll(known.select(*every.columns))


def quality_report(tokens: DataFrame) -> DataFrame:
    """Rows that break each rule; rows whose rule can't be told count as broken."""
    rules = {
        "tag_unknown": ~F.col("tag").isin(*TAGS), "signature": F.col("tag") == "B-signature", "middle_name": F.col("tag").endswith("middle_name"),
        "box_out_of_range": ~well_formed(Box.of()), "token_empty": F.trim("token") == "",
    }
    sums = tokens.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(x, F.lit(True))).alias(k) for k, x in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x"), "rows").select("x.*", "rows")


def top_values(values: DataFrame, most: int = 1000, seed: str = "pool") -> DataFrame:
    """most different values of each key, drawn by hash; ranks within hash ranges first, so that a hot key is spread."""
    once = values.select("key", "value").distinct().withColumns({"__draw": uniform(seed, F.col("value")), "__part": below(64, f"{seed}-part", F.col("value"))})
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__draw", "value"))
    few = once.withColumn("__n", rank("key", "__part")).filter(F.col("__n") <= most)
    return few.withColumn("pos", rank("key")).filter(F.col("pos") <= most).select("key", "value", "pos")


def merged_pool(*pools: DataFrame) -> DataFrame:
    """Different (key, value) of several pools."""
    first, *rest = [p.select("key", "value") for p in pools]
    for more in rest:
        first = first.unionByName(more)
    return first.distinct()
