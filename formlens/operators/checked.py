"""Joins that check what they join, rules on label files counted in one pass, and samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Parts of the range of hashes that a sample's rows are counted by.
HASH_PARTS = 4096


def required(rows: DataFrame, there: DataFrame, *keys: str, what: str = "counterpart") -> DataFrame:
    """rows, all of which must have a row of there with the same keys; running the result ends in an error that names one which hasn't."""
    marks = there.select(*[F.col(k).alias(f"of_{k}") for k in keys]).distinct().withColumn("is_there", F.lit(True))
    same = [rows[k].eqNullSafe(marks[f"of_{k}"]) for k in keys]
    shown = F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *[F.coalesce(rows[k].cast("string"), F.lit("null")) for k in keys]))
    held = F.when(F.col("is_there").isNull(), F.raise_error(shown).cast("boolean")).otherwise(True)
    return rows.join(marks, same, "left").filter(held).select(*[rows[c] for c in rows.columns])


def evaluated(gt: DataFrame, pred: DataFrame, gt_files: DataFrame, pred_files: DataFrame, *keys: str, led_by: str = "pred") -> tuple[DataFrame, DataFrame]:
    """gt and pred of the files that are compared; a file without boxes is one of gt_files or pred_files all the same.

    Led by pred, each predicted file must be annotated, else running either result ends in an
    error, and annotated files without predictions are left out. Led by gt, files that are
    missing on a side are left out.
    """
    if led_by == "pred":
        files = required(pred_files.select(*keys).distinct(), gt_files, *keys, what="annotation")
    elif led_by == "gt":
        files = gt_files.select(*keys).distinct().join(pred_files.select(*keys).distinct(), list(keys), "left_semi")
    else:
        raise ValueError(f"led_by is gt or pred, not {led_by}")
    return gt.join(files, list(keys), "left_semi"), pred.join(files, list(keys), "left_semi")


def missing_files(images: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """(keys, missing) of the names that only one side has; missing is `image` or `label`. Their numbers are equal only if it is empty."""
    side = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = side(images, "image").join(side(files, "label"), list(keys), "full")
    return both.filter("image IS NULL OR label IS NULL").select(*keys, F.when(F.col("image").isNull(), "image").otherwise("label").alias("missing"))


def file_rules(most: int = 1000) -> dict[str, Column]:
    """What holds of a whole label file of parallel arrays tokens, bboxes and ner_tags."""
    inside = lambda b: (F.size(b) == 4) & F.forall(b, lambda x: x.between(0, most)) & (F.get(b, F.lit(0)) <= F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) <= F.get(b, F.lit(3)))
    return {
        "equal_lengths": (F.size("tokens") == F.size("bboxes")) & (F.size("tokens") == F.size("ner_tags")),
        "no_signature": ~F.exists("ner_tags", lambda t: t.eqNullSafe(F.lit("B-signature"))),
        "no_middle_name": ~F.exists("ner_tags", lambda t: F.coalesce(t.endswith("-middle_name"), F.lit(False))),
        "boxes_inside": F.forall("bboxes", lambda b: F.coalesce(inside(b), F.lit(False))),
    }


def failed(rule: Column) -> Column:
    """A rule that is null isn't kept."""
    return ~F.coalesce(rule, F.lit(False))


def rule_counts(files: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_files, n_failed) of each rule, from one pass over files."""
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), *[F.count_if(failed(x)).alias(k) for k, x in rules.items()])
    return sums.select("n_files", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_failed")) for k in rules])).alias("x")).select("x.rule", "n_files", "x.n_failed")


def observed(files: DataFrame, rules: dict[str, Column], name: str = "rules") -> tuple[DataFrame, Observation]:
    """files, and the numbers of those that break each rule, which are there once an action has run over them."""
    seen = Observation(name)
    return files.observe(seen, F.count(F.lit(1)).alias("n_files"), *[F.count_if(failed(x)).alias(k) for k, x in rules.items()]), seen


def strict(files: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """files, all of which must keep the rules; running the result ends in an error that names a file and a rule it breaks."""
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    broken = F.lit(True)
    for k, x in rules.items():
        broken = F.when(failed(x), F.raise_error(F.concat(F.lit(f"{k} is broken by "), name)).cast("boolean")).otherwise(broken)
    return files.filter(broken)


def drawn_number(row: Column, seed: str) -> Column:
    """A number below 2^32 that depends on the seed and the row's name alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def exact_samples(rows: DataFrame, group: str, name: str, size: int | Column, seed: str = "sample") -> DataFrame:
    """size rows of each group, or all where there are fewer: those with the least drawn numbers, ties to the smaller name. size may be a column of rows that is the same in a group.

    Rows are counted by group and part of the numbers' range; parts below the one in which
    the size is reached are kept whole, and only that part's rows are sorted.
    """
    number = F.coalesce(drawn_number(F.col(name), seed), F.lit(0))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")  # so that no column of the input clashes with these
    wanted = F.lit(size) if isinstance(size, int) else size
    numbered = rows.select(whole_row, F.col(group).alias("group"), F.col(name).alias("name"), number.alias("drawn"), F.floor(number * HASH_PARTS / (1 << 32)).cast("int").alias("part"), wanted.alias("wanted"))
    parts = numbered.groupBy(F.col("group").alias("of_group"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("most"))
    ahead = Window.partitionBy("of_group").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)  # HASH_PARTS rows a group at most
    open_ = parts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter("before < most").select("of_group", "of_part", (F.col("before") + F.col("n") <= F.col("most")).alias("whole"), (F.col("most") - F.col("before")).alias("room"))
    held = numbered.join(open_, F.col("group").eqNullSafe(F.col("of_group")) & (F.col("part") == F.col("of_part")))
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy("drawn", "name"))
    cut = held.filter(~F.col("whole")).withColumn("place", place).filter("place <= room")
    return held.filter("whole").select("row.*").unionByName(cut.select("row.*"))


def equal_samples(rows: DataFrame, group: str, name: str, seed: str = "sample") -> DataFrame:
    """As many rows of each group as the smallest has."""
    least = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n"), F.lit(0))).first()[0]
    return exact_samples(rows, group, name, int(least), seed)

