"""How well predictions cover annotated boxes, by document, by class, and pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.geometry import Box, area, intersection, touching
from formlens.functions.text import category, f1, ratio

THRESHOLD = 0.7
TILE = 64
SIDES = ("gt", "pred")


def entities(tokens: DataFrame, keys: Sequence[str], tag: str = "tag", shift: str | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """(keys, category, id, box) of the tokens that carry a tag."""
    b = Box.of()
    moved = Box(b.x0 + F.col(shift), b.y0, b.x1 + F.col(shift), b.y1) if shift else b
    kept = tokens.filter(F.col(tag) != "O").withColumn("__category", category(F.col(tag)))
    if excluded:
        kept = kept.filter(~F.col("__category").isin(*excluded))
    return kept.select(*keys, F.col("__category").alias("category"), F.col("i").alias("id"), *moved.named())


def both_sides(tokens: DataFrame, keys: Sequence[str], tag: str = "tag", pred_tag: str = "pred_tag", shift: str | None = None) -> DataFrame:
    """entities() of two tags in one pass over tokens, as one table with is_gt; the measures below take it as gt, without a pred."""
    b = Box.of()
    moved = Box(b.x0 + F.col(shift), b.y0, b.x1 + F.col(shift), b.y1) if shift else b
    side = lambda name, at, is_gt: F.when(F.col(name) != "O", F.struct(category(F.col(name)).alias("category"), F.struct(F.col("i").alias("id"), *at.named()).alias("e"), F.lit(is_gt).alias("is_gt")))
    rows = tokens.filter((F.col(tag) != "O") | (F.col(pred_tag) != "O"))
    return rows.select(*keys, F.explode(F.array_compact(F.array(side(tag, b, True), side(pred_tag, moved, False)))).alias("x")).select(*keys, "x.*")


def covers(gt: Box, pred: Box, threshold: float = THRESHOLD) -> Column:
    """Whether pred covers that share of gt; boxes that don't touch are told by four comparisons first."""
    whole = area(gt)
    enough = (whole > 0) & (intersection(gt, pred).cast("double") / F.nullif(whole, F.lit(0)) >= threshold)
    return touching(gt, pred) & enough if threshold > 0 else enough


def sided(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Both sides in one table: a struct of id and box, and which side it is of; without pred, gt is such a table."""
    if pred is None:
        return gt.select(*keys, "e", "is_gt")
    row = F.struct("id", *Box._fields).alias("e")
    return gt.select(*keys, row, F.lit(True).alias("is_gt")).unionByName(pred.select(*keys, row, F.lit(False).alias("is_gt")))


def counted(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """n_gt, n_pred, tp (boxes that some prediction covers) and correct (predictions that cover some box) by keys.

    A key is a page or a class of one, so its boxes meet in arrays after one shuffle, and both counts come from one comparison.
    """
    arrays = sided(gt, pred, keys).groupBy(*keys).agg(F.collect_list(F.when(F.col("is_gt"), F.col("e"))).alias("g"), F.collect_list(F.when(~F.col("is_gt"), F.col("e"))).alias("p"))
    box = lambda e: Box(*[e[x] for x in Box._fields])
    tp = F.size(F.filter("g", lambda g: F.exists("p", lambda p: covers(box(g), box(p), threshold))))
    correct = F.size(F.filter("p", lambda p: F.exists("g", lambda g: covers(box(g), box(p), threshold))))
    return arrays.select(*keys, F.size("g").cast("long").alias("n_gt"), F.size("p").cast("long").alias("n_pred"), tp.cast("long").alias("tp"), correct.cast("long").alias("correct"))


def nested_counts(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """counted() of each class of a page and, as category null, of the page whatever the class, from one shuffle by page."""
    rows = (gt if pred is None else sided(gt, pred, [*keys, "category"])).select(*keys, F.struct(F.col("category").alias("c"), *[F.col(f"e.{x}").alias(x) for x in Box._fields]).alias("e"), "is_gt")
    arrays = rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("is_gt"), F.col("e"))).alias("g"), F.collect_list(F.when(~F.col("is_gt"), F.col("e"))).alias("p"))
    box = lambda e: Box(*[e[x] for x in Box._fields])

    def flags(own: str, other: str, is_gt: bool) -> Column:
        """Of each box of a side: its class, whether a box of the other covers it (or it that), and whether one of its class does."""
        meets = lambda a, b: covers(box(a), box(b), threshold) if is_gt else covers(box(b), box(a), threshold)
        hits = lambda a: F.filter(other, lambda b: meets(a, b))
        met = F.transform(own, lambda a: F.struct(a["c"].alias("c"), F.transform(hits(a), lambda b: b["c"]).alias("by")))
        return F.transform(met, lambda x: F.struct(x["c"].alias("category"), F.lit(is_gt).alias("is_gt"), (F.size(x["by"]) > 0).alias("any"), F.array_contains(x["by"], x["c"]).alias("same")))

    each = arrays.select(*keys, F.explode(F.concat(flags("g", "p", True), flags("p", "g", False))).alias("x")).select(*keys, "x.*")
    # a row for the class and one for the page; both stay in the page's partition
    twice = F.explode(F.array(F.struct("category", F.col("same").alias("hit")), F.struct(F.lit(None).cast("string").alias("category"), F.col("any").alias("hit"))))
    sizes = [F.count_if("is_gt").alias("n_gt"), F.count_if(~F.col("is_gt")).alias("n_pred"), F.count_if(F.col("is_gt") & F.col("hit")).alias("tp"), F.count_if(~F.col("is_gt") & F.col("hit")).alias("correct")]
    return each.select(*keys, "is_gt", twice.alias("x")).select(*keys, "is_gt", "x.*").groupBy(*keys, "category").agg(*sizes)


def measured(counts: DataFrame, empty_recall: float) -> DataFrame:
    """precision, recall, f1, tp, fp, fn; empty_recall is the recall where nothing was annotated."""
    precision, recall = ratio(F.col("correct"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gt"), empty_recall)
    rest = [c for c in counts.columns if c not in ("n_gt", "n_pred", "tp", "correct")]
    return counts.select(*rest, "n_gt", "n_pred", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), "tp", (F.col("n_pred") - F.col("correct")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def per_class(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Each class of each document; where nothing is annotated, recall is 1."""
    return measured(counted(gt, pred, [*keys, "category"], threshold), 1.0)


def overall(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Each document whatever the class; where nothing is annotated, recall is 0."""
    return measured(counted(gt, pred, keys, threshold), 0.0)


def pooled(gt: DataFrame, pred: DataFrame | None, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Each class over all documents at once: a prediction counts for a box of another document too.

    Equal boxes of a class are one row with a number for each side, so what is compared grows
    with the number of different boxes and not with that of documents; boxes meet by the tiles
    they touch, and a pair counts in the tile where its common part begins. Where nothing is
    annotated, recall is 0.
    """
    b = Box.of()
    sizes = [F.count_if("is_gt").alias("n_gt"), F.count_if(~F.col("is_gt")).alias("n_pred")]
    once = sided(gt, pred, ["category"]).groupBy("category", *[F.col(f"e.{x}").alias(x) for x in Box._fields]).agg(*sizes)
    across = F.sequence(F.floor(b.x0 / tile), F.floor(b.x1 / tile))
    down = F.sequence(F.floor(b.y0 / tile), F.floor(b.y1 / tile))
    tiled = once.filter((b.x1 >= b.x0) & (b.y1 >= b.y0)).withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))
    side = lambda name: tiled.filter(F.col(f"n_{name}") > 0).select("category", "tx", "ty", F.struct(*Box._fields).alias(name), f"n_{name}")
    g, p = (Box(*[F.col(f"{name}.{x}") for x in Box._fields]) for name in SIDES)
    first = (F.col("tx") == F.floor(F.greatest(g.x0, p.x0) / tile)) & (F.col("ty") == F.floor(F.greatest(g.y0, p.y0) / tile))
    pairs = side("gt").join(side("pred"), ["category", "tx", "ty"]).filter(first & covers(g, p, threshold))
    tp = pairs.groupBy("category", "gt").agg(F.max("n_gt").alias("n")).groupBy("category").agg(F.sum("n").alias("tp"))
    correct = pairs.groupBy("category", "pred").agg(F.max("n_pred").alias("n")).groupBy("category").agg(F.sum("n").alias("correct"))
    joined = once.groupBy("category").agg(F.sum("n_gt").alias("n_gt"), F.sum("n_pred").alias("n_pred")).join(tp, "category", "left").join(correct, "category", "left")
    return measured(joined.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("tp", "correct")}), 0.0)


def macro(gt: DataFrame, pred: DataFrame | None, docs: DataFrame, keys: Sequence[str], classes: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Means of precision and recall over the documents that hold a class, each of classes a row, and a row all whatever the class.

    tp, fp and fn are sums over all documents. Of the row all, f1 comes from the two means,
    and precision_all_docs is a mean over documents without annotations too. Null where no
    document has annotations.
    """
    held = F.col("n_gt") > 0
    mean = lambda c: F.avg(F.when(held, F.col(c))).alias(c)
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("tp", "fp", "fn")]
    counts = nested_counts(gt, pred, keys, threshold)
    each = measured(counts.filter("category IS NOT NULL"), 1.0).groupBy("category").agg(mean("precision"), mean("recall"), *sums)
    names = gt.sparkSession.createDataFrame([(x,) for x in classes], "category string")
    each = names.join(each, "category", "left").select("category", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("precision", "recall")], F.lit(None).cast("double").alias("f1"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("tp", "fp", "fn")], F.lit(None).cast("double").alias("precision_all_docs"))
    whole = measured(counts.filter("category IS NULL"), 0.0)
    every = docs.select(*keys).join(whole, list(keys), "left").agg(mean("precision"), mean("recall"), *sums, F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision_all_docs"))
    f = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return each.unionByName(every.select(F.lit("all").alias("category"), "precision", "recall", f.alias("f1"), "tp", "fp", "fn", "precision_all_docs"))


def across_runs(runs: DataFrame) -> DataFrame:
    """Sample deviation of precision and recall by class over runs, times 100, of the classes of the first run."""
    first = runs.filter(F.col("run") == runs.select(F.min("run")).scalar()).select("class").distinct()
    return first.join(runs, "class").groupBy("class").agg(*[(F.stddev_samp(x) * 100).alias(f"{x}_std") for x in ("precision", "recall")], F.count(F.lit(1)).alias("n_runs"))


def tidy(metrics: DataFrame, run: str, test: str, columns: Sequence[str]) -> DataFrame:
    """(run, test_name, class, metric, value) rows for an experiment log; values that are missing are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
    return metrics.select(F.lit(run).alias("run"), F.lit(test).alias("test_name"), F.col("category").alias("class"), pairs.alias("x")).select("run", "test_name", "class", "x.*").filter("value IS NOT NULL")


def markdown(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One line of a table for each row of a report, and the two head lines; order says which comes first."""
    head = report.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "order int, line string")
    kinds = dict(report.dtypes)
    shown = [F.format_string("%.4f", c) if kinds[c] == "double" else F.col(c).cast("string") for c in columns]
    cells = [F.when(F.col(c).isNull(), "").otherwise(x) for c, x in zip(columns, shown, strict=True)]
    return head.unionByName(report.select(F.lit(2).alias("order"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
