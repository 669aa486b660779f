"""Detections against annotated boxes: one-to-one matches by overlap, and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.functions.geometry import Box, iou, touching
from formlens.functions.text import f1, ratio
from formlens.operators.evaluate import TILE, sided
from formlens.operators.links import components

THRESHOLD = 0.7


def matches(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """n_gt, n_pred and tp by keys: each prediction, in order of id, takes the box that it overlaps most of those left, the first of equal ones.

    Keys name the image and the class, so matches never cross images, and the fold runs over the boxes of one of them.
    """
    arrays = sided(gt, pred, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("is_gt"), F.col("e")))).alias("g"), F.sort_array(F.collect_list(F.when(~F.col("is_gt"), F.col("e")))).alias("p"))
    box = lambda e: Box(*[e[x] for x in Box._fields])

    def near(p):
        """The boxes that overlap p enough, worked out once; p takes one of these or none."""
        overlap = F.transform("g", lambda g, i: F.struct(F.when(touching(box(p), box(g)), iou(box(p), box(g))).otherwise(0.0).alias("v"), (-i).alias("i")))
        return F.filter(overlap, lambda x: x["v"] >= threshold)

    def step(taken, options):
        left = F.array_max(F.filter(options, lambda x: ~F.array_contains(taken, x["i"])))
        return F.concat(taken, F.transform(F.array_compact(F.array(left)), lambda x: x["i"]))

    arrays = arrays.withColumn("near", F.filter(F.transform("p", near), lambda x: F.size(x) > 0))
    tp = F.when(F.size("g") == 0, F.lit(0)).otherwise(F.size(F.aggregate("near", F.array().cast("array<int>"), step)))
    return arrays.select(*keys, F.size("g").cast("long").alias("n_gt"), F.size("p").cast("long").alias("n_pred"), tp.cast("long").alias("tp"))


def overlapping(once: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(category, gt, pred, overlap) of the pairs of different boxes of once (category, is_gt, node, box) that overlap enough, by node; boxes meet by the tiles they touch, and count in the one where their common part begins."""
    b = Box.of()
    steps = lambda a, z: F.explode(F.sequence(F.floor(a / tile), F.floor(z / tile)))
    tiled = once.filter((b.x1 >= b.x0) & (b.y1 >= b.y0)).withColumn("tx", steps(b.x0, b.x1)).withColumn("ty", steps(b.y0, b.y1))
    side = lambda name, is_gt: tiled.filter(F.col("is_gt") == is_gt).select("category", "tx", "ty", F.col("node").alias(name), F.struct(*Box._fields).alias(f"{name}_box"))
    g, p = (Box(*[F.col(f"{name}_box.{x}") for x in Box._fields]) for name in ("gt", "pred"))
    first = (F.col("tx") == F.floor(F.greatest(g.x0, p.x0) / tile)) & (F.col("ty") == F.floor(F.greatest(g.y0, p.y0) / tile))
    pairs = side("gt", True).join(side("pred", False), ["category", "tx", "ty"]).filter(first & touching(p, g))
    return pairs.select("category", "gt", "pred", iou(p, g).alias("overlap")).filter(F.col("overlap") >= threshold)


EDGE, ANNOTATED, PREDICTED = 0, 1, 2


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(category, tp) of each component of a sorted partition: its edges, annotated boxes and predictions, each in order.

    Equal boxes are told apart only where two different boxes overlap a prediction alike, so
    that the first of them in order goes; else their number is enough.
    """
    at, tp, place, found = None, 0, 0, []
    options: dict[int, list[tuple[float, int]]] = {}
    left: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    for batch in batches:
        for row in zip(*[batch.column(x).to_pylist() for x in ("category", "root", "kind", "box", "other", "overlap")], strict=True):
            *key, kind, box, other, overlap = row
            if key != at:
                if at is not None:
                    found.append((at[0], tp))
                at, tp, options, left, places = key, 0, {}, {}, {}
            if kind == EDGE:
                near = options.setdefault(box, [])
                for v, b in near:
                    if v == overlap:
                        places[b], places[other] = [], []
                near.append((overlap, other))
            elif kind == ANNOTATED:
                left[box] = left.get(box, 0) + 1
                place += 1
                if box in places:
                    places[box].append(place)
            else:
                open_ = [(v, -places[b][-left[b]] if b in places else 0, b) for v, b in options[box] if left[b]]
                if open_:
                    left[max(open_)[2]] -= 1
                    tp += 1
        yield pa.RecordBatch.from_pylist([{"category": c, "tp": n} for c, n in found], pa.schema([("category", pa.string()), ("tp", pa.int64())]))
        found = []
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"category": at[0], "tp": tp}], pa.schema([("category", pa.string()), ("tp", pa.int64())]))


def pooled(gt: DataFrame, pred: DataFrame | None, keys: Sequence[str], threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """n_gt, n_pred and tp of each class over all images at once: predictions, in order of keys and id, take a box of any image, as if all lay on one.

    Which prediction takes which box only depends on the boxes that overlaps link it with,
    so different boxes are linked by a join on tiles, and the choice in order is made within
    one component of links, by a task that reads its rows in order and keeps a number a box.
    A threshold of 0 would link boxes that don't touch and is refused.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    rows = sided(gt, pred, [*keys, "category"]).select(*keys, "category", "is_gt", F.col("e.id").alias("id"), *[F.col(f"e.{x}").alias(x) for x in Box._fields])
    rows = rows.withColumn("node", F.xxhash64("category", "is_gt", *[F.col(x).cast("double") for x in Box._fields]))
    sizes = rows.groupBy("category").agg(F.count_if("is_gt").alias("n_gt"), F.count_if(~F.col("is_gt")).alias("n_pred"))
    edges = overlapping(rows.select("category", "is_gt", "node", *Box._fields).distinct(), threshold, tile)
    roots = components(edges.select(F.col("gt").alias("u"), F.col("pred").alias("v")))
    none = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in (*keys, "id")]
    linked = edges.join(roots.select(F.col("node").alias("gt"), "root"), "gt").select("category", "root", F.lit(EDGE).alias("kind"), *none, F.col("pred").alias("box"), F.col("gt").alias("other"), "overlap")
    kind = F.when(F.col("is_gt"), ANNOTATED).otherwise(PREDICTED)
    boxes = rows.join(roots, "node").select("category", "root", kind.alias("kind"), *keys, "id", F.col("node").alias("box"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("overlap"))
    order = ["category", "root", "kind", *keys, "id", "overlap", "box", "other"]
    dealt = linked.unionByName(boxes).repartition("category", "root").sortWithinPartitions(*order)
    tp = dealt.select("category", "root", "kind", "box", "other", "overlap").mapInArrow(taken, "category string, tp bigint").groupBy("category").agg(F.sum("tp").alias("tp"))
    return sizes.join(tp, "category", "left").withColumn("tp", F.coalesce("tp", F.lit(0)).cast("long"))


def report(gt: DataFrame, pred: DataFrame | None, image: Sequence[str], pages: DataFrame, threshold: float = THRESHOLD, over_images: bool = False) -> DataFrame:
    """With over_images, a prediction may take a box of another image. images (of all, those of pages, with boxes or without), instances, precision, recall, f1 and map50 of each class, and of all; map50 is the precision, as there is one threshold, and of all the mean over classes."""
    if over_images:
        held = sided(gt, pred, [*image, "category"]).filter("is_gt").select(*image, "category").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("images"))
        found = pooled(gt, pred, image, threshold).join(held, "category", "left")
        each = found.select("category", F.coalesce("images", F.lit(0)).alias("images"), F.col("n_gt").alias("instances"), "n_pred", "tp")
    else:
        found = matches(gt, pred, [*image, "category"], threshold)
        each = found.groupBy("category").agg(F.count_if(F.col("n_gt") > 0).alias("images"), F.sum("n_gt").alias("instances"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("instances"))
    shown = lambda rows, map50: rows.select("category", "images", "instances", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), map50.alias("map50"))
    images = pages.select(*image).distinct().agg(F.count(F.lit(1)).alias("images"))
    sums = each.agg(F.coalesce(F.sum("instances"), F.lit(0)).alias("instances"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.avg(precision).alias("mean"))
    every = sums.select(F.lit("all").alias("category"), images.scalar().alias("images"), "instances", "n_pred", "tp", "mean")
    return shown(each, precision).unionByName(shown(every, F.coalesce("mean", F.lit(0.0))))
