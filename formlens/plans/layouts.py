"""Queries on how pages are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions import geometry as geo
from formlens.functions.geometry import Box
from formlens.operators import diversity, tokens
from formlens.plans.common import KEYS, annotated, docs, sql


def _tagged(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return annotated(spark, sf_dir, *more).filter("tag <> 'O'")


def token_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.cell(Box.of())
    rows = tokens.laid_out(docs(spark, sf_dir)).withColumns({"gx": x, "gy": y})
    return rows.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.sum(geo.area(Box.of())).alias("area"), F.count_distinct("doc_id", "page").alias("n_pages"))


def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tokens.pages(docs(spark, sf_dir), "source")
    found = diversity.by_document(_tagged(spark, sf_dir, "source"), (*KEYS, "source"), every)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("coverage"), 6).alias("coverage"))


def grid_diversity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tokens.pages(docs(spark, sf_dir), "lang")
    found = diversity.by_document(_tagged(spark, sf_dir, "lang"), (*KEYS, "lang"), every)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("cells"), 6).alias("grid_diversity"))


def layout_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tokens.pages(docs(spark, sf_dir))
    found = diversity.uniqueness(diversity.by_document(_tagged(spark, sf_dir), KEYS, every))
    return found.withColumn("uniqueness", F.round("uniqueness", 6))


def page_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diversity.by_document(_tagged(spark, sf_dir), KEYS, tokens.pages(docs(spark, sf_dir)))
    return found.select(*KEYS, F.round("coverage", 6).alias("coverage"), "cells", "mask")


def center_heatmap10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.heatmap(_tagged(spark, sf_dir))


def heatmap_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diversity.entropy(diversity.heatmap(_tagged(spark, sf_dir, "lang"), 10, "lang"), "lang")
    return found.select("lang", F.round("entropy", 6).alias("entropy"))


def heatmap_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.kernel_heat(diversity.heatmap(_tagged(spark, sf_dir))).withColumn("heat", F.round("heat", 6))


def bbox_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diversity.sizes(_tagged(spark, sf_dir, "lang"), 50, "lang")
    return diversity.cumulative(found, "bin", "lang", "side").withColumn("share", F.round("share", 6))


def bbox_scale_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.lit(612), F.lit(792)
    rows = _tagged(spark, sf_dir)
    n = geo.normalised(Box.of(), F.lit(geo.PAGE_WIDTH), F.lit(geo.PAGE_HEIGHT))
    rows = rows.select("doc_id", "i", *geo.scaled(Box.of(), width, height).named("s_"), *n.named("n_"))
    return rows.select("*", *geo.unnormalised(Box.of("n_"), F.lit(geo.PAGE_WIDTH), F.lit(geo.PAGE_HEIGHT)).named("u_"), geo.well_formed(Box.of("n_")).alias("ok"))


def bbox_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes zoomed and clipped, pasted, and rotated both ways and truncated, rounded."""
    rows = _tagged(spark, sf_dir)
    w, h = F.lit(geo.PAGE_WIDTH), F.lit(geo.PAGE_HEIGHT)
    angle = (F.col("doc_id") % 7 - 3).cast("double")
    moved = {
        "c_": geo.clipped(geo.zoomed(Box.of(), F.lit(1.5)), w, h), "p_": geo.pasted(Box.of(), F.lit(0.75), F.lit(12), F.lit(30)),
        "r_": geo.truncated(geo.rotated(Box.of(), angle, w, h)), "q_": geo.truncated(geo.rotated(Box.of(), angle, w, h, clockwise=True)),
    }
    return rows.select("doc_id", "i", *[F.round(c.cast("double"), 4).alias(f"{k}{n}") for k, b in moved.items() for n, c in zip(Box._fields, b, strict=True)])


QUERIES = {f.__name__: f for f in (token_layout, coverage_by_source, grid_diversity_by_lang, layout_uniqueness, page_masks, center_heatmap10, heatmap_entropy, heatmap_kernel, bbox_size_hist, bbox_scale_normalize, bbox_moves)}

_CELLS = """, boxed AS (
  SELECT *, least(trunc((x0 + x1) / 2.0::DOUBLE / 770 * 4)::INT, 3) AS gx, least(trunc((y0 + y1) / 2.0::DOUBLE / 1048 * 4)::INT, 3) AS gy FROM golden
), masks AS (
  SELECT p.doc_id, p.page, p.lang, p.source, coalesce(sum((x1 - x0) * (y1 - y0)), 0)::DOUBLE / (770 * 1048) * 100 AS coverage,
         coalesce(bit_or(1::BIGINT << (gy * 4 + gx)), 0) AS mask
  FROM pages p LEFT JOIN (SELECT * FROM boxed WHERE tag <> 'O') b ON p.doc_id = b.doc_id AND p.page = b.page GROUP BY ALL
)"""
_HEAT = """, edges AS (SELECT range * 0.1::DOUBLE AS e FROM range(1, 10)), centres AS (
  SELECT lang, (x0 + x1) / 2.0::DOUBLE / 770 AS cx, 1 - (y0 + y1) / 2.0::DOUBLE / 1048 AS cy FROM golden WHERE tag <> 'O'
), binned AS (
  SELECT lang, len(list_filter((SELECT list(e) FROM edges), lambda e: e <= cx))::INT AS bx, len(list_filter((SELECT list(e) FROM edges), lambda e: e <= cy))::INT AS "by"
  FROM centres WHERE cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1
), heat AS (SELECT bx, "by", count(*)::BIGINT AS n FROM binned GROUP BY bx, "by")"""
_ROUNDED = lambda prefix, exprs: ", ".join(f"round(({e})::DOUBLE, 4) AS {prefix}{n}" for n, e in zip(("x0", "y0", "x1", "y1"), exprs, strict=True))
_TURNED = lambda sign: [
    f"trunc({pick}({', '.join(corner.format(x=x, y=y, s=sign) for x in ('x0', 'x1') for y in ('y0', 'y1'))}))"
    for pick, corner in (
        ("least", "(({x} - 385.0) * co - ({y} - 524.0) * si * {s} + 385.0)"), ("least", "(({x} - 385.0) * si * {s} + ({y} - 524.0) * co + 524.0)"),
        ("greatest", "(({x} - 385.0) * co - ({y} - 524.0) * si * {s} + 385.0)"), ("greatest", "(({x} - 385.0) * si * {s} + ({y} - 524.0) * co + 524.0)"),
    )
]

ORACLES = {
    "token_layout": sql(_CELLS + " SELECT gx, gy, count(*)::BIGINT AS n, sum((x1 - x0) * (y1 - y0))::BIGINT AS area, count(DISTINCT (doc_id, page))::BIGINT AS n_pages FROM boxed GROUP BY gx, gy"),
    "coverage_by_source": sql(_CELLS + " SELECT source, count(*)::BIGINT AS n_pages, round(avg(coverage), 6) AS coverage FROM masks GROUP BY source"),
    "grid_diversity_by_lang": sql(_CELLS + " SELECT lang, count(*)::BIGINT AS n_pages, round(avg(bit_count(mask) / 16.0::DOUBLE * 100), 6) AS grid_diversity FROM masks GROUP BY lang"),
    "layout_uniqueness": sql(
        _CELLS + " SELECT sum(n)::BIGINT AS n_docs, count(*)::BIGINT AS n_masks, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS n_unique,"
        " round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(n) * 100, 6) AS uniqueness FROM (SELECT mask, count(*) AS n FROM masks GROUP BY mask)"
    ),
    "page_masks": sql(_CELLS + " SELECT doc_id, page, round(coverage, 6) AS coverage, bit_count(mask) / 16.0::DOUBLE * 100 AS cells, mask FROM masks"),
    "center_heatmap10": sql(_HEAT + " SELECT * FROM heat"),
    "heatmap_entropy": sql(
        _HEAT + ", each AS (SELECT lang, count(*)::DOUBLE AS n FROM binned GROUP BY lang, bx, \"by\"), shares AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM each)"
        " SELECT lang, round(-sum(p * ln(p)), 6) AS entropy FROM shares GROUP BY lang"
    ),
    "heatmap_kernel": sql(
        _HEAT + ", steps AS (SELECT range AS k FROM range(-3, 4)) SELECT (bx + a.k)::INT AS bx, (\"by\" + b.k)::INT AS \"by\", round(sum(n * exp(-(a.k * a.k + b.k * b.k) / 2.0::DOUBLE)), 6) AS heat"
        " FROM heat, steps a, steps b WHERE bx + a.k BETWEEN 0 AND 9 AND \"by\" + b.k BETWEEN 0 AND 9 GROUP BY 1, 2"
    ),
    "bbox_size_hist": sql(
        ", sides AS (SELECT lang, 'width' AS side, (x1 - x0) / 770.0::DOUBLE AS v FROM golden WHERE tag <> 'O' UNION ALL SELECT lang, 'height', (y1 - y0) / 1048.0::DOUBLE FROM golden WHERE tag <> 'O'),"
        " binned AS (SELECT lang, side, least(floor(v * 50), 49)::INT AS bin, count(*)::BIGINT AS n FROM sides GROUP BY ALL)"
        " SELECT lang, side, bin, n, round(sum(n) OVER (PARTITION BY lang, side ORDER BY bin)::DOUBLE / sum(n) OVER (PARTITION BY lang, side), 6) AS share FROM binned"
    ),
    "bbox_scale_normalize": sql(
        ", scaled AS (SELECT doc_id, i::INT AS i, "
        + ", ".join(f"trunc({c} * ({to}.0::DOUBLE / {of}))::INT AS s_{c}, trunc({c}::DOUBLE / {to} * 1000)::INT AS n_{c}" for c, to, of in (("x0", 770, 612), ("y0", 1048, 792), ("x1", 770, 612), ("y1", 1048, 792)))
        + " FROM golden WHERE tag <> 'O') SELECT *, "
        + ", ".join(f"trunc({to} * (n_{c}::DOUBLE / 1000))::INT AS u_{c}" for c, to in (("x0", 770), ("y0", 1048), ("x1", 770), ("y1", 1048)))
        + ", n_x0 >= 0 AND n_y0 >= 0 AND n_x1 <= 1000 AND n_y1 <= 1000 AND n_x0 <= n_x1 AND n_y0 <= n_y1 AS ok FROM scaled"
    ),
    "bbox_moves": sql(
        ", turned AS (SELECT *, cos(radians((doc_id % 7 - 3)::DOUBLE)) AS co, sin(radians((doc_id % 7 - 3)::DOUBLE)) AS si, x1 * 1.5 > 770 OR y1 * 1.5 > 1048 AS outside FROM golden WHERE tag <> 'O')"
        " SELECT doc_id, i::INT AS i, "
        + _ROUNDED("c_", ["x0 * 1.5", "y0 * 1.5", "CASE WHEN outside THEN least(x1 * 1.5, 769) ELSE x1 * 1.5 END", "CASE WHEN outside THEN least(y1 * 1.5, 1047) ELSE y1 * 1.5 END"])
        + ", " + _ROUNDED("p_", ["x0 * 0.75 + 12", "y0 * 0.75 + 30", "x1 * 0.75 + 12", "y1 * 0.75 + 30"]) + ", " + _ROUNDED("r_", _TURNED(1)) + ", " + _ROUNDED("q_", _TURNED(-1)) + " FROM turned"
    ),
}
