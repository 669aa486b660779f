"""Queries on how well predictions meet annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.operators import annotate, detect, evaluate, tokens
from formlens.plans.common import COVERS, KEYS, annotated, docs, sides, sql

RATES = ("precision", "recall", "f1")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def coverage_eval_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.per_class(*sides(spark, sf_dir), KEYS), *RATES)


def coverage_eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.overall(*sides(spark, sf_dir), KEYS), *RATES)


def coverage_eval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.pooled(*sides(spark, sf_dir)), *RATES)


def coverage_eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.macro(*sides(spark, sf_dir), tokens.pages(docs(spark, sf_dir)), KEYS, tokens.CATEGORIES)
    return _rounded(found, *RATES, "precision_all_docs")


def run_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs, one for each remainder of the document's id."""
    each = evaluate.per_class(*sides(spark, sf_dir), KEYS).withColumn("run", (F.col("doc_id") % 5).cast("string"))
    sums = each.groupBy("run", "category").agg(*[F.sum(x).alias(x) for x in ("n_gt", "n_pred", "tp", "fp")]).withColumn("correct", F.col("n_pred") - F.col("fp")).drop("fp")
    runs = evaluate.measured(sums, 0.0).withColumnRenamed("category", "class")
    return _rounded(evaluate.across_runs(runs), "precision_std", "recall_std")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.tidy(evaluate.pooled(*sides(spark, sf_dir)), "run-1", "pages", ["precision", "recall", "f1", "tp", "fp", "fn"])
    return _rounded(found, "value")


def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detect.report(*sides(spark, sf_dir), KEYS, tokens.pages(docs(spark, sf_dir))), *RATES, "map50")


def detection_report_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images as one: a prediction takes the box of any image."""
    return _rounded(detect.report(*sides(spark, sf_dir), KEYS, tokens.pages(docs(spark, sf_dir)), over_images=True), *RATES, "map50")


def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.spans(annotated(spark, sf_dir), KEYS)


def seq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(annotate.sequence_metrics(annotated(spark, sf_dir), KEYS), *RATES)


def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir, "lang")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("tag") == F.col("pred_tag"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (coverage_eval_per_doc, coverage_eval_overall, coverage_eval_batch, coverage_eval_macro, run_std, metric_log, detection_report, detection_report_pooled, bio_spans, seq_metrics, token_accuracy)}


def _counts(keys: str, on: str) -> str:
    return f""", tps AS (SELECT {keys}, count(*) AS tp FROM (SELECT DISTINCT {keys}, doc_id AS d0, i AS i0 FROM gt g WHERE EXISTS (SELECT 1 FROM pred p WHERE {on} AND {COVERS})) GROUP BY ALL),
corrects AS (SELECT {keys}, count(*) AS correct FROM (SELECT DISTINCT {keys}, doc_id AS d0, i AS i0 FROM pred p WHERE EXISTS (SELECT 1 FROM gt g WHERE {on} AND {COVERS})) GROUP BY ALL),
sizes AS (SELECT {keys}, sum(g)::BIGINT AS n_gt, sum(p)::BIGINT AS n_pred FROM (SELECT {keys}, 1 AS g, 0 AS p FROM gt UNION ALL SELECT {keys}, 0, 1 FROM pred) GROUP BY ALL),
counts AS (SELECT {keys}, n_gt, n_pred, coalesce(tp, 0)::BIGINT AS tp, coalesce(correct, 0)::BIGINT AS correct FROM sizes LEFT JOIN tps USING ({keys}) LEFT JOIN corrects USING ({keys}))"""


def _measured(source: str, empty: str, name: str = "measured") -> str:
    return f""", {name}_rates AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / n_pred END AS p, CASE WHEN n_gt = 0 THEN {empty}::DOUBLE ELSE tp::DOUBLE / n_gt END AS r FROM {source}),
{name} AS (SELECT * EXCLUDE (p, r, correct), p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1, n_pred - correct AS fp, n_gt - tp AS fn FROM {name}_rates)"""


_SAME_CLASS = "p.doc_id = g.doc_id AND p.page = g.page AND p.category = g.category"
_PER_CLASS = _counts("doc_id, page, category", _SAME_CLASS) + _measured("counts", "1.0")
_OVERALL = _counts("doc_id, page", "p.doc_id = g.doc_id AND p.page = g.page") + _measured("counts", "0.0")
#: Equal boxes compare alike, so the pooled SQL also tests each once.
_POOLED = f""", g1 AS (SELECT category, x0, y0, x1, y1, count(*) AS n FROM gt GROUP BY ALL), p1 AS (SELECT category, x0, y0, x1, y1, count(*) AS n FROM pred GROUP BY ALL),
tps AS (SELECT category, sum(n) AS tp FROM g1 g WHERE EXISTS (SELECT 1 FROM p1 p WHERE p.category = g.category AND {COVERS}) GROUP BY category),
corrects AS (SELECT category, sum(n) AS correct FROM p1 p WHERE EXISTS (SELECT 1 FROM g1 g WHERE p.category = g.category AND {COVERS}) GROUP BY category),
sizes AS (SELECT category, sum(g)::BIGINT AS n_gt, sum(p)::BIGINT AS n_pred FROM (SELECT category, 1 AS g, 0 AS p FROM gt UNION ALL SELECT category, 0, 1 FROM pred) GROUP BY category),
counts AS (SELECT category, n_gt, n_pred, coalesce(tp, 0)::BIGINT AS tp, coalesce(correct, 0)::BIGINT AS correct FROM sizes LEFT JOIN tps USING (category) LEFT JOIN corrects USING (category))""" + _measured("counts", "0.0")
_SHOWN = "n_gt, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tp, fp, fn"
_SPANS = """, marks AS (SELECT doc_id, page, idx, side, substr(t, 1, 1) AS mark, CASE WHEN t = 'O' THEN 'O' ELSE substr(t, 3) END AS category
  FROM (SELECT doc_id, page, idx, 'g' AS side, tag AS t FROM annotated UNION ALL SELECT doc_id, page, idx, 'p', pred_tag FROM annotated)
), started AS (SELECT *, CASE WHEN mark = 'B' OR category IS DISTINCT FROM lag(category) OVER (PARTITION BY side, doc_id, page ORDER BY idx) THEN 1 ELSE 0 END AS fresh FROM marks
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY side, doc_id, page ORDER BY idx) AS run FROM started
), spans AS (SELECT side, doc_id, page, category, min(idx) AS "start", max(idx) AS "end" FROM numbered WHERE category <> 'O' GROUP BY side, doc_id, page, category, run)"""

ORACLES = {
    "coverage_eval_per_doc": sql(_PER_CLASS + f" SELECT doc_id, page, category, {_SHOWN} FROM measured"),
    "coverage_eval_overall": sql(_OVERALL + f" SELECT doc_id, page, {_SHOWN} FROM measured"),
    "coverage_eval_batch": sql(_POOLED + f" SELECT category, {_SHOWN} FROM measured"),
    "coverage_eval_macro": sql(
        _PER_CLASS
        + f""", all_tp AS (SELECT doc_id, page, count(*) AS tp FROM gt g WHERE EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.page = g.page AND {COVERS}) GROUP BY ALL),
all_correct AS (SELECT doc_id, page, count(*) AS correct FROM pred p WHERE EXISTS (SELECT 1 FROM gt g WHERE p.doc_id = g.doc_id AND p.page = g.page AND {COVERS}) GROUP BY ALL),
all_sizes AS (SELECT doc_id, page, sum(n_gt)::BIGINT AS n_gt, sum(n_pred)::BIGINT AS n_pred FROM counts GROUP BY doc_id, page),
all_counts AS (SELECT doc_id, page, n_gt, n_pred, coalesce(tp, 0)::BIGINT AS tp, coalesce(correct, 0)::BIGINT AS correct FROM all_sizes LEFT JOIN all_tp USING (doc_id, page) LEFT JOIN all_correct USING (doc_id, page))"""
        + _measured("all_counts", "0.0", "whole")
        + """, names AS (SELECT unnest(['full_name', 'company_name', 'address', 'phone_number', 'car_plate', 'payment_information']) AS category),
every AS (SELECT avg(precision) FILTER (n_gt > 0) AS p, avg(recall) FILTER (n_gt > 0) AS r, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn, avg(coalesce(precision, 0)) AS pa
  FROM (SELECT doc_id, page FROM pages) LEFT JOIN whole USING (doc_id, page))
SELECT category, round(coalesce(avg(precision) FILTER (n_gt > 0), 0), 6) AS precision, round(coalesce(avg(recall) FILTER (n_gt > 0), 0), 6) AS recall, NULL::DOUBLE AS f1,
  coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn, NULL::DOUBLE AS precision_all_docs FROM names LEFT JOIN measured USING (category) GROUP BY category
UNION ALL SELECT 'all', round(p, 6), round(r, 6), CASE WHEN p + r = 0 THEN NULL ELSE round(2 * p * r / (p + r), 6) END, tp, fp, fn, round(pa, 6) FROM every"""
    ),
    "run_std": sql(
        _PER_CLASS + ", runs AS (SELECT doc_id % 5 AS run, category, sum(n_gt) AS n_gt, sum(n_pred) AS n_pred, sum(tp) AS tp, sum(n_pred - fp) AS correct FROM measured GROUP BY ALL)" + _measured("runs", "0.0", "each")
        + " SELECT category AS class, round(stddev_samp(precision) * 100, 6) AS precision_std, round(stddev_samp(recall) * 100, 6) AS recall_std, count(*)::BIGINT AS n_runs FROM each"
        " WHERE category IN (SELECT category FROM each WHERE run = (SELECT min(run) FROM each)) GROUP BY category"
    ),
    "metric_log": sql(
        _POOLED + " SELECT 'run-1' AS run, 'pages' AS test_name, category AS class, metric, round(value, 6) AS value FROM (SELECT category, precision, recall, f1, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn FROM measured)"
        " UNPIVOT (value FOR metric IN (precision, recall, f1, tp, fp, fn))"
    ),
    "bio_spans": sql(_SPANS + ' SELECT doc_id, page, category, "start", "end" FROM spans WHERE side = \'g\''),
    "seq_metrics": sql(
        _SPANS + ', paired AS (SELECT category, max(CASE WHEN side = \'g\' THEN 1 ELSE 0 END) AS g, max(CASE WHEN side = \'p\' THEN 1 ELSE 0 END) AS p FROM spans GROUP BY doc_id, page, category, "start", "end"),'
        " each AS (SELECT category, sum(g) AS n_gt, sum(p) AS n_pred, sum(g * p) AS tp FROM paired GROUP BY category),"
        " every AS (SELECT * FROM each UNION ALL SELECT 'all', coalesce(sum(n_gt), 0), coalesce(sum(n_pred), 0), coalesce(sum(tp), 0) FROM each),"
        " rates AS (SELECT category, n_gt::BIGINT AS support, CASE WHEN n_pred = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_pred END AS p, CASE WHEN n_gt = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n_gt END AS r FROM every)"
        " SELECT category, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS f1, support FROM rates"
    ),
    "token_accuracy": sql(" SELECT lang, count(*)::BIGINT AS n, round(avg(CASE WHEN tag = pred_tag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM annotated GROUP BY lang"),
}
