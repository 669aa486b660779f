"""Tables that several queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formlens.operators import evaluate, tokens

KEYS = ("doc_id", "page")
#: Input partitions that a small file is dealt into before work that multiplies its rows.
SPREAD = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where the scan has fewer partitions than cores can work on, dealt out, as a file of one row group is read in one task."""
    found = table(spark, sf_dir, "documents")
    wanted = min(SPREAD, spark.sparkContext.defaultParallelism)
    return found if found.rdd.getNumPartitions() >= wanted else found.repartition(wanted)


def annotated(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return tokens.annotated(docs(spark, sf_dir), *more)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, None]:
    """Annotated and predicted entities of all pages, in one table."""
    return evaluate.both_sides(annotated(spark, sf_dir), KEYS, shift="shift"), None


TOKENS = r"""
words AS (
  SELECT doc_id, lang, source, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS ws FROM documents
), listed AS (
  SELECT doc_id, lang, source, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM words
), tokens AS (
  SELECT doc_id, lang, source, token, i, (i // 320)::INT AS page, (i % 320)::INT AS idx,
         (5 + (i % 320) % 8 * 95)::INT AS x0, (4 + (i % 320) // 8 * 26)::INT AS y0,
         (5 + (i % 320) % 8 * 95 + least(90, length(token) * 7))::INT AS x1, (22 + (i % 320) // 8 * 26)::INT AS y1,
         (doc_id * 31 + i * 17) % 97 AS r, (doc_id * 13 + i * 7) % 29 AS d
  FROM listed
), pages AS (
  SELECT doc_id, lang, source, unnest(range(greatest((coalesce(len(ws), 0) - 1) // 320, 0) + 1))::INT AS page FROM words
), golden AS (
  SELECT *, CASE WHEN r < 6 THEN 'B-' || ['full_name', 'company_name', 'address', 'phone_number', 'car_plate', 'payment_information'][r + 1]
                 WHEN r < 9 THEN 'I-' || ['full_name', 'company_name', 'address', 'phone_number', 'car_plate', 'payment_information'][r - 5] ELSE 'O' END AS tag
  FROM tokens
), annotated AS (
  SELECT *, CASE WHEN tag = 'O' THEN CASE WHEN d = 5 AND r BETWEEN 40 AND 44 THEN 'B-address' ELSE 'O' END WHEN d = 0 THEN 'O'
                 WHEN d = 1 THEN substr(tag, 1, 2) || CASE WHEN tag LIKE '%address' THEN 'company_name' ELSE 'address' END ELSE tag END AS pred_tag,
         CASE WHEN d BETWEEN 2 AND 4 THEN d * 5 ELSE 0 END::INT AS shift
  FROM golden
), gt AS (
  SELECT doc_id, page, substr(tag, 3) AS category, i, x0, y0, x1, y1 FROM annotated WHERE tag <> 'O'
), pred AS (
  SELECT doc_id, page, substr(pred_tag, 3) AS category, i, x0 + shift AS x0, y0, x1 + shift AS x1, y1 FROM annotated WHERE pred_tag <> 'O'
)"""
#: Whether a prediction p covers a box g.
COVERS = """(g.x1 - g.x0) * (g.y1 - g.y0) > 0 AND (greatest(least(g.x1, p.x1) - greatest(g.x0, p.x0), 0) * greatest(least(g.y1, p.y1) - greatest(g.y0, p.y0), 0))::DOUBLE
  / ((g.x1 - g.x0) * (g.y1 - g.y0)) >= 0.7"""


def sql(rest: str) -> str:
    return f"WITH {TOKENS.strip()}{rest}"
