"""Queries that make values, names and source texts up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions import text as tx
from formlens.functions.draws import uniform
from formlens.operators import curate, synth
from formlens.plans.common import annotated, docs, sql, table

#: Page formats and kinds that a made-up document names.
VOCABULARY = {"doc_format": ["html", "latex"], "document_type": ["invoice", "letter", "form", "contract"], "layout": ["one column", "two columns", "header and table"]}


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value): names of customers, suppliers and parts by what they may stand for."""
    customer, supplier, part = (table(spark, sf_dir, x) for x in ("customer", "supplier", "part"))
    return curate.merged_pool(
        customer.select(F.lit("full_name").alias("key"), F.col("c_name").alias("value")), supplier.select(F.lit("company_name").alias("key"), F.col("s_name").alias("value")),
        part.select(F.lit("address").alias("key"), F.col("p_name").alias("value")), customer.select(F.lit("company_name").alias("key"), F.col("c_mktsegment").alias("value")),
    )


def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.top_values(_words(spark, sf_dir), 100).withColumn("pos", F.col("pos").cast("int"))


def pool_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"))


def document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = curate.top_values(_words(spark, sf_dir)).withColumn("value", F.replace("value", F.lit("#"), F.lit(" ")))
    found = synth.document_values(docs(spark, sf_dir), pool)
    return found.withColumn("value", synth.adjusted(F.col("value"), F.col("category"), F.col("doc_id"), F.col("category"), F.col("n")))


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address and a full name for each document, from lists of words."""
    lists = {
        "street": ["Elm Street", "High Road", "Mill Lane"], "city": ["Oldtown", "Newport", "Weston"], "zip_code": ["10001", "20002", "30003"], "building_number": ["1", "22", "333"],
        "first_name": ["Ada", "Ben", "Cleo"], "middle_name": ["Mary", "Lee"], "last_name": ["Stone", "Rivers", "Marsh"],
    }
    parts = docs(spark, sf_dir).select(F.col("doc_id").alias("key"), *[F.array(*[F.lit(x) for x in v]).alias(k) for k, v in lists.items()])
    return synth.full_names(synth.addresses(parts)).select(F.col("key").alias("doc_id"), "address", "full_name")


def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.scan_plan(docs(spark, sf_dir)).withColumns({"copy": F.col("copy").cast("int"), "step": F.col("step").cast("int")})


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.catalogue_rows(docs(spark, sf_dir).select("doc_id"), VOCABULARY)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a model would send them: some fenced once, some twice, some bare."""
    block = F.concat(F.lit("```html\n<p style=\"font-size: "), (F.col("doc_id") % 9 + 8).cast("string"), F.lit("px;\">"), "text", F.lit("</p>\n```"))
    kind = F.col("n_chars") % 3
    return docs(spark, sf_dir).select("doc_id", F.when(kind == 0, F.concat(F.lit("Here it is:\n"), block)).when(kind == 1, F.concat(block, F.lit("\n"), block)).otherwise(F.concat(F.lit("<i>"), "text", F.lit("</i>"))).alias("answer"))


def fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", tx.fenced(F.col("answer"), "html").alias("html"))


def font_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _answers(spark, sf_dir).select("doc_id", tx.smaller_html_font(F.col("answer")).alias("html"))
    latex = F.concat(F.lit("\\documentclass["), (F.col("doc_id") % 3 + 10).cast("string"), F.lit("pt]{article}\n"))
    return html.select("doc_id", "html", tx.with_graphics(tx.smaller_latex_font(latex)).alias("latex"))


def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to name a tag's class."""
    tag = F.col("tag")
    rows = annotated(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("tag", "n", tx.category(tag).alias("category"), tx.last_part(tag).alias("last_part"), tx.without_marks(tag).alias("bare"), tx.label_name(tag).alias("label"))


def drawn_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly draws fall over tenths."""
    return docs(spark, sf_dir).groupBy(F.floor(uniform("share", F.col("doc_id")) * 10).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (topk_per_key, pool_values, document_values, made_names, scan_plan, catalogue_rows, fence_extract, font_shrink, tag_names, drawn_share)}

_BITS = lambda seed, key: f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"
_U = lambda seed, key: f"({_BITS(seed, key)} / 4294967296.0::DOUBLE)"
_WORDS = """WITH words AS (SELECT DISTINCT key, value FROM (SELECT 'full_name' AS key, c_name AS value FROM customer UNION ALL SELECT 'company_name', s_name FROM supplier
UNION ALL SELECT 'address', p_name FROM part UNION ALL SELECT 'company_name', c_mktsegment FROM customer))"""
_PICK = lambda values, seed: f"[{', '.join(repr(x) for x in values)}][{_BITS(seed, 'doc_id')} % {len(values)} + 1]"
_PARTS = {"street": ["Elm Street", "High Road", "Mill Lane"], "city": ["Oldtown", "Newport", "Weston"], "zip_code": ["10001", "20002", "30003"], "building_number": ["1", "22", "333"]}
_ORDERS = "[" + ", ".join("[" + ", ".join(o) + "]" for o in synth.ADDRESS_ORDERS) + "]"
_ANSWERS = """WITH blocks AS (SELECT doc_id, n_chars, text, '```html' || chr(10) || '<p style="font-size: ' || (doc_id % 9 + 8) || 'px;">' || text || '</p>' || chr(10) || '```' AS b,
  '<p style="font-size: ' || (doc_id % 9 + 8) || 'px;">' || text || '</p>' AS inside FROM documents)"""
_CHANGES = ", ".join(f"'{c}'" for c in synth.CHANGES)

ORACLES = {
    "topk_per_key": _WORDS + f", ranked AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY {_U('pool', 'value')}, value)::INT AS pos FROM words) SELECT * FROM ranked WHERE pos <= 100",
    "pool_values": _WORDS + ' SELECT key, count(*)::BIGINT AS n, min(value) AS "least", max(value) AS "largest" FROM words GROUP BY key',
    "made_names": "WITH parts AS (SELECT doc_id, "
    + ", ".join(f"{_PICK(v, f'address-{k}')} AS {k}" for k, v in _PARTS.items())
    + f" FROM documents), ordered AS (SELECT doc_id, {_ORDERS}[{_BITS('address', 'doc_id')} % 12 + 1] AS o FROM parts) SELECT doc_id,"
    + f" CASE WHEN {_BITS('address-sign', 'doc_id')} % 2 = 0 THEN array_to_string(o, ', ') ELSE array_to_string(o, ' ') END AS address,"
    + f" concat_ws(' ', {_PICK(['Ada', 'Ben', 'Cleo'], 'name-first_name')}, CASE WHEN {_U('name', 'doc_id')} <= 0.2 THEN {_PICK(['Mary', 'Lee'], 'name-middle_name')} END, {_PICK(['Stone', 'Rivers', 'Marsh'], 'name-last_name')}) AS full_name FROM ordered",
    "scan_plan": f"""WITH drawn AS (SELECT doc_id, copy, c, row_number() OVER (PARTITION BY doc_id, copy ORDER BY {_U('scan', "doc_id || ':' || copy || ':' || c")}, c) AS k
  FROM documents, (SELECT unnest([1, 2, 3]) AS copy), (SELECT unnest([{_CHANGES}]) AS c)), few AS (SELECT doc_id, copy, c FROM drawn WHERE k <= 3 UNION ALL SELECT doc_id, copy, 'paste' FROM documents, (SELECT unnest([1, 2, 3]) AS copy)),
mixed AS (SELECT *, bool_or(c = 'shadow') OVER (PARTITION BY doc_id, copy) AS dark, {_U('scan-order', "doc_id || ':' || copy || ':' || c")} AS u FROM few)
SELECT doc_id, copy, (row_number() OVER (PARTITION BY doc_id, copy ORDER BY u, c) - 1)::INT AS step, c AS change FROM mixed WHERE NOT (dark AND c = 'brightness')""",
    "catalogue_rows": "SELECT doc_id, substr(md5('catalogue:' || doc_id), 1, 7) AS short_id, " + ", ".join(f"{_PICK(v, f'catalogue-{k}')} AS {k}" for k, v in VOCABULARY.items()) + " FROM documents",
    "fence_extract": _ANSWERS + " SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN inside WHEN 1 THEN chr(10) || inside || chr(10) || chr(10) || chr(10) || inside || chr(10) ELSE '<i>' || text || '</i>' END AS html FROM blocks",
    "font_shrink": _ANSWERS
    + """, answers AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'Here it is:' || chr(10) || b WHEN 1 THEN b || chr(10) || b ELSE '<i>' || text || '</i>' END AS a FROM blocks)
SELECT doc_id, replace(a, 'font-size: ' || (doc_id % 9 + 8) || 'px;', 'font-size: ' || (doc_id % 9 + 7) || 'px;') AS html,
  '\\documentclass[' || (doc_id % 3 + 9) || 'pt]{article}' || chr(10) || '\\usepackage{graphicx}' || chr(10) AS latex FROM answers""",
    "drawn_share": f"SELECT floor({_U('share', 'doc_id')} * 10)::INT AS tenth, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "tag_names": sql(" SELECT tag, count(*)::BIGINT AS n, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS category, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS last_part, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS bare, CASE WHEN tag = 'O' THEN 'other' ELSE substr(tag, 3) END AS label FROM golden GROUP BY tag"),
}
