"""Queries that turn raw annotations into training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions import text as tx
from formlens.functions.geometry import PAGE_HEIGHT, PAGE_WIDTH, Box
from formlens.operators import annotate, checked, convert, curate, labels, subtokens, tokens
from formlens.plans.common import KEYS, annotated, docs, sql, table


def _raw_tag(tag: Column, i: Column) -> Column:
    """A tag as annotators write it: some classes are named apart, and some are signatures and dates."""
    r = (F.col("doc_id") * 31 + i * 17) % 97
    swapped = F.when(r == 5, "B-iban").when(r == 4, "B-credit_card_number").when(r == 10, "B-signature").when(r == 11, "I-dates")
    return F.coalesce(swapped, tag)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).withColumn("tag", _raw_tag(F.col("tag"), F.col("i"))).select(*KEYS, "i", "idx", "token", *Box._fields, "tag")


def curate_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.curated(curate.without_signatures(_raw(spark, sf_dir), *KEYS))
    return rows.groupBy(*KEYS, "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("places"))


def label_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.allowed(_raw(spark, sf_dir), ["full_name", "address", "phone_number"])
    return rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotated(spark, sf_dir).filter("tag <> 'O'").select("doc_id", tx.category(F.col("tag")).alias("category")).distinct()
    return curate.missing_classes(found, "doc_id")


def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.label_list(_raw(spark, sf_dir)).withColumn("pos", F.col("pos").cast("int"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.quality_report(_raw(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pages(docs(spark, sf_dir)).select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit("_"), "page", F.lit(".png")).alias("file_name"))


def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "val").otherwise("held")
    catalogue = docs(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("file_id"), split.alias("split"))
    return curate.routed(_files(spark, sf_dir), catalogue).select("file_name", "file_id", "split")


def split_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.split_by_layout(_files(spark, sf_dir)).select("file_name", "layout", "split")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to arrays and back to rows."""
    rows = annotated(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in Box._fields})
    back = tokens.exploded(tokens.collected(rows, *KEYS), *KEYS)
    return back.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("x1"), F.max_by("token", "idx").alias("last_token"), F.count_if(F.col("tag") != "O").alias("n_tagged"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).select(*KEYS, "idx", (F.length("token") % 5 + 1).alias("n"))
    return annotate.chunks(rows, KEYS, "n", 200).groupBy(*KEYS, "chunk").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("n").alias("n_tokens"))


def piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words packed into chunks by the number of pieces that they are cut into."""
    rows = subtokens.sizes(annotated(spark, sf_dir)).select(*KEYS, "idx", "n_pieces")
    return annotate.chunks(rows, KEYS, "n_pieces", 500).groupBy(*KEYS, "chunk").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("n_pieces").alias("n_pieces"))


def subtoken_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and their labels by page; a prediction has the word's label on the first piece and O on the others, of which those that are ignored count nowhere."""
    words = annotated(spark, sf_dir)
    rows = subtokens.encoded(words.withColumn("both", F.concat_ws(" ", "tag", "pred_tag")), KEYS, "both", tags=[f"{a} {b}" for a in tx.TAGS for b in tx.TAGS])
    held = F.col("label") != subtokens.IGNORE
    n = len(tx.TAGS)
    gold, pred = F.floor(F.col("label") / n), F.col("label") % n
    pairs = rows.select(*KEYS, "word_id", "n", F.when(held, gold).otherwise(subtokens.IGNORE).alias("label"), F.when(held, pred).otherwise(tx.TAGS.index("O")).alias("pred"))
    sums = [
        F.count_if(F.col("n") == 0).alias("n_words"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.count_if(F.col("label") == subtokens.IGNORE).alias("n_ignored"),
        F.coalesce(F.sum(F.when(F.col("label") != subtokens.IGNORE, F.col("label") * (F.col("word_id") + 1))), F.lit(0)).cast("long").alias("label_sum"),
        F.count_if((F.col("label") != subtokens.IGNORE) & (F.col("label") == F.col("pred"))).alias("n_hits"),
    ]
    return pairs.groupBy(*KEYS).agg(*sums)


def subtoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted labels of pieces back as tags of words: the first piece's counts."""
    rows = subtokens.encoded(annotated(spark, sf_dir), KEYS, "pred_tag")
    pred = F.when(F.col("label") == subtokens.IGNORE, F.lit(tx.TAGS.index("O"))).otherwise(F.col("label"))
    return subtokens.first_pieces(rows.withColumn("pred", pred)).select(*KEYS, "word_id", subtokens.label_name(F.col("pred")).alias("tag"))


def first_subtoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word is cut into pieces of three letters, of which the first one's prediction counts."""
    rows = annotated(spark, sf_dir).select(*KEYS, F.col("idx").alias("word_id"), "pred_tag", F.explode(F.sequence(F.lit(0), F.floor((F.length("token") - 1) / 3))).alias("k"))
    rows = rows.select(*KEYS, (F.col("word_id") * 1000 + F.col("k")).alias("idx"), "word_id", F.when(F.col("k") == 0, F.col("pred_tag")).otherwise("O").alias("pred"))
    return annotate.first_of_word(rows, *KEYS)


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many label files, a page each, break each rule; annotators' tags still hold signatures, and long pages end below 1000."""
    tag = lambda token, idx: _raw_tag(tokens.gold_tag(F.col("doc_id"), F.col("page") * tokens.PAGE_WORDS + idx), F.col("page") * tokens.PAGE_WORDS + idx)
    files = tokens.page_files(docs(spark, sf_dir)).select("*", tokens.boxed().alias("bboxes"), F.transform("tokens", tag).alias("ner_tags"))
    return checked.rule_counts(files, checked.file_rules())


def equal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents of each language as the rarest has."""
    return checked.equal_samples(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


def samples_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 documents of each source, or all where there are fewer."""
    return checked.exact_samples(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 40, "by-source")


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of all pages: the first words are a name, a company that overlaps it and another name; every other page has two images, of which the last is a signature."""
    files = tokens.page_files(docs(spark, sf_dir))
    pair = lambda a, b: F.concat_ws(" ", F.col("tokens")[a], F.col("tokens")[b])
    entity = lambda pos, kind, value: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("entity_type"), value.alias("value"))
    wanted = files.filter("size(tokens) > 2").select(*KEYS, F.explode(F.array(entity(0, "first_name", pair(0, 1)), entity(1, "company_name", pair(1, 2)), entity(2, "last_name", F.col("tokens")[2]))).alias("e")).select(*KEYS, "e.*")
    images = files.filter("page % 2 = 0").select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    images = images.select(*KEYS, "pos", (F.lit(10) + F.col("pos") * 690).alias("x0"), F.lit(1040).alias("y0"), (F.lit(100) + F.col("pos") * 690).alias("x1"), F.lit(1060).alias("y1"))
    return labels.label_files(files, wanted, images, (PAGE_WIDTH, PAGE_HEIGHT), *KEYS)


def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each page, as an entity, wherever they stand on it."""
    words = tokens.laid_out(docs(spark, sf_dir)).withColumns({"block": F.lit(0), "line": F.floor(F.col("idx") / tokens.COLUMNS).cast("int")})
    pair = words.filter("idx < 2").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("idx", "token"))).alias("x")).filter(F.size("x") == 2)
    entities = pair.select(*KEYS, F.lit("company_name").alias("entity_type"), F.array_join("x.token", " ").alias("value"))
    found = annotate.matched(words, entities, *KEYS)
    return annotate.entity_boxes(found, words, *KEYS).select(*KEYS, "value", *Box._fields)


def pii_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, phone and card numbers in whole texts."""
    forms = {"email_address": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "phone_number": r"\+1 \([0-9]{3}\) 555-[0-9]{4}", "credit_card_number": r"[0-9]{16}"}
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("v")) for k, p in forms.items()])).alias("x"))
    return rows.select("doc_id", "x.category", F.explode("x.v").alias("value")).groupBy("doc_id", "category", "value").agg(F.count(F.lit(1)).alias("n"))


def detector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (*tx.DETECTOR_TYPES, "DATE_TIME", "URL")])
    rows = tokens.laid_out(docs(spark, sf_dir)).select("doc_id", "i", F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), F.get(names, (F.length("token") % 8).cast("int")).alias("entity_type"))
    return convert.from_detector(rows, "doc_id", "i").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("x1"), F.sum("y1").alias("y1"))


def answer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each page written as a model's JSON answer, some of them cut off, and read back."""
    rows = annotated(spark, sf_dir)
    tagged = rows.filter("tag <> 'O'").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("id"), F.col("token").alias("word"), F.replace(tx.category(F.col("tag")), F.lit("_"), F.lit(" ")).alias("label")))).alias("entities"))
    whole = F.concat(F.lit("```json\n"), F.to_json(F.struct("entities")), F.lit("\n```"))
    answers = tagged.select(*KEYS, F.when(F.col("doc_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("answer"))
    return convert.from_answers(answers, rows.select(*KEYS, "idx", "token", *Box._fields), *KEYS)


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a tree of relative boxes, and back to words in pixels."""
    rows = tokens.laid_out(docs(spark, sf_dir)).withColumn("line", F.floor(F.col("idx") / tokens.COLUMNS).cast("int"))
    point = lambda x, y: F.array(F.col(x) / F.lit(770.0), F.col(y) / F.lit(1048.0))
    word = F.struct("idx", F.col("token").alias("value"), F.array(point("x0", "y0"), point("x1", "y1")).alias("geometry"))
    lines = rows.groupBy(*KEYS, "line").agg(F.sort_array(F.collect_list(word)).alias("w"))
    line = F.struct("line", F.transform("w", lambda x: F.struct(x["value"].alias("value"), x["geometry"].alias("geometry"))).alias("words"))
    trees = lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    block = F.array(F.struct(F.transform("lines", lambda x: F.struct(x["words"].alias("words"))).alias("lines")))
    found = convert.from_ocr(trees.select(*KEYS, F.lit(770).alias("width"), F.lit(1048).alias("height"), F.array(F.struct(block.alias("blocks"))).alias("pages")), *KEYS)
    return found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("x0").alias("x0"), F.sum("y1").alias("y1"), F.max("lines_at").alias("lines"))


def yolo_to_voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).filter("tag <> 'O'")
    b, w, h = Box.of(), F.lit(770.0), F.lit(1048.0)
    line = F.concat_ws(" ", F.col("i") % 17, (b.x0 + b.x1) / 2.0 / w, (b.y0 + b.y1) / 2.0 / h, (b.x1 - b.x0) / w, (b.y1 - b.y0) / h)
    parsed = convert.detection_lines(rows.select(F.concat_ws("/", "doc_id", "i").alias("file_name"), line.alias("value")))
    boxes = convert.from_centres(parsed.toDF("file_name", "cls", "cx", "cy", "w", "h"), rows.select(F.concat_ws("/", "doc_id", "i").alias("file_name"), F.lit(770).alias("width"), F.lit(1048).alias("height")), "file_name")
    return boxes.select("file_name", "class_name", *[F.round(c, 4).alias(n) for n, c in zip(Box._fields, Box.of(), strict=True)])


def labelstudio_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).filter("tag <> 'O'")
    percent = {"x": F.col("x0") / 770.0 * 100, "y": F.col("y0") / 1048.0 * 100, "width": (F.col("x1") - F.col("x0")) / 770.0 * 100, "height": (F.col("y1") - F.col("y0")) / 1048.0 * 100}
    item = F.struct("idx", F.array("tag").alias("rectanglelabels"), *[c.alias(n) for n, c in percent.items()], F.lit(770).alias("original_width"), F.lit(1048).alias("original_height"), F.lit(0.0).alias("rotation"))
    tasks = rows.groupBy(F.concat_ws("/", "doc_id", "page").alias("image")).agg(F.sort_array(F.collect_list(item)).alias("label"))
    found = convert.from_label_tool(tasks.select("image", F.transform("label", lambda x: x.dropFields("idx")).alias("label")))
    return found.select("image", F.col("idx").cast("int").alias("idx"), "label", *[F.round(c, 4).alias(n) for n, c in zip(Box._fields, Box.of(), strict=True)])


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotated(spark, sf_dir).filter("tag <> 'O'").withColumn("cls", F.length("tag"))
    return convert.to_lines(rows, *KEYS)


def labelled_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def labelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        curate_tags, label_allowlist, missing_classes, label_list, quality_report, split_route, split_by_layout, token_arrays, token_chunks, piece_chunks, subtoken_labels, subtoken_words, label_files, file_rules, equal_samples, samples_by_source, first_subtoken, entity_match, pii_regex,
        detector_map, answer_join, ocr_words, yolo_to_voc, labelstudio_abs, text_labels, labelled_semi, labelled_anti, dedup_text,
    )
}

_RAW = """, raw AS (SELECT * EXCLUDE (tag), CASE r WHEN 5 THEN 'B-iban' WHEN 4 THEN 'B-credit_card_number' WHEN 10 THEN 'B-signature' WHEN 11 THEN 'I-dates' ELSE tag END AS tag FROM golden)"""
_U = lambda seed, key: f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_FILES = ", files AS (SELECT doc_id, page, 'doc-' || doc_id || '_' || page || '.png' AS file_name, 'doc-' || doc_id AS layout FROM pages)"
_NAMES = ", ".join(f"'{x}'" for x in tx.PII_CLASSES)
_TAGS = ", ".join(f"'{x}'" for x in tx.TAGS)

ORACLES = {
    "curate_tags": sql(
        _RAW + ", kept AS (SELECT doc_id, page, tag, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) - 1 AS idx FROM raw WHERE tag <> 'B-signature'),"
        " merged AS (SELECT doc_id, page, idx, CASE WHEN tag IN ('B-dates', 'I-dates') THEN 'O' WHEN tag IN ('B-iban', 'B-credit_card_number') THEN 'B-payment_information' ELSE tag END AS tag FROM kept)"
        " SELECT doc_id, page, tag, count(*)::BIGINT AS n, sum(idx)::BIGINT AS places FROM merged GROUP BY doc_id, page, tag"
    ),
    "label_allowlist": sql(
        _RAW + ", kept AS (SELECT doc_id, CASE WHEN substr(tag, 3) IN ('full_name', 'address', 'phone_number') THEN tag ELSE 'O' END AS tag FROM raw) SELECT doc_id, tag, count(*)::BIGINT AS n FROM kept GROUP BY doc_id, tag"
    ),
    "missing_classes": sql(
        f", found AS (SELECT DISTINCT doc_id, substr(tag, 3) AS category FROM golden WHERE tag <> 'O') SELECT doc_id, category FROM (SELECT DISTINCT doc_id FROM found), (SELECT unnest([{_NAMES}]) AS category) EXCEPT SELECT doc_id, category FROM found"
    ),
    "label_list": sql(_RAW + " SELECT tag, (row_number() OVER (ORDER BY tag) - 1)::INT AS pos FROM (SELECT DISTINCT tag FROM raw)"),
    "quality_report": sql(
        _RAW
        + f""", sums AS (SELECT count(*)::BIGINT AS "rows", count(*) FILTER (tag NOT IN ({_TAGS}))::BIGINT AS tag_unknown, count(*) FILTER (tag = 'B-signature')::BIGINT AS signature, count(*) FILTER (tag LIKE '%middle_name')::BIGINT AS middle_name,
  count(*) FILTER (x1 > 1000 OR y1 > 1000)::BIGINT AS box_out_of_range, count(*) FILTER (trim(token) = '')::BIGINT AS token_empty FROM raw)
SELECT rule, n, "rows" FROM sums UNPIVOT (n FOR rule IN (tag_unknown, signature, middle_name, box_out_of_range, token_empty))"""
    ),
    "split_route": sql(_FILES + " SELECT file_name, layout AS file_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM files"),
    "split_by_layout": sql(
        _FILES + f", drawn AS (SELECT *, {_U('split', 'layout')} AS u, {_U('split-val', 'layout')} AS v, row_number() OVER (PARTITION BY layout ORDER BY {_U('split-file', 'file_name')}, file_name) AS n FROM files),"
        " named AS (SELECT file_name, layout, n, CASE WHEN u < 0.8 THEN 'train' WHEN v < 0.5 THEN 'val' ELSE 'test' END AS split FROM drawn) SELECT file_name, layout, split FROM named WHERE split = 'train' OR n = 1"
    ),
    "token_arrays": sql(" SELECT doc_id, page, count(*)::BIGINT AS n, sum(x1)::DOUBLE AS x1, arg_max(token, idx) AS last_token, count(*) FILTER (tag <> 'O')::BIGINT AS n_tagged FROM annotated GROUP BY doc_id, page"),
    "token_chunks": f"WITH RECURSIVE {sql('')[5:]}"
    + """, sized AS (SELECT doc_id, page, idx, (length(token) % 5 + 1)::BIGINT AS n FROM tokens),
packed AS (
  SELECT doc_id, page, idx, n, 0 AS chunk, n AS used FROM sized WHERE idx = 0
  UNION ALL
  SELECT s.doc_id, s.page, s.idx, s.n, CASE WHEN p.used + s.n > 200 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + s.n > 200 THEN s.n ELSE p.used + s.n END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.page = p.page AND s.idx = p.idx + 1
)
SELECT doc_id, page, chunk, min(idx) AS "first", max(idx) AS "last", sum(n)::BIGINT AS n_tokens FROM packed GROUP BY doc_id, page, chunk""",
    "piece_chunks": f"WITH RECURSIVE {sql('')[5:]}"
    + f""", sized AS (SELECT doc_id, page, idx, len(regexp_extract_all(token, '{subtokens.pattern()}')) AS n FROM tokens),
packed AS (
  SELECT doc_id, page, idx, n, CASE WHEN n > 500 THEN 1 ELSE 0 END AS chunk, n AS used FROM sized WHERE idx = 0
  UNION ALL
  SELECT s.doc_id, s.page, s.idx, s.n, CASE WHEN p.used + s.n > 500 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + s.n > 500 THEN s.n ELSE p.used + s.n END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.page = p.page AND s.idx = p.idx + 1
)
SELECT doc_id, page, chunk, min(idx) AS "first", max(idx) AS "last", sum(n)::BIGINT AS n_pieces FROM packed GROUP BY doc_id, page, chunk""",
    "subtoken_labels": sql(
        f", cut AS (SELECT doc_id, page, idx, list_position({tx.TAGS}, tag) - 1 AS label, tag = pred_tag AS hit, len(regexp_extract_all(token, '{subtokens.pattern()}')) AS n FROM annotated)"
        " SELECT doc_id, page, count(*) AS n_words, sum(n)::BIGINT AS n_pieces, sum(n - 1)::BIGINT AS n_ignored, sum(label * (idx + 1))::BIGINT AS label_sum, count(*) FILTER (hit) AS n_hits FROM cut GROUP BY doc_id, page"
    ),
    "subtoken_words": sql(" SELECT doc_id, page, idx AS word_id, pred_tag AS tag FROM annotated"),
    "first_subtoken": sql(" SELECT doc_id, page, idx AS word_id, pred_tag AS pred FROM annotated"),
    "file_rules": sql(
        ", raw AS (SELECT doc_id, page, x0, y0, x1, y1, CASE r WHEN 5 THEN 'B-iban' WHEN 4 THEN 'B-credit_card_number' WHEN 10 THEN 'B-signature' WHEN 11 THEN 'I-dates' ELSE tag END AS t FROM annotated),"
        " files AS (SELECT doc_id, page, bool_or(t = 'B-signature') AS signed, bool_or(t LIKE '%-middle_name') AS named, max(greatest(x1, y1)) > 1000 OR min(least(x0, y0)) < 0 AS outside FROM raw GROUP BY doc_id, page)"
        " SELECT unnest(['equal_lengths', 'no_signature', 'no_middle_name', 'boxes_inside']) AS rule, count(*) AS n_files, unnest([0, count(*) FILTER (signed), count(*) FILTER (named), count(*) FILTER (outside)])::BIGINT AS n_failed FROM files"
    ),
    "equal_samples": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(md5('sample:' || doc_id), 1, 8), doc_id) AS place FROM documents) WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))",
    "samples_by_source": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(md5('by-source:' || doc_id), 1, 8), doc_id) AS place FROM documents) WHERE place <= 40",
    "label_files": sql(
        ", lined AS (SELECT doc_id, page, idx, token, lower(token) AS t, lead(lower(token)) OVER (PARTITION BY doc_id, page ORDER BY idx) AS t2, x0, y0, x1, y1 FROM tokens),"
        " heads AS (SELECT a.doc_id, a.page, a.t AS w0, b.t AS w1, c.t AS w2 FROM lined a JOIN lined b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx = 0 AND b.idx = 1 JOIN lined c ON a.doc_id = c.doc_id AND a.page = c.page AND c.idx = 2),"
        " hits AS (SELECT l.doc_id, l.page, l.idx AS first, unnest([0, 1, 2]) AS pos, unnest([t = w0 AND t2 = w1, t = w1 AND t2 = w2, t = w2]) AS hit FROM lined l JOIN heads h ON l.doc_id = h.doc_id AND l.page = h.page),"
        " covered AS (SELECT doc_id, page, pos, first, first + unnest(CASE WHEN pos = 2 THEN [0] ELSE [0, 1] END) AS idx FROM hits WHERE hit),"
        " picked AS (SELECT doc_id, page, idx, max(pos * 1000 + first) FILTER (pos = 1) % 1000 AS company, min(pos * 1000 + first) FILTER (pos <> 1) % 1000 AS named FROM covered GROUP BY doc_id, page, idx)"
        " SELECT l.doc_id, l.page, l.idx, token, x0, y0, x1, y1, CASE WHEN company = l.idx THEN 'B-company_name' WHEN company IS NOT NULL THEN 'I-company_name' WHEN named = l.idx THEN 'B-full_name' WHEN named IS NOT NULL THEN 'I-full_name' ELSE 'O' END AS tag"
        " FROM lined l LEFT JOIN picked p ON l.doc_id = p.doc_id AND l.page = p.page AND l.idx = p.idx"
        " UNION ALL SELECT doc_id, page, (max(idx) + 1)::INT, '[SIGNATURE]', 700, 1040, 769, 1047, 'B-signature' FROM tokens WHERE page % 2 = 0 GROUP BY doc_id, page"
    ),
    "entity_match": sql(
        ", lined AS (SELECT doc_id, page, idx, lower(token) AS t, token, lead(lower(token)) OVER (PARTITION BY doc_id, page ORDER BY idx) AS t2, x0, y0, x1, y1, idx // 8 AS line FROM tokens),"
        " wanted AS (SELECT a.doc_id, a.page, a.t, b.t AS t2, a.token || ' ' || b.token AS value FROM lined a JOIN lined b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx = 0 AND b.idx = 1),"
        " hits AS (SELECT l.doc_id, l.page, l.idx, value FROM lined l JOIN wanted w ON l.doc_id = w.doc_id AND l.page = w.page AND l.t = w.t AND l.t2 = w.t2)"
        " SELECT DISTINCT doc_id, page, value, x0, y0, x1, y1 FROM (SELECT h.doc_id, h.page, value, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1"
        " FROM hits h JOIN lined l ON h.doc_id = l.doc_id AND h.page = l.page AND l.idx BETWEEN h.idx AND h.idx + 1 GROUP BY h.doc_id, h.page, value, h.idx, line)"
    ),
    "pii_regex": r"""WITH found AS (SELECT doc_id, 'email_address' AS category, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+')) AS value FROM documents
UNION ALL SELECT doc_id, 'phone_number', unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) 555-[0-9]{4}')) FROM documents UNION ALL SELECT doc_id, 'credit_card_number', unnest(regexp_extract_all(text, '[0-9]{16}')) FROM documents)
SELECT doc_id, category, value, count(*)::BIGINT AS n FROM found GROUP BY doc_id, category, value""",
    "detector_map": sql(
        ", named AS (SELECT doc_id, x1, y1, ['full_name', 'address', 'email_address', 'payment_information', 'payment_information', 'phone_number'][length(token) % 8 + 1] AS name FROM tokens WHERE length(token) % 8 < 6)"
        " SELECT doc_id, 'B-' || name AS tag, count(*)::BIGINT AS n, sum(x1)::BIGINT AS x1, sum(y1)::BIGINT AS y1 FROM named GROUP BY doc_id, name"
    ),
    "answer_join": sql(" SELECT doc_id, page, idx, token, x0, y0, x1, y1, 'B-' || substr(tag, 3) AS tag FROM golden WHERE tag <> 'O' AND doc_id % 7 <> 0"),
    "ocr_words": sql(
        ", kept AS (SELECT *, idx // 8 AS line FROM tokens WHERE trim(token) <> '' AND regexp_full_match(token, '[\\x00-\\x7F]*') AND length(token) < 50)"
        " SELECT doc_id, page, count(*)::BIGINT AS n, sum(trunc(x0 / 770.0::DOUBLE * 770)::INT)::BIGINT AS x0, sum(trunc(y1 / 1048.0::DOUBLE * 1048)::INT)::BIGINT AS y1, max(line)::INT AS lines FROM kept GROUP BY doc_id, page"
    ),
    "yolo_to_voc": sql(
        ", named AS (SELECT *, i % 17 AS cls FROM golden WHERE tag <> 'O') SELECT doc_id || '/' || i AS file_name, coalesce(["
        + ", ".join(f"'{name}'" for name in [*list(tx.PII_CLASSES)[:13]]) + ", NULL, 'invoice_id', 'payment_information', NULL][cls + 1], cls::VARCHAR) AS class_name,"
        " round(x0::DOUBLE, 4) AS x0, round(y0::DOUBLE, 4) AS y0, round(x1::DOUBLE, 4) AS x1, round(y1::DOUBLE, 4) AS y1 FROM named"
    ),
    "labelstudio_abs": sql(
        " SELECT doc_id || '/' || page AS image, (row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) - 1)::INT AS idx, tag AS label, round(x0::DOUBLE, 4) AS x0, round(y0::DOUBLE, 4) AS y0, round(x1::DOUBLE, 4) AS x1, round(y1::DOUBLE, 4) AS y1 FROM golden WHERE tag <> 'O'"
    ),
    "text_labels": sql(" SELECT doc_id, page, string_agg(concat_ws(' ', length(tag), x0, y0, x1, y1), chr(10) ORDER BY idx) AS value FROM golden WHERE tag <> 'O' GROUP BY doc_id, page"),
    "labelled_semi": "SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang",
    "labelled_anti": "SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "dedup_text": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY text",
}
