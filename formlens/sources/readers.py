"""Readers of label files, catalogues, pools and metrics; paths may be any that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions.text import stem
from formlens.sources import files

TOKEN_LABELS = "tokens array<string>, bboxes array<array<double>>, ner_tags array<string>"
CATALOGUE = (
    "file_name string, date string, document_meta_info struct<doc_format:string,document_type:string,font_family:string,layout:string,sections:array<string>,"
    "headers:array<string>,document_subject:string,signature:string>, bounding_boxes string, random_pii_values array<array<string>>, split string"
)
LABEL_TOOL = "image string, label array<struct<rectanglelabels:array<string>,x:double,y:double,width:double,height:double,original_width:int,original_height:int,rotation:double>>"
OCR_TREE = "pages array<struct<blocks:array<struct<lines:array<struct<words:array<struct<value:string,geometry:array<array<double>>>>>>>>>>"


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(stem(F.col("_metadata.file_name")).alias("doc_id"), *(columns or [c for c in df.columns if c != "_metadata"]))


def token_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tokens, bboxes, ner_tags), one JSON object a file."""
    return _named(spark.read.schema(TOKEN_LABELS).option("multiLine", True).option("pathGlobFilter", "*.json").json(path), "tokens", "bboxes", "ner_tags")


def entity_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, entity_type, value, box) from lists of [type, value, [four numbers]]."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    rows = text.select(stem(F.col("_metadata.file_name")).alias("doc_id"), F.posexplode(F.from_json("value", "array<array<string>>")).alias("idx", "x"))
    box = F.from_json(F.get("x", F.lit(2)), "array<double>")
    return rows.select("doc_id", "idx", F.get("x", F.lit(0)).alias("entity_type"), F.get("x", F.lit(1)).alias("value"), *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def detection_text(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value): the lines of detection files."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path).select(stem(F.col("_metadata.file_name")).alias("file_name"), "value")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Documents with file_id, the name without .pdf, and the date as a timestamp."""
    rows = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    return rows.withColumns({"file_id": F.replace("file_name", F.lit(".pdf"), F.lit("")), "date": F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss"))})


def names(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list of file names, blank ones left out."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("name"))


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, class, precision, recall): one CSV a run."""
    rows = spark.read.schema("class string, precision double, recall double").option("header", True).csv(path)
    return rows.select(F.col("_metadata.file_name").alias("run"), "class", "precision", "recall")


def value_pool(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of lists; none if there is no file."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "key string, value string")
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "values")).select("key", F.explode("values").alias("value"))


def privacy_masks(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) from Parquet rows with privacy_mask, a list of labels and values."""
    return spark.read.parquet(path).select(F.explode("privacy_mask").alias("x")).select(F.col("x.label").alias("key"), F.col("x.value").alias("value"))


def label_tool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_TOOL).option("multiLine", True).json(path)


def ocr_trees(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.schema(OCR_TREE).option("multiLine", True).json(path), "pages")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, width, height) of PNG and JPEG files, from the head of each; null sizes where a file is none or broken; files without bytes are not listed."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG}").load(path).select("path")  # without content no file is read
    sizes = paths.mapInArrow(files.picture_sizes, "path string, width int, height int")
    return sizes.select(stem(F.element_at(F.split("path", "/"), -1)).alias("doc_id"), "width", "height")


def encoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) with the bytes as base64."""
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("content"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def array_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values) of .npy files, read by ranges of rows."""
    files.register(spark)
    return spark.read.format("npy_rows").load(path)


def split_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset stored by split, which stays a partition column."""
    return spark.read.parquet(path)
