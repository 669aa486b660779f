"""What the operators share: the shared folder, stored tables, words, and joins behind a size check."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Rows of a keyed table that may be broadcast; each row is a key and a few numbers, so this bounds megabytes.
BROADCAST_ROWS = 200_000
#: Copies of each row of a larger keyed table, over which the rows of a hot key are spread.
SALTS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine, and else an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="formlens-"))
        set_to = spark.sparkContext.getCheckpointDir()
    return set_to


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written to the shared folder and read again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Removes stored tables that only results which are stored themselves were made from."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be gone before the interpreter
        pass


def free(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores behind it as make it no column of the tables."""
    taken = {c.lower() for x in tables for c in x.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nested(docs: DataFrame, *needed: Column | str) -> DataFrame:
    """docs as one column, row, beside the needed ones, so that an operator's columns can't clash with others of the input; `row.*` has them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, keyed_rows: int, spread: Column) -> DataFrame:
    """Left join on a null-safe key of which one value may hold a large part of rows.

    keyed has one row a key. Up to BROADCAST_ROWS of them are broadcast; more are
    copied SALTS times, so that the rows of one key go to SALTS partitions, chosen
    by spread.
    """
    own, salt, by = (free(x, rows, keyed) for x in ("key_of_table", "salt_of_table", "salt_of_row"))
    renamed = keyed.withColumnRenamed(key, own)
    if keyed_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(renamed), rows[key].eqNullSafe(F.col(own)), "left").drop(own)
    salted = renamed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(by, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows[key].eqNullSafe(F.col(own)) & (F.col(by) == F.col(salt)), "left").drop(own, salt, by)
