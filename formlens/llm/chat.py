"""Chat formatting of maximal conversations, after snapshots of longer ones are collapsed.

Each turn gets a hash of all turns up to it, rolled over the conversation in order. A
conversation whose last hash is that of a turn inside another one is a snapshot of it and
goes, by an anti-join; of equal conversations the smallest id stays. What is left is
rendered turn by turn.

Defined cases: turns are ordered by turn, null first, then role and text, so that repeated
turns have an order; null roles and texts are told apart from empty ones in the hashes and
rendered as empty; turns without conv_id are one conversation; an empty table gives no
rows; other columns are left out. Prefixes are compared by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import stored

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, h1, h2): h1 and h2 stand for all turns up to the place."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    rolled = [F.bit_xor(F.xxhash64(F.lit(seed), *parts)).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    return placed.select("conv_id", "place", "turn", "role", "text", *rolled)


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues, one of each group of equal ones."""
    whole = rolled.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("x")).select("conv_id", "x.*")
    once = whole.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    last = whole.select("conv_id", F.col("place").alias("last"))
    inside = rolled.join(last, rolled["conv_id"].eqNullSafe(last["conv_id"])).filter(F.col("place") < F.col("last")).select("place", "h1", "h2").distinct()
    return once.join(inside, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation."""
    rolled = stored(prefixes(turns), "chat-prefixes")
    kept = maximal(rolled).withColumnRenamed("conv_id", "__conv_id")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE + "\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    lines = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("__conv_id"))).select("conv_id", "n_turns", "n_copies", F.struct("place", line.alias("line")).alias("x"))
    grouped = lines.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select("conv_id", "n_turns", "n_copies", F.array_join("x.line", "").alias("rendered"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations
), lines AS (
  SELECT conv_id, place, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
         md5(concat(place, '/', role IS NULL, '/', text IS NULL, '/', length(coalesce(role, '')), '/', role, text)) AS own
  FROM placed
), rolled AS (
  SELECT conv_id, place, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, max(place) OVER (PARTITION BY conv_id) AS n FROM lines
), once AS (
  SELECT min(conv_id) AS conv_id, count(*)::BIGINT AS n_copies, prefix, any_value(n)::BIGINT AS n_turns FROM rolled WHERE place = n GROUP BY prefix
), kept AS (
  SELECT conv_id, n_turns, n_copies FROM once WHERE prefix NOT IN (SELECT prefix FROM rolled WHERE place < n)
)
SELECT l.conv_id, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies, string_agg(line, '' ORDER BY place) AS rendered
FROM lines l JOIN kept k ON l.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY l.conv_id
"""
