"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source, targets are filled up by weight below a cap, and each
document is emitted floor(rate) times plus once more with the probability of the rest. The
level to which targets are filled comes from running sums over the sources in the order in
which they become full, so it takes one pass over them, however many there are.

Defined cases: null or wordless text has size 0 and is taken 0 words; a null source is
a source of its own, last in order; an empty table gives an empty result; rows with the
same doc_id draw the same number, as in the SQL, so that a source made of few ids may miss
its target; rows without doc_id draw by their text; columns of the input keep their values and a clash
with an added name is resolved in favour of the added one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import documents, free, join_keyed, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def with_sums_ahead(sources: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """sources with the sum of each of sums over all rows that stand before in order.

    Ranges of rows are summed apart and shifted by the sums of the ranges before, so no
    task needs all of them.
    """
    ranges = stored(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    by_range = ranges.groupBy("range").agg(*[F.sum(x).alias(f"all_{k}") for k, x in sums.items()])
    shift = by_range.select("range", *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sums])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {k: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"before_{k}") for k, x in sums.items()}
    return ranges.join(F.broadcast(shift), "range").withColumns(added).select(*sources.columns, *sums)


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    A source gets its weight's part of share * all sizes, most * its own size at most;
    what is above that is shared among the others by weight until none is above. With the
    sources in the order in which they become full, the level is the largest of what is
    left for a source and those behind it, a unit of their weight.
    """
    by_name = F.col("source").asc_nulls_last()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = with_sums_ahead(totals, [by_name], {"rank": F.lit(1)}).select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    filled = stored(with_sums_ahead(ranked, [F.col("cap") / F.col("weight"), by_name], {"used": F.col("cap"), "behind": F.col("weight")}), "mix-weights")
    n, total, weight_sum = filled.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left = (F.lit(share * total) - F.col("used")) / (F.lit(float(weight_sum)) - F.col("behind"))
    level = filled.agg(F.coalesce(F.max(left), F.lit(0.0))).first()[0]
    return filled.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target")), n


def draw_key() -> Column:
    """What a row's draw hashes: doc_id, or the digest of the text where there is none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def mix(docs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix holds the document).

    totals: (source, source_size) if they are known already; docs then has size and draw
    (of draw_key()) and needs no text.
    """
    drawn_by = "draw" if totals is not None else free("draw", docs)
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn(drawn_by, draw_key()) if totals is None else docs
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")) if totals is None else totals
    by_source, n = targets(totals)
    clean = sized.drop("source_size", "target", "rate", "copies")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col(drawn_by)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rated = join_keyed(clean, by_source, "source", n, F.col(drawn_by)).withColumn("rate", rate)
    return rated.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).drop(drawn_by)


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its copies say."""
    copy = free("copy", mixed)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop(copy)


def op1_mixing_sources_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    sized = stored(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_key().alias("draw")), "mix-sizes")
    mixed = mix(sized, sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals
), filling AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM filling)) AS target FROM weighted
), rated AS (
  SELECT s.doc_id, s.size, l.source_size, l.target, CASE WHEN l.source_size = 0 THEN 0.0::DOUBLE ELSE l.target / l.source_size::DOUBLE END AS rate
  FROM sized s JOIN leveled l ON s.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM rated
"""
