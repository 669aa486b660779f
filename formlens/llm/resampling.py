"""Importance resampling: draws the documents whose word n-grams look like those of a target.

Words are laid out in a position table. For orders over one the words that follow come from
a window over each document, and each run of words is hashed into a bucket. Counts of the
buckets over all documents and over all target texts give each bucket a gain; a document's
weight is the mean gain of its features, and a hash of its id adds the noise that turns the
highest scores into a draw without replacement.

Only sums by bucket and by document are shuffled, added up before the shuffle; the gains are
a table of as many rows as there are buckets. Ranks come from ranges of scores, so no task
holds all documents; the scores that can be drawn are found from the number of documents at
each whole score, of which there can be SCORES at most.

Defined cases: null and wordless text has no features and weight 0; rows that are equal in
doc_id and text are worked on together and have ranks of their own; a row without doc_id
draws by its text, and stands behind those with one where scores tie; an empty table gives
no rows; an empty target has no counts; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlens.llm.common import BROADCAST_ROWS, documents, stored

#: A word of a text in which A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = (1,)
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Whole scores that can differ: a thousand times logarithms of 64-bit numbers.
SCORES = 200_000


def digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def positions(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, digest, pos, times, words): the words from each position on, longest of them or as many as are left; one row without pos and words for a text without words.

    times is how often the row counts. Where words that follow are needed, equal rows are
    put together before the shuffle that the window over a document needs anyway.
    """
    rows = docs.select("doc_id", digest().alias("digest"), "text", F.lit(1).alias("times"))
    if longest > 1:
        rows = rows.groupBy("doc_id", "digest").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("times"))
    listed = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    found = rows.select("doc_id", "digest", "times", F.posexplode_outer(listed).alias("pos", "word"))
    of_text = Window.partitionBy("doc_id", "digest").orderBy("pos")
    ahead = [F.lead("word", j).over(of_text) for j in range(1, longest)]
    return found.select("doc_id", "digest", "pos", "times", F.array("word", *ahead).alias("words"))


def features(docs: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, digest, times, bucket, starts, heads): a row a feature; starts and heads count the positions, and the texts, that a row is the first of."""
    found = positions(docs, max(orders))
    if tuple(orders) == (1,):
        found = found.withColumns({"feature": F.col("words")[0], "nth": F.lit(0)})
    else:
        whole = [F.when(F.get("words", F.lit(n - 1)).isNotNull(), F.array_join(F.slice("words", 1, n), " ")) for n in sorted(set(orders))]
        found = found.select("doc_id", "digest", "pos", "times", "words", F.posexplode_outer(F.array_compact(F.array(*whole))).alias("nth", "feature"))
    first = F.coalesce("nth", F.lit(0)) == 0
    return found.select(
        "doc_id",
        "digest",
        "times",
        F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"),
        F.when(first & F.col("pos").isNotNull(), F.col("times")).otherwise(0).alias("starts"),
        F.when(first & (F.coalesce("pos", F.lit(0)) == 0), F.col("times")).otherwise(0).alias("heads"),
    )


def bucket_counts(docs: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that hold a feature of some text."""
    return features(docs, orders, buckets).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("times").cast("long").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets of source: 1000 times the logarithm of how much likelier the target holds a feature of the bucket, floored."""
    of_source, of_target = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (source, target))
    more = lambda x: F.coalesce(x, F.lit(0)).cast("double")
    ratio = ((more(F.col("t")) + 1) * F.lit(float(of_source + buckets))) / ((more(F.col("n")) + 1) * F.lit(float(of_target + buckets)))
    return source.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(seed: str = SEED) -> Column:
    """The Gumbel noise of a row, a thousandfold and floored."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.lower(F.hex("digest"))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, digest, copies, n_words, n_features, weight, score): a row for all rows that are equal in doc_id and text. Stored."""
    counts = lambda x: stored(bucket_counts(x, orders, buckets), "resample-counts")
    by_bucket = gains(counts(docs), counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), buckets)
    by_bucket = F.broadcast(by_bucket) if buckets <= BROADCAST_ROWS else by_bucket
    held = features(docs, orders, buckets).join(by_bucket, "bucket", "left")
    times = F.col("times").cast("long")
    sums = held.groupBy("doc_id", "digest").agg(
        F.sum("heads").cast("long").alias("copies"),
        F.sum("starts").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), times)), F.lit(0)).cast("long").alias("n_features"),
        F.coalesce(F.sum(F.col("gain") * times), F.lit(0)).cast("long").alias("total"),
    )
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.try_divide(F.col("total") - F.pmod("total", "n_features"), F.col("n_features"))).cast("long")
    found = sums.select("doc_id", "digest", "copies", *[F.expr(f"{x} div copies").alias(x) for x in ("n_words", "n_features")], mean.alias("weight"))
    return stored(found.withColumn("score", F.col("weight") + noise(seed)), "resample-scores")


def ranked(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scores (of scored()) with a row for each row of the input, and rank: 1 for the highest score of texts of min_words words, as far as percent of these go; null beyond."""
    eligible = F.col("n_words") >= min_words
    at = sorted(((x.score, x.n) for x in scores.filter(eligible).groupBy("score").agg(F.sum("copies").alias("n")).collect()), reverse=True)  # SCORES rows at most
    wanted = percent * sum(n for _, n in at) // 100
    least, held = None, 0
    for least, n in at:
        held += n
        if held >= wanted:
            break
    each = scores.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    if not wanted:
        return each.withColumn("rank", F.lit(None).cast("long")).drop("copy")
    may = eligible & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    ranges = stored(each.filter(may).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "resample-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("shift")
    drawn = ranges.join(F.broadcast(shift), "range").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    rest = each.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return drawn.drop("range", "shift", "copy").unionByName(rest.drop("copy"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The rows of docs, with all their columns, that are drawn for the target; rows that are equal in doc_id and text are drawn together."""
    found = ranked(scored(docs, target, orders, buckets, seed), percent, min_words).filter("rank IS NOT NULL").select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_text")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["of_id"]) & (F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))) == found["of_text"]), "left_semi")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by their likeness to benchmark, and the ranks of those drawn."""
    scores = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ranked(scores).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 in SQL: a table of 256 remainders, and a fold over the bytes of a text.
CRC_TABLE = """remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_LISTED = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
OP11_SQL = rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, md5(coalesce(text, '')) AS digest, coalesce({_LISTED}, []) AS ws FROM documents
), listed AS (
  SELECT row_id, unnest(ws) AS w FROM texts
), asked AS (
  SELECT unnest({_LISTED}) AS w FROM benchmark
), named AS (
  SELECT w, {crc_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM listed UNION SELECT w FROM asked), remainders
), source AS (
  SELECT bucket, count(*) AS s FROM listed JOIN named USING (w) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM asked JOIN named USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + {BUCKETS})::DOUBLE)
                                 / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket)
), sums AS (
  SELECT row_id, count(*) AS n, sum(gain)::BIGINT AS total FROM listed JOIN named USING (w) JOIN gains USING (bucket) GROUP BY row_id
), scored AS (
  SELECT doc_id, digest, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || digest)), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN sums USING (row_id)
), drawn AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, n_features >= {MIN_WORDS} AS may, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, digest) AS place FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= (SELECT {PERCENT} * count(*) // 100 FROM placed WHERE may) THEN place END AS rank FROM placed
"""
