"""Spelling variants: words that differ by one code point, grouped under the commonest form.

Every word emits itself and its distinct single deletions as 64-bit keys, worked out for all
places of a word at once, so that a word of any length costs as many rows as it has code
points and not the square of that. Words that share a key are candidates, and a distance of
exactly one is confirmed on the words themselves. A form is a near word that is common
enough; roots are found by joining each word's root with the root of that, until none moves,
so the rounds grow with the logarithm of the longest chain.

Few words can share a key: those that differ from it by one inserted code point, so that no
key gathers more than its length times the alphabet, however often its words are found.
Counts are added up before the shuffle. Near words are pairs because they are the result:
n_near counts each of them.

Defined cases: null and wordless text has no words; repeated rows count each; a null doc_id
is hashed as an empty one; ties of a form go to the smaller word in code-point order; an
empty table gives no rows; other columns of the input play no part. A word of any length
fits as far as a row does; the memory of a task is a multiple of the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks
from formlens.llm.common import documents, release, stored
from formlens.llm.resampling import CRC_TABLE, LOWER, UPPER, crc_sql

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is found at least so many times as often as its variant.
RATIO = 5
#: One run of so many loses a code point.
SLIP = 199
CHUNK = 1 << 20
#: Keys that are handed on at once.
KEYS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def slipped(docs: DataFrame, min_length: int = MIN_LENGTH, slip: int = SLIP) -> DataFrame:
    """(word): the lower-cased runs of letters of all texts of min_length code points at least, of which those with a hash that slip divides have lost one code point."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= min_length)


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each key, and the keys: of every word itself and of its distinct single deletions."""
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in words.to_pylist()]
    sizes = np.array([len(x) for x in points], np.int64)
    flat = np.concatenate([np.empty(0, np.uint32), *points]).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(points)), sizes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(int(sizes.max(initial=0)) - 1, 0), _BASE, np.uint64)]), dtype=np.uint64)
    terms = flat * powers[np.arange(len(flat)) - starts[row]]
    upto = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    whole = upto[starts + sizes] - upto[starts]
    before = upto[:-1] - upto[starts[row]]
    without = before + (whole[row] - before - terms) * _BACK
    first = np.ones(len(flat), bool)  # one deletion of each run of equal code points
    first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    return np.concatenate([np.arange(len(points)), row[first]]), np.concatenate([whole, without[first]])


def keyed(words: DataFrame) -> DataFrame:
    """(key, id) of words (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word", CHUNK):
            row, keys = deletion_keys(batch.column("word"))
            for a in range(0, len(keys), KEYS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + KEYS].view(np.int64)), batch.column("id").take(pa.array(row[a : a + KEYS]))], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key bigint, id binary")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words (id, word, n) at a distance of exactly one, both ways."""
    keys = stored(keyed(words), "variant-keys")
    mates = keys.join(keys.select("key", F.col("id").alias("other")), "key").filter(F.col("id") < F.col("other")).select("id", "other").distinct()
    told = mates.join(words.select("id", F.col("word").alias("a"), F.col("n").alias("na")), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("b"), F.col("n").alias("nb")), "other")
    pairs = told.filter(F.levenshtein("a", "b", 1) == 1)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    return pairs.select(sides.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), each of which is commoner than its word: the last form that a word leads to."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        moved = stored(now.join(ahead, now["root"] == ahead["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "variant-roots")
        release(now)
        now = moved
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(found: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of found (word, a row an occurrence) that is there min_count times."""
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    words = stored(counted.select(F.unhex(F.md5(F.col("word").cast("binary"))).alias("id"), "word", "n"), "variant-words")
    nearest = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    joined = words.select("word", "n").join(nearest, "word", "left")
    has = -F.col("best.col1") >= F.col("n") * ratio
    told = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.col1")).alias("form_n")), "variant-forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(slipped(documents(spark, sf_dir)))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs, remainders
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, c.word FROM words w JOIN cut c ON w.word = c.rest
  UNION SELECT c.word, w.word FROM words w JOIN cut c ON w.word = c.rest
), ordered AS (
  SELECT p.word, p.near, x.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY x.n DESC, p.near) AS place
  FROM pairs p JOIN words x ON x.word = p.near
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ordered o ON o.word = w.word AND place = 1
), walk AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word) USING (word)
"""
