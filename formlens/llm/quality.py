"""Quality rules with host-level verdicts, with DataFrame functions only.

Each document gets counts from its whole text. Rule failures are summed by host (the
source of a document), each host's failure rates are shrunk towards a beta prior that
is fitted to all hosts, and the verdicts on hosts go back to their documents.

Defined cases: null, empty and wordless text has no words and fails the base rule; a
document without a source belongs to no host and is judged by the base rule alone;
repeated rows count each; an empty table gives no rows; columns named as the added ones
are replaced. Windows of words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.common import SPACES, documents, free, join_keyed, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: A host is rejected if its shrunk failure rate of a rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rule failures of a document, from its counts; the first two are the base rule.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "3 * n_dup_lines > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that are found twice or more."""
    n = WINDOW

    def windows(h: Column) -> Column:
        last = F.size(h) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        widths = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(n), F.get(at, i + 1) - p), F.lit(n)))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda s, x: s + x)

    def doubled(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        twice = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def counted(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(pairs, doubled))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted))


def counts(docs: DataFrame) -> DataFrame:
    """docs with the counts of FEATURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    w = free("of_words", docs)
    return (
        docs.drop(*FEATURES)
        .withColumn(w, of_words)
        .withColumns(
            {
                "n_words": F.col(f"{w}.n"),
                "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
                "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": dup_lines.cast("long"),
                "n_repeat_words": F.col(f"{w}.r"),
            }
        )
        .drop(w)
    )


def base_failed() -> Column:
    return F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")


def host_verdicts(counted: DataFrame, host: str = "source") -> tuple[DataFrame, int]:
    """(host, shrunk rate of each rule, host_rejected) and the number of hosts."""
    failures = counted.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(k) for k, rule in RULES.items()])
    failures = stored(failures, "quality-hosts")
    mean = {k: F.sum(k) / F.sum("n") for k in RULES}
    row = failures.agg(F.count(F.lit(1)).alias("hosts"), F.avg(1 / F.col("n")).alias("per"), *[x.alias(k) for k, x in mean.items()]).first()
    spread = failures.agg(*[F.avg(F.pow(F.col(k) / F.col("n") - F.lit(row[k] or 0.0), 2)).alias(k) for k in RULES]).first()
    rates = {}
    for k in RULES:
        m, v = row[k] or 0.0, spread[k] or 0.0
        between = v - m * (1 - m) * (row["per"] or 0.0)  # what differing hosts add to the spread of sampling
        strength = min(max(m * (1 - m) / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]
        rates[k] = (F.col(k) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    shrunk = failures.select(host, *[x.alias(f"rate_{k}") for k, x in rates.items()])
    return shrunk.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{k}") for k in RULES]) > HOST_LIMIT), row["hosts"]


def judged(counted: DataFrame, host: str = "source") -> DataFrame:
    """The rows of counts() with base_failed, host_rejected and kept."""
    verdicts, hosts = host_verdicts(counted, host)
    clean = counted.drop("base_failed", "host_rejected", "kept", *[f"rate_{k}" for k in RULES])
    found = join_keyed(clean, verdicts, host, hosts, F.col("doc_id"))
    found = found.withColumn("base_failed", base_failed()).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    counted = counts(documents(spark, sf_dir)).select("doc_id", "source", *FEATURES)
    return judged(stored(counted, "quality-counts")).select("doc_id", *FEATURES, "base_failed", "kept")


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM base
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM worded WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN repeats r ON w.doc_id = r.doc_id
), failed AS (
  SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > word_chars AS r3, 3 * n_dup_lines > n_words AS r4,
         n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS r5
  FROM counted
), rules AS (
  SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5]) AS bad FROM failed WHERE source IS NOT NULL
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END)::DOUBLE AS f FROM rules GROUP BY source, rule
), means AS (
  SELECT rule, sum(f) / sum(n) AS m, avg(1 / n) AS per FROM hosts GROUP BY rule
), priors AS (
  SELECT h.rule, any_value(m) AS m, avg((f / n - m) * (f / n - m)) - any_value(m * (1 - m) * per) AS v
  FROM hosts h JOIN means s ON h.rule = s.rule GROUP BY h.rule
), shrunk AS (
  SELECT source, (f + m * s) / (n + s) AS rate
  FROM hosts h JOIN (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) ELSE 10000.0 END AS s FROM priors) p ON h.rule = p.rule
), rejected AS (
  SELECT source, max(rate) > 0.5 AS bad FROM shrunk GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2) AND NOT coalesce(bad, false) AS kept
FROM failed f LEFT JOIN rejected j ON f.source = j.source
"""
