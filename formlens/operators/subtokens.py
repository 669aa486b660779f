"""Words cut into the pieces of a vocabulary, labels of pieces, and back to words."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.text import TAGS

#: The label of pieces that no loss and no metric counts.
IGNORE = -100
#: Pieces of more than one character, in place of a model's vocabulary; single characters are always pieces.
PIECES = [
    "tion", "sion", "ment", "ness", "able", "ible", "ing", "ung", "keit", "heit", "schaft", "lich", "isch", "ción", "dad", "mente", "ement", "eur", "ette", "age", "ance", "ence", "ous",
    "ive", "ful", "est", "ers", "ed", "er", "en", "es", "ly", "re", "un", "in", "de", "con", "pre", "pro", "per", "sub", "inter", "trans", "ver", "ge", "be", "auf", "aus", "an", "le", "la",
    "el", "the", "and", "der", "die", "und", "que", "st", "th", "ch", "sch", "qu", "ou", "ei", "ie", "io", "ra", "ro", "ri", "ta", "te", "ti", "to", "na", "ne", "ni", "no", "ma", "me", "mi", "mo",
]


def pattern(vocabulary: Sequence[str] = PIECES) -> str:
    """An expression that matches the longest piece at each place, or else one character; meant for some hundred pieces, as each is tried in turn."""
    longest_first = sorted(set(vocabulary), key=lambda x: (-len(x), x))
    return "(?s)(?:" + "|".join([*map(re.escape, longest_first), "."]) + ")"


def pieces(word: Column, vocabulary: Sequence[str] = PIECES) -> Column:
    """The pieces of a word from left to right, each the longest that fits; null has none."""
    return F.coalesce(F.regexp_extract_all(word, F.lit(pattern(vocabulary)), F.lit(0)), F.array().cast("array<string>"))


def label_id(tag: Column, tags: Sequence[str] = TAGS) -> Column:
    """The place of a tag in tags; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in tags]), tag), F.lit(0)).cast("int") - 1


def label_name(label: Column, tags: Sequence[str] = TAGS) -> Column:
    """The tag of a label; null for IGNORE and other numbers that are no place in tags."""
    return F.when(label >= 0, F.get(F.array(*[F.lit(x) for x in tags]), label.cast("int")))


def encoded(words: DataFrame, keys: Sequence[str], tag: str = "tag", vocabulary: Sequence[str] = PIECES, tags: Sequence[str] = TAGS) -> DataFrame:
    """(keys, word_id, n, idx, piece, label): a row a piece of each word (idx, token, tag).

    The first piece has the label of its word's tag and the others IGNORE, as has a word
    whose tag is none of tags. n is the piece's number in its word; idx orders the pieces of
    keys. A word without characters has no piece and so no row.
    """
    cut = words.select(*keys, F.col("idx").alias("word_id"), F.posexplode(pieces(F.col("token"), vocabulary)).alias("n", "piece"), label_id(F.col(tag), tags).alias("id"))
    label = F.when(F.col("n") == 0, F.coalesce("id", F.lit(IGNORE))).otherwise(IGNORE)
    return cut.select(*keys, "word_id", "n", F.struct("word_id", "n").alias("idx"), "piece", label.alias("label"))


def first_pieces(rows: DataFrame) -> DataFrame:
    """A row a word: its first piece's, as encoded() numbers pieces. annotate.first_of_word() is for predictions without such a number, and shuffles them."""
    return rows.filter("n = 0")


def counted(rows: DataFrame) -> DataFrame:
    """The pieces that a loss counts: those whose label isn't IGNORE."""
    return rows.filter(F.col("label") != IGNORE)


def sizes(words: DataFrame, vocabulary: Sequence[str] = PIECES) -> DataFrame:
    """words with n_pieces, the number of pieces of token."""
    return words.withColumn("n_pieces", F.size(pieces(F.col("token"), vocabulary)))
