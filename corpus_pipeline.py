"""From raw documents to token ids: quality, near copies, repeated passages, the mix of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage judges all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm import byte_bpe, mixing, near_dedup, quality, span_dedup
from formlens.llm.common import documents, nested, stored

#: SQL can't express near dedup, repeated spans and byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None
#: The least similarity of near copies in near_duplicates; op10 has its own.
NEAR_PERCENT = 80
#: The least words of a passage that repeated_spans removes.
PASSAGE_WORDS = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their host's verdict keep; counts are made once for the hosts and once for the documents, and no text is stored for it."""
    return quality.judged(quality.counts(nested(docs, "doc_id", "text", "source"))).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked by a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, NEAR_PERCENT)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of over 50 words, and the strings of 400 bytes, that stand elsewhere too."""
    return span_dedup.remove_repeats(docs, words=PASSAGE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(mixing.mix(nested(docs, "doc_id", "text", "source"))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and digests of the ids and of the bytes they decode to."""
    found = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result stored before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
