"""From entities and words to tags, chunks and spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.geometry import Box

CHUNK_TOKENS = 500


def matched(words: DataFrame, entities: DataFrame, *keys: str) -> DataFrame:
    """(keys, entity_type, value, first, idx): where the words of an entity stand in a row, letter case aside; equal entities of a page once."""
    from formlens.operators.labels import occurrences

    return occurrences(words, entities.withColumn("pos", F.lit(0)), *keys).drop("pos")


def entity_boxes(found: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """Bounds of each matched entity, one for each line and block that it spans; equal ones once."""
    rows = found.join(words, [*keys, "idx"]).groupBy(*keys, "entity_type", "value", "first", "block", "line")
    bounds = rows.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return bounds.select(*keys, "entity_type", "value", *Box._fields).distinct()


def tagged(words: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Words with B- and I- tags of the matched entities; names are full names, which give way to others, and the smaller type wins ties."""
    name = F.when(F.col("entity_type").isin("first_name", "last_name"), "full_name").otherwise(F.col("entity_type"))
    tag = F.concat(F.when(F.col("idx") == F.col("first"), "B-").otherwise("I-"), name)
    best = found.groupBy(*keys, "idx").agg(F.min(F.struct((name == "full_name").alias("late"), name.alias("n"), tag.alias("tag"))).alias("x")).select(*keys, "idx", "x.tag")
    return words.join(best, [*keys, "idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def fuzzy_matched(words: DataFrame, entities: DataFrame, keys: Sequence[str], least: float = 95.0) -> DataFrame:
    """matched() with words that are alike by least percent, after a grouped task: a word that fails starts the boxes anew, not the place in the entity."""
    from difflib import SequenceMatcher

    names = list(keys)

    def alike(a: str, b: str) -> bool:
        return a == b or SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio() * 100 >= least

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        page = left.sort_values("idx")[["idx", "token"]].to_numpy().tolist()
        for kind, value in right[["entity_type", "value"]].drop_duplicates().to_numpy().tolist():
            parts, at, held = value.split(), 0, []
            for idx, token in page if parts else []:
                if alike(token, parts[at]):
                    held.append(idx)
                    at += 1
                    if at == len(parts):
                        out += [(*key, kind, value, held[0], i) for i in held]
                        at, held = 0, []
                else:
                    held = []
        return pd.DataFrame(out, columns=[*names, "entity_type", "value", "first", "idx"])

    kinds = [f"{k} {dict(words.dtypes)[k]}" for k in names]
    return words.groupBy(*names).cogroup(entities.toDF(*entities.columns).groupBy(*names)).applyInPandas(run, ", ".join([*kinds, "entity_type string, value string, first int, idx int"]))


def unmatched(entities: DataFrame, found: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Entities that were not found, and whether the page's text holds them; signatures aside."""
    left = entities.filter(F.col("entity_type") != "signature").join(found.select(*keys, "entity_type", "value").distinct(), [*keys, "entity_type", "value"], "left_anti")
    return left.join(pages, list(keys)).select(*keys, "entity_type", "value", F.contains("text", "value").alias("in_text"))


def chunks(tokens: DataFrame, keys: Sequence[str], size: str, most: int = CHUNK_TOKENS) -> DataFrame:
    """tokens with chunk: words are packed in order until the next would pass most; a first word that passes alone leaves chunk 0 empty.

    A fold over the ordered words of a document, as the running sum starts anew with each
    chunk; it keeps the places where chunks start, and the words travel with it. No column may
    be a map, as words are sorted.
    """
    rest = [c for c in tokens.columns if c not in keys]
    row = F.struct(F.col("idx").alias("__at"), F.col(size).cast("int").alias("__n"), F.struct(*rest).alias("__row"))
    arrays = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__w"))

    def step(held, w):
        over = held["used"] + w["__n"] > most
        starts = F.when(over, F.concat(held["starts"], F.array(held["pos"]))).otherwise(held["starts"])
        return F.struct((held["pos"] + 1).alias("pos"), F.when(over, w["__n"]).otherwise(held["used"] + w["__n"]).alias("used"), starts.alias("starts"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"))
    dealt = arrays.withColumn("__starts", F.aggregate("__w", start, step, lambda held: held["starts"]))
    rows = dealt.select(*keys, "__starts", F.posexplode("__w.__row").alias("__pos", "__row"))
    chunk = F.size(F.filter("__starts", lambda at: at <= F.col("__pos")))
    return rows.select(*keys, "__row.*", chunk.alias("chunk"))


def first_of_word(subtokens: DataFrame, *keys: str) -> DataFrame:
    """The prediction of the first sub-token of each word; those of no word are skipped."""
    return subtokens.filter("word_id IS NOT NULL").groupBy(*keys, "word_id").agg(F.min_by("pred", "idx").alias("pred"))


def _runs(tokens: DataFrame, keys: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """(keys, side, category, start, end) of the runs of each of tags, from one sort; side is the tag's place in tags."""
    order = Window.partitionBy(*keys).orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = tokens.select(*keys, "idx", *[x for n, tag in enumerate(tags) for x in (F.substring(tag, 1, 1).alias(f"__m{n}"), F.when(F.col(tag) == "O", "O").otherwise(F.substr(F.col(tag), F.lit(3))).alias(f"__c{n}"))])
    fresh = [F.col(f"__c{n}").isNotNull() & ((F.col(f"__m{n}") == "B") | ~F.col(f"__c{n}").eqNullSafe(F.last(f"__c{n}", ignorenulls=True).over(before))) for n in range(len(tags))]
    marked = named.select("*", *[F.when(x, 1).otherwise(0).alias(f"__f{n}") for n, x in enumerate(fresh)])
    runs = marked.select(*keys, "idx", *[F.when(F.col(f"__c{n}") != "O", F.struct(F.lit(n).alias("side"), F.col(f"__c{n}").alias("category"), F.sum(f"__f{n}").over(order).alias("run"))).alias(f"__r{n}") for n in range(len(tags))])
    rows = runs.select(*keys, "idx", F.explode(F.array_compact(F.array(*[f"__r{n}" for n in range(len(tags))]))).alias("__x")).select(*keys, "idx", "__x.*")
    return rows.groupBy(*keys, "side", "category", "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end")).drop("run")


def spans(tokens: DataFrame, keys: Sequence[str], tag: str = "tag") -> DataFrame:
    """(keys, category, start, end) of runs of tags: B starts one, and so does I after another class or O; rows without a tag are passed over."""
    return _runs(tokens, keys, [tag]).drop("side")


def sequence_metrics(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """precision, recall, f1 and support of spans by class and for all, from tag and pred_tag."""
    from formlens.functions.text import f1, ratio

    side = lambda n: F.max((F.col("side") == n).cast("int"))
    both = _runs(tokens, keys, ["tag", "pred_tag"]).groupBy(*keys, "category", "start", "end").agg(side(0).alias("g"), side(1).alias("p"))
    each = both.groupBy("category").agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    every = each.agg(F.lit("all").alias("category"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n_gt", "n_pred", "tp")])
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gt"))
    return each.unionByName(every).select("category", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), F.col("n_gt").alias("support"))


def last_image(images: DataFrame, *keys: str) -> DataFrame:
    """The box of the last image of each page, which is the signature."""
    return images.groupBy(*keys).agg(F.max_by(F.struct(*Box._fields), "pos").alias("b")).select(*keys, "b.*")


def with_signatures(tokens: DataFrame, signatures: DataFrame, *keys: str) -> DataFrame:
    """tokens and, after them, a token for each signature box."""
    after = tokens.groupBy(*keys).agg((F.max("idx") + 1).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(*Box._fields)
    rows = signatures.join(after, list(keys), "left").withColumn("idx", (F.coalesce("__n", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    return tokens.unionByName(rows.select(*keys, "idx", F.lit("[SIGNATURE]").alias("token"), *[F.col(x).cast(tokens.schema[x].dataType) for x in Box._fields], F.lit("B-signature").alias("tag")), allowMissingColumns=True)


def predicted(pages: DataFrame, model, schema: str) -> DataFrame:
    """Runs a model over batches of pages: model() is called once a task and gives a function of a pandas frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model()
        for batch in batches:
            yield infer(batch)

    return pages.mapInPandas(run, schema)
