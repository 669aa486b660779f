"""The token table: one row for each (document, place), with text, box and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.geometry import Box

#: The plain layout of texts without boxes: words a page, columns, and steps in pixels.
PAGE_WORDS, COLUMNS, STEP_X, STEP_Y = 320, 8, 95, 26
CATEGORIES = ["full_name", "company_name", "address", "phone_number", "car_plate", "payment_information"]


def exploded(labelled: DataFrame, *keys: str) -> DataFrame:
    """Rows of tokens from parallel arrays tokens, bboxes and ner_tags."""
    zipped = labelled.select(*keys, F.posexplode(F.arrays_zip("tokens", "bboxes", "ner_tags")).alias("idx", "x"))
    box = [F.get("x.bboxes", F.lit(i)).alias(name) for i, name in enumerate(Box._fields)]
    return zipped.select(*keys, "idx", F.col("x.tokens").alias("token"), *box, F.col("x.ner_tags").alias("tag"))


def collected(tokens: DataFrame, *keys: str) -> DataFrame:
    """Parallel arrays from rows of tokens, in the order of idx; a document is one row."""
    row = F.struct("idx", "token", F.array(*Box._fields).alias("bbox"), "tag")
    rows = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("x"))
    return rows.select(*keys, F.col("x.token").alias("tokens"), F.col("x.bbox").alias("bboxes"), F.col("x.tag").alias("ner_tags"))


def laid_out(docs: DataFrame, *more: str) -> DataFrame:
    """Rows of tokens of plain texts: every word, PAGE_WORDS a page, on a grid of whole pixels."""
    words = F.array_remove(F.split("text", "[ \n]+"), "")
    rows = docs.select("doc_id", *more, F.posexplode(words).alias("i", "token"))
    rows = rows.withColumns({"page": F.floor(F.col("i") / PAGE_WORDS).cast("int"), "idx": F.col("i") % PAGE_WORDS})
    x0, y0 = F.lit(5) + F.col("idx") % COLUMNS * STEP_X, F.lit(4) + F.floor(F.col("idx") / COLUMNS).cast("int") * STEP_Y
    return rows.select("doc_id", *more, "page", "idx", "i", "token", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.lit(90), F.length("token") * 7)).alias("x1"), (y0 + 18).alias("y1"))


def sides(bboxes: Column) -> list[Column]:
    """The four parallel arrays x0, y0, x1, y1 of an array of boxes; what a box lacks is null."""
    side = lambda k: F.transform(bboxes, lambda b: F.get(b, F.lit(k)))
    return [side(k).alias(name) for k, name in enumerate(Box._fields)]


def boxed() -> Column:
    """The array of boxes of the four parallel arrays."""
    return F.transform(F.arrays_zip(*Box._fields), lambda b: F.array(*[b[x] for x in Box._fields]))


def page_files(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page, tokens, x0, y0, x1, y1): laid_out() with a row of parallel arrays a page, cut from the text without a shuffle; a text without words has no file."""
    words = docs.select("doc_id", *more, F.array_remove(F.split("text", "[ \n]+"), "").alias("words")).filter("size(words) > 0")
    rows = words.select("doc_id", *more, "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PAGE_WORDS).cast("int"))).alias("page"))
    rows = rows.select("doc_id", *more, "page", F.slice("words", F.col("page") * PAGE_WORDS + 1, F.lit(PAGE_WORDS)).alias("tokens"))
    x0s, y0s = ([5 + i % COLUMNS * STEP_X for i in range(PAGE_WORDS)], [4 + i // COLUMNS * STEP_Y for i in range(PAGE_WORDS)])
    here = lambda values: F.slice(F.lit(values), F.lit(1), F.size("tokens"))
    x1 = F.transform("tokens", lambda t, i: F.lit(5) + i % COLUMNS * STEP_X + F.least(F.lit(90), F.length(t) * 7))
    return rows.select("*", here(x0s).alias("x0"), here(y0s).alias("y0"), x1.alias("x1"), here([y + 18 for y in y0s]).alias("y1"))


#: Tags that stand for the first places of a cycle of 97, and what a wrong prediction makes of them.
CYCLE = [f"B-{x}" for x in CATEGORIES] + [f"I-{x}" for x in CATEGORIES[:3]]
SWAPPED = [x[:2] + ("company_name" if x.endswith("address") else "address") for x in CYCLE]


def _place(doc_id: Column, i: Column) -> Column:
    return ((doc_id * 31 + i * 17) % 97).cast("int")


def gold_tag(doc_id: Column, i: Column) -> Column:
    """A tag worked out from the place, in place of an annotator."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in CYCLE]), _place(doc_id, i)), F.lit("O"))


def annotated(docs: DataFrame, *more: str) -> DataFrame:
    """laid_out() with the gold tag, and a prediction's tag and shift in pixels: some dropped, swapped, moved or made up.

    Each tag is looked up by numbers alone: filters on tags are inlined by the optimizer, and
    tags made out of other tags would then be worked out many times a word.
    """
    d, r = (F.col("doc_id") * 13 + F.col("i") * 7) % 29, _place(F.col("doc_id"), F.col("i"))
    swapped = F.get(F.array(*[F.lit(x) for x in SWAPPED]), r)
    named = F.when(d == 0, "O").when(d == 1, swapped).otherwise(gold_tag(F.col("doc_id"), F.col("i")))
    pred = F.when(r < len(CYCLE), named).when((d == 5) & r.between(40, 44), "B-address").otherwise("O")
    rows = laid_out(docs, *more)
    return rows.withColumns({"tag": gold_tag(F.col("doc_id"), F.col("i")), "pred_tag": pred, "shift": F.when(d.between(2, 4), d * 5).otherwise(0).cast("int")})


def pages(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page) of all pages; a text without words has page 0."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), ""))
    last = F.greatest(F.floor((n - 1) / PAGE_WORDS).cast("int"), F.lit(0))
    return docs.select("doc_id", *more, F.explode(F.sequence(F.lit(0), last)).alias("page"))
