"""Label files from words and entities: matching in a row, tags in the order of the entities, signatures, clipped boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.geometry import Box, clipped
from formlens.operators.annotate import with_signatures

#: Types whose words are tagged as full names.
NAMES = ("first_name", "last_name", "middle_name")
#: Words alike by so many tenths of a percent, rounded, are one.
LEAST = 945
GRAM = 3
#: Places of one entity on a page that are written one by one.
SPLICES = 64


def processed(word: Column) -> Column:
    """Lower case, with a space for each character that is no letter, number or underscore."""
    return F.trim(F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_]", " "))


def parts_of(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def common_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, by a fold over a's characters that holds a row of lengths."""
    of_b = F.split(b, "")

    def row(before, c):
        cell = lambda held, j: F.greatest(F.element_at(held, -1), before[j], before[j - 1] + F.when(of_b[j - 1] == c, 1).otherwise(0))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), lambda held, j: F.concat(held, F.array(cell(held, j))))

    return F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), row, lambda held: F.element_at(held, -1))


def alike(a: Column, b: Column) -> Column:
    """Whether two words, in processed() form, are alike by 95 percent of a weighted ratio.

    Words of which one is half as long again as the other aren't. Else the parts of one may
    all be parts of the other, or the share of characters in common, in order, rounds to 95
    percent. Characters in common are counted only where the edit distance leaves it open.
    """
    la, lb = F.length(a), F.length(b)
    both, apart = la + lb, F.abs(la - lb)
    within = (F.size(F.array_except(parts_of(a), parts_of(b))) == 0) | (F.size(F.array_except(parts_of(b), parts_of(a))) == 0)
    few = lambda edits: edits * 1000 < both * (1000 - LEAST)
    edits = F.levenshtein(a, b)  # between half the characters not in common and all of them
    near = F.when(~few(edits), False).when(few(2 * edits) | (edits == apart), True).when(edits < 2, False).otherwise(few(both - 2 * common_length(a, b)))
    return (la > 0) & (lb > 0) & (2 * F.greatest(la, lb) < 3 * F.least(la, lb)) & (within | near)


def join_keys(word: Column, plain: Column) -> Column:
    """What alike words have in common with one another, one at least: the word itself, a part, or a gram where they are long enough to differ."""
    n = F.length(plain) - (GRAM - 1)
    grams = F.when(n + GRAM > 9, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(plain, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    tagged = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tagged("w", F.array(word)), tagged("p", parts_of(plain)), tagged("g", grams)))


def occurrences(words: DataFrame, entities: DataFrame, *keys: str, fuzzy: bool = False) -> DataFrame:
    """(keys, pos, entity_type, value, first, idx): each place where the words of an entity (keys, pos, entity_type, value) stand in a row on its page.

    Words meet the entity's words by an equi-join, letter case aside or, if fuzzy, by keys of
    alike words; an entity stands where all its words do, each at its own distance from the
    first. Different words of a page are compared once. Entities without words stand nowhere,
    and repeated ones count once.
    """
    rows = entities.select(*keys, "pos", "entity_type", "value").distinct().withColumn("parts", F.array_remove(F.split("value", r"\s+"), ""))
    rows = rows.select(*keys, "pos", "entity_type", "value", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    if fuzzy:
        side = lambda df, name: df.select(*keys, F.col(name)).distinct().withColumn(f"{name}_plain", processed(F.col(name))).withColumn("key", F.explode(join_keys(F.col(name), F.col(f"{name}_plain"))))
        met = side(words, "token").join(side(rows, "part"), [*keys, "key"]).drop("key").distinct()
        same = met.filter((F.col("token") == F.col("part")) | alike(F.col("token_plain"), F.col("part_plain"))).select(*keys, "token", "part")
        pairs = words.select(*keys, "idx", "token").join(same, [*keys, "token"]).join(rows, [*keys, "part"])
    else:
        pairs = words.select(*keys, "idx", F.lower("token").alias("low")).join(rows.withColumn("low", F.lower("part")), [*keys, "low"])
    placed = pairs.groupBy(*keys, "pos", "entity_type", "value", "n", (F.col("idx") - F.col("k")).alias("first")).agg(F.count(F.lit(1)).alias("held")).filter("held = n")
    return placed.select(*keys, "pos", "entity_type", "value", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("idx"))


def tags_in_order(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, tag): a word of several entities has the tag of the last one that is no name, or else of the first name."""
    name = F.col("entity_type").isin(*NAMES)
    tag = F.concat(F.when(F.col("idx") == F.col("first"), "B-").otherwise("I-"), F.when(name, "full_name").otherwise(F.col("entity_type")))
    order = F.struct("pos", "first")
    picked = found.groupBy(*keys, "idx").agg(F.max_by(F.when(~name, tag), F.when(~name, order)).alias("other"), F.min_by(F.when(name, tag), F.when(name, order)).alias("named"))
    return picked.select(*keys, "idx", F.coalesce("other", "named").alias("tag"))


def label_rows(words: DataFrame, entities: DataFrame, images: DataFrame | None, page_size: tuple[int, int], *keys: str, fuzzy: bool = False) -> DataFrame:
    """(keys, idx, token, box, tag) of label files: words with their tags, after them the last of images (keys, pos, box) as a signature where there is one, and boxes inside the page.

    For words that come as rows, or are to be matched by likeness; label_files() is for files
    of arrays and shuffles less. tokens.collected() makes the arrays of a file of these rows.
    """
    tags = tags_in_order(occurrences(words, entities, *keys, fuzzy=fuzzy), *keys)
    rows = words.select(*keys, "idx", "token", *Box._fields).join(tags, [*keys, "idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))
    if images is not None:
        last = images.groupBy(*keys).agg(F.max_by(F.struct(*Box._fields), "pos").alias("b")).select(*keys, "b.*")
        rows = with_signatures(rows, last, *keys)
    width, height = (F.lit(x) for x in page_size)
    inside = clipped(Box.of(), width, height)
    return rows.select(*keys, "idx", "token", *inside.named(), "tag")


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(low: Column, parts: Column) -> Column:
    """For each place of low, whether parts stand in a row from there."""
    here = lambda t, i: F.coalesce((t == F.get(parts, F.lit(0))) & (F.slice(low, i + 1, F.size(parts)) == parts), F.lit(False))
    return F.transform(low, here)


def overwritten(tags: Column, low: Column, entity: Column) -> Column:
    """tags after one more entity: its words take its tags, but a name leaves words that have a tag. Where an entity overlaps itself, the later start counts, or for a name the earlier.

    Up to SPLICES places are written one by one, as copies of whole arrays are cheap; more
    are written in one pass over the words.
    """
    parts, kind = entity["parts"], entity["entity_type"]
    n, name = F.size(parts), kind.isin(*NAMES)
    first, later = F.concat(F.lit("B-"), kind), F.concat(F.lit("I-"), kind)

    def spliced(held, at):
        named = F.transform(F.slice(held, at + 1, n), lambda t, k: F.when(t != "O", t).when(k == 0, "B-full_name").otherwise("I-full_name"))
        piece = F.when(name, named).otherwise(F.concat(F.array(first), F.array_repeat(later, n - 1)))
        return F.concat(F.slice(held, F.lit(1), at), piece, F.slice(held, at + n + 1, F.size(held)))

    def in_one_pass(hits):
        def tag(t, i):
            since = F.greatest(i - n + 1, F.lit(0))
            begun = F.array_contains(F.slice(hits, since + 1, i - since), True)  # by a start before this word
            named = F.when(t != "O", t).when(begun, "I-full_name").when(F.get(hits, i), "B-full_name").otherwise(t)
            other = F.when(F.get(hits, i), first).when(begun, later).otherwise(t)
            return F.when(name, named).otherwise(other)

        return F.transform(tags, tag)

    here = lambda i: (F.get(low, i) == F.get(parts, F.lit(0))) & (F.slice(low, i + 1, n) == parts)
    places = F.when(F.size(low) >= n, F.filter(F.sequence(F.lit(0), F.size(low) - n), here)).otherwise(F.array().cast("array<int>"))
    return bound(places, lambda at: F.when(F.size(at) <= SPLICES, F.aggregate(at, tags, spliced)).otherwise(bound(starts(low, parts), in_one_pass)))


def label_files(files: DataFrame, entities: DataFrame, images: DataFrame | None, page_size: tuple[int, int], *keys: str) -> DataFrame:
    """label_rows() for files (keys, tokens, x0, y0, x1, y1) that are rows of parallel arrays; tokens.sides() makes the last four of bboxes.

    A page's entities meet its words inside its row, so files are shuffled once, by keys, and
    words never; the entities of a page, without repeats, are held beside it. Pages with
    images alone have the signature alone; one with null keys has neither entities nor
    images. Null words are no entity's; null arrays are empty ones. Further columns of files
    are left out.
    """
    parts = F.transform(F.array_remove(F.split("value", r"\s+"), ""), F.lower)
    each = entities.select(*keys, F.struct("pos", "entity_type", parts.alias("parts")).alias("e")).filter("e.entity_type IS NOT NULL AND size(e.parts) > 0")
    wanted = each.groupBy(*keys).agg(F.sort_array(F.collect_set("e")).alias("wanted"))
    words = "array<string>"
    # words travel as JSON, in some half of an array's room
    held = files.select(*keys, F.to_json("tokens").alias("packed"), *Box._fields).join(wanted, list(keys), "left")
    if images is not None:
        last = images.groupBy(*keys).agg(F.max_by(F.struct(*Box._fields), "pos").alias("signature"))
        held = held.join(last, list(keys), "full")
    else:
        held = held.withColumn("signature", F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"))
    # names of their own, as a select takes names inside lambdas for those of its other columns
    read = F.coalesce(F.from_json("packed", words), F.array().cast(words))
    held = held.select(*keys, "wanted", "signature", read.alias("token"), *[F.coalesce(c, F.array().cast(files.schema[c].dataType)).alias(c) for c in Box._fields])
    blank = F.array_repeat(F.lit("O"), F.size("token"))
    tags = bound(F.transform("token", F.lower), lambda low: F.aggregate("wanted", blank, lambda tags, e: overwritten(tags, low, e)))
    zipped = held.withColumn("tag", F.coalesce(tags, blank)).select(*keys, "signature", F.arrays_zip("token", *Box._fields, "tag").alias("rows"))
    sign = F.struct(F.lit("[SIGNATURE]").alias("token"), *[F.col(f"signature.{c}").cast(files.schema[c].dataType.elementType).alias(c) for c in Box._fields], F.lit("B-signature").alias("tag"))
    ended = F.when(F.col("signature").isNotNull(), F.concat("rows", F.array(sign))).otherwise(F.col("rows"))
    rows = zipped.select(*keys, F.posexplode(ended).alias("idx", "x")).select(*keys, "idx", "x.*")
    inside = clipped(Box.of(), *[F.lit(x) for x in page_size])
    return rows.select(*keys, "idx", "token", *inside.named(), "tag")
