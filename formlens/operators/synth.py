"""Made-up personal values and document texts, with draws that depend on a seed and the row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.draws import below, pick, uniform

#: The orders in which an address names its parts.
ADDRESS_ORDERS = [
    ["street", "city", "zip_code"], ["building_number", "street", "city", "zip_code"], ["zip_code", "city", "street"], ["city", "street", "building_number", "zip_code"],
    ["street", "zip_code", "city"], ["zip_code", "street", "city", "building_number"], ["city", "zip_code", "street"], ["street", "building_number", "zip_code", "city"],
    ["street", "building_number"], ["building_number", "street", "city"], ["zip_code", "city"], ["building_number", "street", "zip_code"],
]
#: Fewest and most values of each class in a document.
COUNTS = {
    "full_name": (5, 6), "address": (3, 4), "phone_number": (2, 3), "email_address": (2, 3), "dates": (2, 3), "credit_card_number": (1, 2), "iban": (1, 2),
    "company_name": (1, 2), "vin": (1, 2), "car_plate": (1, 2),
}
#: Fixed value: how often a middle name, upper case or another form of a value is drawn.
SOMETIMES = 0.2
#: How a scanned page is changed, of which STEPS are drawn; the two named together exclude each other.
CHANGES = ["compression", "shadow", "vignette", "brightness", "lighting", "rotation", "lines"]
STEPS = 3
#: The step that each made copy has besides.
PASTE = "paste"


def addresses(parts: DataFrame, seed: str = "address") -> DataFrame:
    """parts (key, and an array column for each part of an address) with address."""
    names = ["street", "city", "zip_code", "building_number"]
    drawn = F.create_map(*[x for n in names for x in (F.lit(n), pick(F.col(n), f"{seed}-{n}", F.col("key")))])
    orders = F.array(*[F.array(*[F.lit(x) for x in o]) for o in ADDRESS_ORDERS])
    order = pick(orders, seed, F.col("key"))
    sign = F.when(below(2, f"{seed}-sign", F.col("key")) == 0, ", ").otherwise(" ")
    return parts.withColumn("address", F.array_join(F.transform(order, lambda x: F.try_element_at(drawn, x)), "\u0001")).withColumn("address", F.replace("address", F.lit("\u0001"), sign))


def full_names(parts: DataFrame, seed: str = "name") -> DataFrame:
    """parts (key, first_name, middle_name, last_name arrays) with full_name, now and then with a middle name."""
    first, middle, last = (pick(F.col(n), f"{seed}-{n}", F.col("key")) for n in ("first_name", "middle_name", "last_name"))
    with_middle = F.when(uniform(seed, F.col("key")) <= SOMETIMES, middle)
    return parts.withColumn("full_name", F.concat_ws(" ", first, with_middle, last))


def document_values(docs: DataFrame, pool: DataFrame, seed: str = "values") -> DataFrame:
    """(doc_id, category, n, value): values of each class drawn from a pool (key, pos, value) for each document, and first and last names from the full ones.

    The drawn place is joined to the pool, so the pool may be of any size.
    """
    sizes = pool.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    slots = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(a).alias("least"), F.lit(b - a + 1).alias("spread")) for k, (a, b) in COUNTS.items()])
    rows = docs.select("doc_id", F.explode(slots).alias("s")).select("doc_id", "s.*")
    count = F.col("least") + below(F.col("spread"), f"{seed}-count", F.col("doc_id"), F.col("category"))
    rows = rows.select("doc_id", "category", F.explode(F.sequence(F.lit(1), count)).alias("n")).join(F.broadcast(sizes), F.col("category") == F.col("key")).drop("key")
    place = F.pmod(below(1 << 30, seed, F.col("doc_id"), F.col("category"), F.col("n")), F.col("size")) + 1
    drawn = rows.withColumn("pos", place).join(pool.withColumnRenamed("key", "category"), ["category", "pos"]).select("doc_id", "category", "n", "value")
    words = F.split("value", " ")
    part = lambda name, at: drawn.filter(F.col("category") == "full_name").select("doc_id", F.lit(name).alias("category"), "n", F.element_at(words, at).alias("value"))
    every = drawn.unionByName(part("first_name", 1)).unionByName(part("last_name", -1))
    upper = uniform(f"{seed}-upper", F.col("doc_id"), F.col("category"), F.col("n")) <= SOMETIMES
    return every.withColumn("value", F.when(upper, F.upper("value")).otherwise(F.col("value")))


def adjusted(value: Column, category: Column, *keys: Column, seed: str = "adjust") -> Column:
    """Other forms of names, and upper case in the first part of mail addresses, now and then; each form has a draw of its own."""
    draw = lambda name: uniform(f"{seed}-{name}", *keys) <= SOMETIMES
    words = F.split(F.trim(value), r"\s+")
    word = lambda i: F.get(words, F.lit(i))
    two = F.when(draw("swap"), F.concat(word(1), F.lit(", "), word(0))).when(draw("initial"), F.concat(F.substring(word(0), 1, 1), F.lit(". "), word(1))).otherwise(value)
    titled = F.concat(F.when(below(2, f"{seed}-which", *keys) == 0, "Mr. ").otherwise("Ms. "), two)
    two = F.when(draw("title") & ~F.contains(two, F.lit(",")), titled).otherwise(two)
    base = F.when(F.size(words) == 2, two).otherwise(value)
    three = F.split(base, r"\s+")
    short = F.concat(F.get(three, F.lit(0)), F.lit(" "), F.substring(F.get(three, F.lit(1)), 1, 1), F.lit(". "), F.get(three, F.lit(2)))
    name = F.when((F.size(three) == 3) & draw("middle"), short).otherwise(base)
    mail = F.when(draw("mail"), F.concat(F.upper(F.substring_index(value, "@", 1)), F.lit("@"), F.get(F.split(value, "@"), F.lit(1)))).otherwise(value)
    return F.when(category == "full_name", name).when(category == "email_address", mail).otherwise(value)


def scan_plan(docs: DataFrame, copies: int = 3, seed: str = "scan") -> DataFrame:
    """(doc_id, copy, step, change): the changes of each made copy of a page, with the paste among them, in an order of its own draw; where both are drawn, shadow rules brightness out."""
    changes = F.array(*[F.lit(c) for c in CHANGES])
    each = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    ordered = F.sort_array(F.transform(changes, lambda c: F.struct(uniform(seed, F.col("doc_id"), F.col("copy"), c).alias("u"), c.alias("c"))))
    drawn = F.concat(F.slice(F.transform(ordered, lambda x: x["c"]), 1, STEPS), F.array(F.lit(PASTE)))
    mixed = F.sort_array(F.transform(drawn, lambda c: F.struct(uniform(f"{seed}-order", F.col("doc_id"), F.col("copy"), c).alias("u"), c.alias("c"))))
    kept = F.filter(F.transform(mixed, lambda x: x["c"]), lambda c: (c != "brightness") | ~F.array_contains(drawn, "shadow"))
    return each.select("doc_id", "copy", F.posexplode(kept).alias("step", "change"))


def catalogue_rows(docs: DataFrame, vocabulary: dict[str, list[str]], seed: str = "catalogue") -> DataFrame:
    """docs with a short id, and one value of each list of a vocabulary."""
    drawn = {k: pick(F.array(*[F.lit(x) for x in v]), f"{seed}-{k}", F.col("doc_id")) for k, v in vocabulary.items()}
    return docs.withColumns({"short_id": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary")), 1, 7), **drawn})


def changed_margin(latex: Column, max_y: Column, *keys: Column, seed: str = "margin") -> Column:
    """The top margin of a page, drawn between 1 cm and what is left below max_y of 820 points, 28 to a cm."""
    room = F.greatest((F.lit(820.0) - max_y) / 28.0, F.lit(1.0))
    top = F.round(1.0 + uniform(seed, *keys) * (room - 1.0), 2)
    return F.regexp_replace(latex, F.lit(r"top=[0-9.]+cm"), F.concat(F.lit("top="), F.format_string("%.2f", top), F.lit("cm")))
