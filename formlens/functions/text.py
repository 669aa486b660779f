"""Tags, names and source texts of documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class ids of personal data; 13 is reserved.
PII_CLASSES = {
    "first_name": 0, "last_name": 1, "address": 2, "phone_number": 3, "email_address": 4, "dates": 5, "credit_card_number": 6, "iban": 7,
    "company_name": 8, "signature": 9, "full_name": 10, "vin": 11, "car_plate": 12, "invoice_id": 14, "payment_information": 15,
}
#: The tags that models are trained on; a tag's id is its place.
TAGS = [
    "B-payment_information", "I-payment_information", "B-full_name", "I-full_name", "B-company_name", "I-company_name", "O", "B-address", "I-address",
    "B-phone_number", "I-phone_number", "B-car_plate", "I-car_plate", "B-email_address", "B-vin",
]
#: What a rule-based detector's types are called here.
DETECTOR_TYPES = {
    "PERSON": "full_name", "LOCATION": "address", "EMAIL_ADDRESS": "email_address", "CREDIT_CARD": "payment_information", "IBAN_CODE": "payment_information",
    "PHONE_NUMBER": "phone_number",
}


def category(tag: Column) -> Column:
    """The tag without B- or I-; other tags as they are."""
    return F.when(tag.rlike("^[BI]-"), F.substr(tag, F.lit(3))).otherwise(tag)


def second_part(tag: Column) -> Column:
    return F.split_part(tag, F.lit("-"), F.lit(2))


def last_part(tag: Column) -> Column:
    return F.split_part(tag, F.lit("-"), F.lit(-1))


def without_marks(tag: Column) -> Column:
    """Both marks gone, wherever they stand."""
    return F.replace(F.replace(tag, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit(""))


def label_name(tag: Column) -> Column:
    """Lower case without the mark; other for a bare tag."""
    return F.lower(F.coalesce(F.nullif(F.substr(tag, F.lit(3)), F.lit("")), F.lit("other")))


def stem_before_last(name: Column) -> Column:
    """What stands before the last underscore; nothing if there is none."""
    return F.when(F.contains(name, F.lit("_")), F.regexp_replace(name, "_[^_]*$", "")).otherwise("")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def fenced(answer: Column, language: str) -> Column:
    """The only fenced block of a language, or the answer without fences if there isn't exactly one."""
    found = F.regexp_extract_all(answer, F.lit(f"(?s)```{language}\n(.*?)\n```"), F.lit(1))
    bare = F.replace(F.replace(answer, F.lit(f"```{language}"), F.lit("")), F.lit("```"), F.lit(""))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(bare)


def without_json_fences(answer: Column) -> Column:
    return F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def smaller_html_font(html: Column) -> Column:
    """All font sizes become the first one less 1."""
    first = F.regexp_extract(html, r"font-size: ([0-9]+)px;", 1)
    less = F.nullif(first, F.lit("")).cast("int") - 1
    return F.coalesce(F.regexp_replace(html, F.lit(r"font-size: [0-9]+px;"), F.concat(F.lit("font-size: "), less.cast("string"), F.lit("px;"))), html)


def smaller_latex_font(latex: Column) -> Column:
    """The size in points of the document class, less 1."""
    first = F.nullif(F.regexp_extract(latex, r"documentclass\[([0-9]+)pt\]", 1), F.lit(""))
    form = lambda size: F.concat(F.lit("documentclass["), size.cast("string"), F.lit("pt]"))
    return F.coalesce(F.replace(latex, form(first), form(first.cast("int") - 1)), latex)


def with_graphics(latex: Column) -> Column:
    """The graphics package after the class line, unless it is there."""
    end = "pt]{article}"
    return F.when(F.contains(latex, F.lit("usepackage{graphicx}")), latex).otherwise(F.replace(latex, F.lit(end), F.lit(end + "\n\\usepackage{graphicx}")))


def signed(source: Column, placeholder: str, image: str, first_only: bool) -> tuple[Column, Column]:
    """The source with its signature placeholder, or all of them, replaced; and whether it had one."""
    at = F.instr(source, F.lit(placeholder))
    once = F.when(at > 0, F.overlay(source, F.lit(image), at, F.lit(len(placeholder)))).otherwise(source)
    return (once if first_only else F.replace(source, F.lit(placeholder), F.lit(image))), at > 0


def ocr_word(word: Column) -> Column:
    """Whether a read word is kept: not blank, ASCII, under 50 characters."""
    return (F.trim(word) != "") & word.rlike(r"^[\x00-\x7F]*$") & (F.length(word) < 50)


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def short_id(*keys: Column) -> Column:
    """Seven characters that depend on the keys."""
    return F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary")), 1, 7)
