"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name similarity, in per cent, from which two entities of a type are the same.
SAME_NAME = 88


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows the blank alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slugify(text: Column) -> Column:
    """Lower-case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_slug(kind: Column, name: Column) -> Column:
    """The usual id of an entity: its type and its name as a slug."""
    return F.concat(F.lower(kind), F.lit("_"), slugify(name))


def token_sort(text: Column) -> Column:
    """Lower-case words in order, joined by one blank."""
    return F.array_join(F.array_sort(F.array_remove(F.split(F.lower(text), r"(?U)\s+"), "")), " ")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings.

    Row by row: each character of `a` turns the row of lengths into the running maximum of what a match adds to the
    value left above and of the value above.
    """
    right, none = F.split(b, ""), F.array(F.lit(0))
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(before: Column, c: Column) -> Column:
        reach = F.transform(right, lambda d, i: F.greatest(F.get(before, i + 1), F.get(before, i) + F.when(c == d, 1).otherwise(0)))
        return F.aggregate(reach, none, lambda made, x: F.concat(made, F.array(F.greatest(F.element_at(made, -1), x))))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(F.split(a, ""), start, row), -1))


def indel_score(a: Column, b: Column) -> Column:
    """Similarity of two strings in per cent where edits are insertions and deletions alone; 100 for two empty ones."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * common_subsequence(a, b) / both)


def may_be_similar(a: Column, b: Column, least: int = SAME_NAME) -> Column:
    """What two token-sorted names of that score fulfil for certain, and is cheap: a bound of their lengths, and of
    their Levenshtein distance, which is no more than insertions and deletions together."""
    both = F.length(a) + F.length(b)
    near = 200 * F.least(F.length(a), F.length(b)) >= least * both
    most = F.floor((100 - least) * both / 100).cast("int")
    return near & (F.levenshtein(a, b) <= most)


def money(text: Column) -> dict[str, Column]:
    """amount (numeric string in millions where a magnitude is named), currency and unit of the first sum in a text."""
    pattern = r"(?i)(\$|US\$|USD|€|EUR|£|GBP|₹|INR)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(trillion|billion|million|thousand|bn|mn|k)?\b"
    sign, digits, word = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    number = F.regexp_replace(digits, ",", "").cast("decimal(20,6)")
    factor = F.when(F.lower(word) == "trillion", F.lit(1000000)).when(F.lower(word).isin("billion", "bn"), F.lit(1000)).when(F.lower(word).isin("million", "mn"), F.lit(1))
    factor = factor.when(F.lower(word).isin("thousand", "k"), F.lit("0.001").cast("decimal(4,3)"))
    scaled = (number * F.coalesce(factor, F.lit(1)).cast("decimal(10,3)")).cast("decimal(28,6)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(scaled, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    currency = F.when(F.upper(sign).isin("$", "US$", "USD"), "USD").when(F.upper(sign).isin("€", "EUR"), "EUR").when(F.upper(sign).isin("£", "GBP"), "GBP").when(sign != "", "INR")
    has = digits != ""
    return {"amount": F.when(has, plain), "currency": F.when(has, currency), "unit": F.when(has & (word != ""), "M")}
