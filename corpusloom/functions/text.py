"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+|[가-힣]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and digits, or of Hangul; a Hangul run of three or more is followed by its pairs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    paired = F.flatten(F.transform(runs, lambda w: F.when(w.rlike("^[가-힣]{3,}$"), F.concat(F.array(w), pairs(w))).otherwise(F.array(w))))
    return F.when(text.rlike("[가-힣]{3}"), paired).otherwise(runs)


def squeezed(text: Column) -> Column:
    """Non-breaking spaces as spaces, runs of blanks as one, three or more line ends as two, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " ", " "), "[ \t]+", " "), "\n{3,}", "\n\n"))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def class_form(text: Column) -> Column:
    """Class codes compare without hyphens and spaces, in upper case."""
    return F.upper(F.translate(text, "- ", ""))


def number(text: Column) -> Column:
    """The first signed decimal, without thousands' commas; null where there is none."""
    return F.try_cast(F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0), F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0), F.lit("")).cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the lower-cased text (each counts once)."""
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words[1:]), F.contains(F.lower(text), F.lit(words[0])).cast("int"))
