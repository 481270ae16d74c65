"""Names, labels and numbers of documents as column expressions. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that do not tell one family of funds from another, the longer before those they hold.
LEGAL = ("증권자투자신탁", "증권투자신탁", "자투자신탁", "투자신탁", "증권")
TERMS = ("초단기", "중단기", "중장기", "초장기", "단기", "장기")
SPLICED = "없음|투자비용"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode's composed form; null becomes the empty string. Spark has no function for it."""
    return texts.map(lambda t: "" if t is None else unicodedata.normalize("NFC", t))


def flat(text: Column) -> Column:
    """Without white space, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def family(name: Column) -> Column:
    """What funds of one family share: no brackets, series numbers, legal words or terms; null is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", ""), r"(?U)제?\d+호", "")
    for words in (LEGAL, TERMS):
        for w in words:
            out = F.replace(out, F.lit(w), F.lit(""))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def without_echo(title: Column) -> Column:
    """A title whose end says the same thing twice says it once."""
    return F.regexp_replace(F.trim(title), r"(?U)(\S.{2,}?)\s+\1$", "$1")


def section_of(headings: Column, table_title: Column) -> Column:
    """The path of headings, else the table's title if it has one."""
    some = F.exists(headings, lambda h: F.coalesce(h != "", F.lit(False)))
    return F.when(some, F.array_join(headings, " > ")).otherwise(F.nullif(table_title, F.lit("")))


def shown_label(label: Column) -> Column:
    """Without words that slipped in from other cells, then without blanks between Hangul."""
    return F.regexp_replace(F.regexp_replace(label, SPLICED, ""), r"(?U)(?<=[가-힣\-])\s+(?=[가-힣])", "")


def file_stem(path: Column) -> Column:
    """A name that any file system takes, 150 characters at most."""
    return F.substring(F.regexp_replace(path, r"(?U)[^\w가-힣.-]+", "_"), 1, 150)


def percent(rate: Column) -> Column:
    """Four digits that count and a percent sign, for rates of 0.0001 to 9999; ties of the number as written go up."""
    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.nullif(F.abs(rate), F.lit(0.0))))).cast("int")
    text = F.when(rate == 0, F.lit("0")).otherwise(F.format_string("%.7f", F.round(rate * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)))
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("%"))


def chunk_owner(chunk_id: Column) -> Column:
    """The document of a chunk id like owner_p12_0003; the id itself where it is of another form."""
    found = F.regexp_extract(chunk_id, r"^(.*?)_p?\d+(?:_\d+)?$", 1)
    return F.when(found != "", found).otherwise(chunk_id)


def chunk_ordinal(chunk_id: Column) -> Column:
    return F.nullif(F.regexp_extract(chunk_id, r"_(\d+)$", 1), F.lit("")).cast("long")


def spellings(value: Column) -> Column:
    """How a number may be written: 0.2 and 0.20, 900, 1900 and 1,900."""
    whole = value == F.floor(value)
    fixed = [F.format_string(f"%.{n}f", value) for n in (1, 2, 3, 4)]
    exact = F.flatten(F.array(*(F.when(f.cast("double") == value, F.array(f, F.concat(f, F.lit("0")))).otherwise(F.array().cast("array<string>")) for f in fixed)))
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), r"0+$", ""), r"\.$", "")
    return F.when(whole, F.array(value.cast("long").cast("string"), F.format_number(value, 0))).otherwise(F.array_distinct(F.concat(F.array(short), exact)))


def number_in(value: Column, text: Column) -> Column:
    """Whether the number stands in the flat text by itself, not as a part of a longer one."""
    at = lambda s: F.concat(F.when(s.contains(","), F.lit(r"(?<![\d.])")).otherwise(F.lit(r"(?<![\d.,])")), F.lit(r"\Q"), s, F.lit(r"\E(?!\d)(?![,.]\d)"))
    return F.exists(spellings(value), lambda s: F.regexp(text, at(s)))


def any_in(names: Column, text: Column) -> Column:
    """Whether one of the names, flat and not empty, stands in the flat text."""
    return F.exists(names, lambda a: (flat(a) != "") & text.contains(flat(a)))


def locator_in(locator: Column, text: Column) -> Column:
    """Whether a text names the page of a locator 'p. N', or holds the first six characters of any other."""
    page = F.regexp_extract(locator, r"p\.?\s*(\d+)", 1)
    named = F.concat(F.lit(r"(?i)(?<!\d)"), page, F.lit(r"\s*(?:쪽|페이지|p)|p\.?\s*"), page, F.lit(r"(?!\d)"))
    key = F.substring(flat(F.regexp_replace(locator, r"(?U)[§·\s]+", "")), 1, 6)
    return F.when(page != "", F.regexp(text, named)).otherwise((key != "") & flat(text).contains(key))
