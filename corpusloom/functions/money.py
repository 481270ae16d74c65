"""Korean amounts, years and conditions of calculator questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of amounts in won, the starting age, and the words and patterns of a limit question.
UNITS = {"조": 1_000_000_000_000, "억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000, "원": 1}
START_AGE = 55
VALUE_WORD = "평가액"
TOPICS = ["연금수령한도", "얼마까지", "얼마나 받을 수", "수령할 수 있는", "받을 수 있나요", "받을 수 있는지"]
AMOUNT = r"([0-9]+(?:\.[0-9]+)?)\s*(조|억|천만|백만|만|원)"
ASKED_AMOUNT = r"[0-9]+(?:[.,][0-9]+)?\s*(?:조|억|천만|백만|만)\s*원?"
ASKED_TIME = r"[0-9]{2}\s*세|[0-9]+\s*년\s*차|[0-9]+\s*년째"


def won(text: Column) -> Column:
    """The sum of all amounts in won; null where there is none. A thousands' comma does not count."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    size = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    parts = F.zip_with(F.regexp_extract_all(plain, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(plain, F.lit(AMOUNT), F.lit(2)), lambda n, u: n.cast("double") * F.element_at(size, u))
    return F.when(F.size(parts) > 0, F.rint(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).cast("long"))


def year(text: Column) -> Column:
    """The year of drawing: as stated, else counted from an age (0 below the starting age); null where neither is given."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    age = found(r"([0-9]{2})\s*세")
    return F.coalesce(found(r"([0-9]+)\s*년\s*차"), found(r"([0-9]+)\s*년째"), F.when(age.isNotNull(), F.greatest(age - (START_AGE - 1), F.lit(0))))


def won_text(amount: Column) -> Column:
    """Hundred millions, ten thousands and single won, empty parts left out; nothing at all is 0원, and null stays null."""
    big, middle, small = F.floor(amount / 100_000_000), F.floor(amount % 100_000_000 / 10_000), amount % 10_000
    grouped = lambda c: F.format_number(c, 0)
    parts = F.concat_ws(" ", F.when(big > 0, F.concat(big.cast("string"), F.lit("억"))), F.when(middle > 0, F.concat(grouped(middle), F.lit("만원"))), F.when(small > 0, F.concat(grouped(small), F.lit("원"))))
    return F.when(amount.isNotNull(), F.when(parts == "", "0원").otherwise(parts))


def needs_limit(text: Column) -> Column:
    """Whether a question gives a value, an amount, an age or year, and asks for a limit."""
    topic = F.lit(False)
    for word in TOPICS:
        topic = topic | text.contains(word)
    return text.contains(VALUE_WORD) & text.rlike(ASKED_AMOUNT) & text.rlike(ASKED_TIME) & topic


def transfer_credit(amount: Column, base: int, rate: float, cap: int) -> Column:
    """The base, and the share of the amount up to the cap."""
    return (F.lit(base) + F.least(F.floor(amount * rate), F.lit(cap))).cast("long")
