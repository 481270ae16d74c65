"""Share-class labels: code, account and channel, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import no_space

# Account words and code endings, channel words, words that line breaks put into labels, cells without a number, and code patterns.
SAVINGS, RETIREMENT = "연금저축", "퇴직연금"
ENDINGS = {"P": SAVINGS, "PE": SAVINGS, "P2": RETIREMENT, "P2E": RETIREMENT}
CHANNELS = ["온라인슈퍼", "온라인", "오프라인"]
SPLICED = "없음|투자비용"
NO_NUMBER = ["", "-", "–", "없음", "실비", "해당없음"]
NESTED = r"[(（]([A-Za-z0-9\-]+)[(（]"
CLOSING = r"[(（]([A-Za-z0-9가-힣\-]+)[)）]$"
OPENING = r"^([A-Za-z0-9\-]{1,8})[(（]"


def code(label: Column) -> Column:
    """A code before a nested parenthesis, else the closing one if it is no Hangul word, else one that opens the label."""
    plain = no_space(label)
    found = lambda pattern: F.nullif(F.regexp_extract(plain, pattern, 1), F.lit(""))
    last = found(CLOSING)
    return F.coalesce(found(NESTED), F.when(~last.rlike("[가-힣]{2,}"), last), found(OPENING))


def is_label(label: Column) -> Column:
    """A class label ends in a parenthesised code and is neither a note nor over 40 characters long."""
    return F.coalesce(~label.rlike(r"^(\*|※|주)") & (F.length(label) <= 40) & no_space(label).rlike(CLOSING), F.lit(False))


def account(label: Column, class_code: Column) -> Column:
    plain, bare = F.regexp_replace(no_space(label), SPLICED, ""), F.upper(F.replace(class_code, F.lit("-"), F.lit("")))
    kind = F.when(plain.contains("퇴직연금"), RETIREMENT).when(plain.rlike("연금저축|개인연금"), SAVINGS).when(plain.contains("퇴직"), RETIREMENT)
    for ending, value in ENDINGS.items():
        kind = kind.when(bare.endswith(ending), value)
    return kind


def channel(label: Column, class_code: Column) -> Column:
    plain, bare = no_space(label), F.upper(F.replace(class_code, F.lit("-"), F.lit("")))
    over, online, offline = CHANNELS
    kind = F.when(plain.contains(over), over).when(plain.contains(online), online).when(plain.contains(offline), offline)
    return kind.when(bare.startswith("S"), over).when(bare.endswith("E"), online).when(bare.rlike("P2?$"), offline)


def rate(cell: Column) -> Column:
    """The first signed decimal of a cell; null for a blank, a dash or a word for nothing."""
    plain = F.trim(F.replace(cell, F.lit(","), F.lit("")))
    return F.when(~plain.isin(NO_NUMBER), F.nullif(F.regexp_extract(plain, r"-?[0-9]+\.?[0-9]*", 0), F.lit("")).cast("double"))
