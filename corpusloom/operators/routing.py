"""Safety gate and keyword routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits

# \s as in the reference's patterns, which are Unicode: Java's \s is ASCII only without (?U); digits too
RESIDENT = r"(?U)\d{6}[-\s]?[1-4]\d{6}"
CARD = r"(?U)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}"
ACCOUNT = r"(?U)계좌\s?번호"
DASHED = r"(?U)\d{2,}-\d{2,}(?:-\d{2,})?"
MARKERS = [
    "이전 지시", "이전 지침", "시스템 프롬프트", "system prompt", "지시사항을 무시", "규칙을 무시", "규칙을 잊", "ignore previous",
    "ignore all previous", "지금부터 너는", "역할을 무시", "jailbreak", "너는 이제부터", "프롬프트를 출력", "지시문을 출력", "내부 지침",
]


def personal(text: Column) -> Column:
    return text.rlike(RESIDENT) | text.rlike(CARD) | (text.rlike(ACCOUNT) & text.rlike(DASHED))


def injected(text: Column) -> Column:
    return hits(text, MARKERS) > 0


def gate(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds blocked: personal data first, then injection, else null."""
    return questions.withColumn("blocked", F.when(personal(F.col(text)), "personal").when(injected(F.col(text)), "injection"))


def routed(questions: DataFrame, first: list[str], second: list[str], text: str = "text") -> DataFrame:
    """Counts hints of two kinds and decides by the routing table: a side's own type, both, or neither."""
    counted = questions.withColumn("n_first", hits(F.col(text), first)).withColumn("n_second", hits(F.col(text), second))
    a, b = F.col("n_first"), F.col("n_second")
    kind = F.when((a >= 2) & (b == 0), "first").when((b >= 2) & (a == 0), "second")
    return counted.withColumn("route", kind).withColumn("hybrid", ((a >= 1) & (b >= 1)) | ((a == 1) & (b == 0)))
