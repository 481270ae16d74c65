"""Where a phrase stands in an answer, however it is spaced, and whether that place can be trusted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

# Signs between sentences, and words that deny what stands before them.
BORDERS = ".!?\n•"
DENIALS = ("아닙", "아니라", "불가", "없습니다", "없음", "않습니다", "않음", "제외", "확인할 수 없")
TAIL = 30
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("crosses", BooleanType()), StructField("denied", BooleanType())]))


def spans(phrase: str | None, text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) in the text of each place that equals the phrase when white space and case are left out, leftmost
    first, without overlaps. Null or blank on either side: none."""
    chars = np.array(list(text or ""), dtype=object)
    at = np.flatnonzero([not c.isspace() for c in chars])
    # a letter may become several in lower case, so each sign of the flat text knows the letter that it came from
    lower = [c.lower() for c in chars[at]]
    origin = np.repeat(at, [len(c) for c in lower])
    wanted = "".join((phrase or "").lower().split())
    for m in re.finditer(re.escape(wanted), "".join(lower)) if wanted else ():
        yield int(origin[m.start()]), int(origin[m.end() - 1]) + 1


@F.pandas_udf(SPANS)
def _audited(phrases: pd.Series, texts: pd.Series) -> pd.Series:
    def one(phrase, text) -> list[dict]:
        found = []
        for start, end in spans(phrase, text):
            after = text[end : end + TAIL]
            found.append({"start": start, "end": end, "crosses": any(c in BORDERS for c in text[start:end]), "denied": any(d in after for d in DENIALS)})
        return found

    return pd.Series([one(p, t) for p, t in zip(phrases, texts)])


def audited(phrase: Column, text: Column) -> Column:
    """SPANS of the phrase in the text, in code points: crosses, if a sentence's border lies inside; denied, if one of
    DENIALS stands within TAIL signs behind. Spark has no map from a flat text back to its source, hence Arrow batches."""
    return _audited(phrase, text)
