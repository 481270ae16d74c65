"""Evidence for and in answers: formatting, references, citations, grades, notices, titles. Null texts count as empty."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# A document without a name, signs of a grade, of a citation, and of where a title ends.
SHARED = "공통"
GRADE_WORD = "투자위험등급"
GRADE_ASKED = r"위험|안정|안전|보수적|공격|(?<!투자)등급|리스크"
CITATION = r"\([^()\n]*(?:\d+\s*쪽|p\.\s*\d+|·)[^()\n]*\)"
TITLE_STOP = re.compile(r"[■●▶]|\d{4}\.\s?\d{1,2}\.\s?\d{1,2}|\s\d+\.\s*|\s가\.\s|제\s?\d+\s?부|\?|:")
TITLE_END = re.compile(r"(.{4,26}?(?:안내|개요|가이드|FAQ|매뉴얼|정리|체크 포인트|서비스|업무|기본))(?:\s|$)")
TITLE_EDGE = " -·[]#:,"
EVIDENCE = "array<struct<fund_name:string,doc_id:string,page:int,section:string,base_date:string,text:string>>"


def _who(e: Column) -> Column:
    return F.coalesce(F.nullif(e["fund_name"], F.lit("")), F.nullif(e["doc_id"], F.lit("")), F.lit(SHARED))


def _if(value: Column, before: str, after: str = "") -> Column:
    filled = value.isNotNull() & (value.cast("string") != "") & (value.cast("string") != "0")
    return F.when(filled, F.concat(F.lit(before), value.cast("string"), F.lit(after))).otherwise(F.lit(""))


def formatted(evidence: Column) -> Column:
    """Numbered pieces of evidence (EVIDENCE): who, page, section and date in a head line, then the text."""
    one = lambda e, i: F.concat(F.lit("[근거 "), (i + 1).cast("string"), F.lit("] "), _who(e), _if(e["page"], " ", "쪽"), _if(e["section"], " · "), _if(e["base_date"], " (기준일 ", ")"), F.lit("\n"), F.coalesce(e["text"], F.lit("")))
    return F.array_join(F.transform(F.coalesce(evidence, F.array().cast(EVIDENCE)), one), "\n\n")


def expanded(answer: Column, evidence: Column) -> Column:
    """References like [근거 3] as (who, page or section) of that piece; numbers without a piece stay as they are."""
    label = lambda e: F.concat(F.lit("("), _who(e), F.when(_if(e["page"], "") != "", _if(e["page"], " ", "쪽")).otherwise(_if(e["section"], " · ")), F.lit(")"))
    held = F.coalesce(evidence, F.array().cast(EVIDENCE))
    numbered = F.transform(held, lambda e, i: F.struct((i + 1).alias("n"), label(e).alias("label")))
    safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    return F.aggregate(numbered, answer, lambda text, x: F.regexp_replace(text, F.concat(F.lit(r"\[근거\s*0*"), x["n"].cast("string"), F.lit(r"\]")), safe(x["label"])))


@F.pandas_udf(StringType())
def without_repeats(answers: pd.Series) -> pd.Series:
    """In a run of citations side by side each stands once, with a comma between."""
    run = re.compile(rf"{CITATION}(?:\s*,?\s*{CITATION})+")
    return answers.map(lambda a: None if a is None else run.sub(lambda m: ", ".join(dict.fromkeys(re.findall(CITATION, m[0]))), a))


def grade_notes(questions: DataFrame, evidence: DataFrame, grades: DataFrame, most: int = 4) -> DataFrame:
    """qid, fund, note for questions (qid, text) that ask about risk: the grade (fund, grade) of each fund in their evidence
    (qid, fund, fund_name, text, rank) that the evidence does not state, the first `most` by rank."""
    asked = questions.filter(F.col("text").rlike(GRADE_ASKED)).select("qid")
    funds = evidence.filter("fund is not null").groupBy("qid", "fund").agg(F.min("rank").alias("rank"), F.min_by("fund_name", F.when(F.col("fund_name") != "", F.col("rank"))).alias("name"), F.bool_or(F.coalesce(F.col("text").contains(GRADE_WORD), F.lit(False))).alias("stated"))
    new = funds.filter("not stated").join(asked, "qid", "left_semi").join(grades, "fund")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "fund"))
    note = F.concat(F.lit("[확정] "), F.coalesce("name", "fund"), F.lit("("), "fund", F.lit(f") {GRADE_WORD}: "), "grade")
    return new.withColumn("_n", place).filter(F.col("_n") <= most).select("qid", "fund", note.alias("note"))


def noticed(answer: Column, notice: Column, said: list[str], channel: Column, named: list[str]) -> Column:
    """An answer with the notice before it unless it says so already, and the channel behind it unless it names one; a
    null notice leaves the answer as it is."""
    some = lambda words: F.lit(False) if not words else F.array_contains(F.array(*(F.contains(answer, F.lit(w)) for w in words)), True)
    body = F.regexp_replace(answer, r"^\s*(\[답변\]\s*)?(아닙니다|아니요|아니오|아뇨)[.!]?\s*", "")
    first = F.when(some(said), answer).otherwise(F.concat(notice, F.lit("\n\n"), body))
    return F.when(notice.isNull(), answer).otherwise(F.when(some(named), first).otherwise(F.concat(F.rtrim(first), F.lit("\n\n"), channel)))


def disclaimed(answer: Column, asks_advice: Column, sentence: str, mark: str) -> Column:
    """With a disclaimer behind an answer to a question for advice, unless the mark stands in it."""
    return F.when(asks_advice & (answer != "") & ~answer.contains(mark), F.concat(F.rtrim(answer), F.lit("\n\n" + sentence))).otherwise(answer)


def _head_once(title: str) -> str:
    """Up to where the first four letters come again, if that is 6 to 30 letters on."""
    letters = [i for i, c in enumerate(title) if not c.isspace()]
    flat = "".join(title[i] for i in letters)
    again = flat.find(flat[:4], 4) if len(flat) >= 4 else -1
    return title[: letters[again]].strip() if 6 <= again <= 30 else title


def made_title(text: str | None, noise: str = r"\[?업무매뉴얼\]?") -> str:
    """A title of at most 26 letters from a document's opening: noise and marks go, a stop sign or a closing word ends it."""
    title = re.sub(noise, " ", " ".join((text or "").split()))
    title = TITLE_STOP.split(re.sub(r"^[#■●▶\-·\s\[\]]+", "", title))[0].strip()
    closed = TITLE_END.match(title)
    return (closed[1] if closed else _head_once(title)).strip(TITLE_EDGE)[:26].rstrip(" -·,")


def clean_title(title: str | None) -> str:
    """A title of at most 30 letters, cut at a blank behind the tenth if there is one."""
    out = _head_once(" ".join((title or "").split()))
    blank = out.rfind(" ", 10, 30)
    return (out if len(out) <= 30 else out[: blank if blank >= 0 else 30]).strip(" -·,")


def report(means: list[tuple[str, float, int]], title: str, width: int = 20) -> str:
    """Markdown with a bar for each group (name, mean of 0 to 1, rows)."""
    rows = [f"| {name} | {n} | {mean:.1%} | {'█' * round(mean * width)} |" for name, mean, n in means]
    return "\n".join([f"## {title}", "", "| group | rows | mean | |", "|---|---|---|---|", *rows])


# What a fund's name loses in a label, the label of its paper, the look of a fund's code, words that tell texts apart.
NAME_EXTRAS = r"\(.*?\)|제?\d+호|증권(전환형)?(모|자)?투자신탁"
PROSPECTUS, SHARED_TERMS = "투자설명서", "공통 조항"
CODED = r"^KR[0-9A-Z]{8,}$"
TELLING = r"([가-힣A-Za-z]{4,}|\d+(?:\.\d+)?)"
SOURCES = "※ 근거:"


def label(fund_name: Column, doc_id: Column, title: Column) -> Column:
    """A document's name for people: the fund's without legal words, else its title, else what its id says. A null counts
    as empty."""
    given = lambda c: F.nullif(c, F.lit(""))
    short = F.trim(F.regexp_replace(fund_name, NAME_EXTRAS, ""))
    of_fund = F.when(given(fund_name).isNotNull(), F.trim(F.concat(short, F.lit(" " + PROSPECTUS))))
    return F.coalesce(of_fund, given(title), F.when(F.regexp_like(doc_id, F.lit(CODED)), F.lit(PROSPECTUS)), given(doc_id), F.lit(SHARED_TERMS))


def _shared_words(text: Column, answer: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TELLING), F.lit(1)))
    return F.size(F.filter(words, lambda w: (F.length(w) >= 2) & answer.contains(w)))


def source_line(evidence: Column, answer: Column, named: Column | None = None, most: int = 4) -> Column:
    """The line of sources behind an answer: labels of the evidence that the answer draws on, each once, in its order.
    Evidence: array of structs of EVIDENCE's fields and title. Drawn on are pieces of which the answer has three telling
    words, and two fifths of the best piece's; where no piece is, the two best. named: from a fund's name to whether the
    question names it; if it names any, other funds' papers are no source. Without evidence: the empty string."""
    if named is not None:
        of_fund = lambda e: F.coalesce(e["fund_name"], F.lit("")) != ""
        asked = lambda e: of_fund(e) & F.coalesce(named(e["fund_name"]), F.lit(False))
        evidence = F.when(F.exists(evidence, asked), F.filter(evidence, lambda e: ~of_fund(e) | asked(e))).otherwise(evidence)
    plain = F.regexp_replace(F.substring_index(F.coalesce(answer, F.lit("")), SOURCES, 1), r"(?U)\s", "")
    page = lambda e: _if(e["page"], " ", "쪽")
    weighed = F.transform(evidence, lambda e, i: F.struct((-_shared_words(e["text"], plain)).alias("n"), i.alias("i"), F.concat(label(e["fund_name"], e["doc_id"], e["title"]), page(e)).alias("label")))
    best = F.array_min(F.transform(weighed, lambda w: w["n"]))
    drawn = F.filter(weighed, lambda w: (w["n"] <= -3) & (w["n"] <= best * 0.4))
    kept = F.when(F.size(drawn) > 0, drawn).otherwise(F.slice(F.array_sort(weighed), 1, 2))
    labels = F.slice(F.array_distinct(F.transform(kept, lambda w: w["label"])), 1, most)
    return F.when(F.size(labels) > 0, F.concat(F.lit(f"\n\n{SOURCES} "), F.array_join(labels, " · "))).otherwise(F.lit(""))


def composed(question: Column, computed: Column, rows: Column, pieces: Column, notes: Column, asks: tuple[str, str, str], extra: tuple[tuple[Column, str], ...] = ()) -> Column:
    """What a generator is given: results that are certain come first (computed values, rows, pieces of evidence, notes;
    blank ones are left out), then the question and the instruction of the first kind there is (asks: for computed values,
    for rows, for evidence alone), then each extra sentence whose condition holds. Null if there is nothing to answer from,
    so that no generator need be asked; notes alone are nothing."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    blocks = F.concat_ws("\n\n", *(some(c) for c in (computed, rows, pieces, notes)))
    ask = F.when(some(computed).isNotNull(), F.lit(asks[0])).when(some(rows).isNotNull(), F.lit(asks[1])).when(some(pieces).isNotNull(), F.lit(asks[2]))
    more = (F.when(F.coalesce(condition, F.lit(False)), F.lit(sentence)) for condition, sentence in extra)
    return F.when(ask.isNotNull(), F.concat(blocks, F.lit("\n\n"), F.coalesce(question, F.lit("")), F.lit("\n\n"), F.concat_ws(" ", ask, *more)))


def of_document(code: Column, owner: Column, shared: Column) -> Column:
    """Whether a chunk belongs to a document: by its own code, or as one of the ids that share it. Nulls: no."""
    return F.coalesce(owner == code, F.lit(False)) | F.coalesce(F.array_contains(shared, code), F.lit(False))
