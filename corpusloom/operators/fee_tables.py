"""Fee rows from the texts of documents: tables in Markdown, and summaries whose cells have run into lines.

A text becomes a list of lines that know their cells and which of them are numbers; a table is a stretch of lines of one
width behind a line that names a class column. Null and empty texts give no rows; repeated texts give their rows each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of heads and labels, signs of no value, account types by the end of a code.
CLASS, KIND, TOTAL, PEER, FRONT, SALES, COST = "클래스", "종류", "총보수", "동종유형", "판매수수료", "판매보수", "비용"
MARKERS = ("클래스", "수수료선취", "수수료미징구", "지급비율")
LABEL_WORDS = ("수수료", "미징구", "선취", "후취", "오프라인", "온라인", "퇴직", "연금")
NO_VALUE = ("", "-", "–", "없음", "실비", "해당없음")
ACCOUNTS = {"P": "연금저축", "PE": "연금저축", "P2": "퇴직연금", "P2E": "퇴직연금"}
SPLICED = "없음|투자비용"
# Forms of numbers, codes and notes.
NUMBER_CELL = re.compile(r"-?\d[\d,]*\.?\d*\s*%?")
NUMBER_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?%?")
RULE = re.compile(r"\|?[\s:|-]+\|?")
BRACKETED = re.compile(r"[(（]([A-Za-z0-9가-힣\-]+)[)）]\s*$")
NESTED = re.compile(r"[(（]([A-Za-z0-9\-]+)[(（]")
LEADING = re.compile(r"^([A-Za-z0-9\-]{1,8})[(（]")
SUMMARY_CODE = re.compile(r"[(（]([A-Za-z][A-Za-z0-9]{0,3}(?:-[A-Za-z0-9가-힣]{1,6})?)[)）(（]")
NOTE = re.compile(r"[(（]?주\d|※")
#: Lines of a head at most, the first among them; letters of a label that goes on; such lines in a row.
HEAD, SHORT, STRAYS = 8, 20, 4
#: A fee in percent is within these; anything else was misread.
LEAST, MOST = 0.0, 10.0


def bare(text: str) -> str:
    return re.sub(r"\s+", "", text)


def cells(line: str) -> list[str]:
    """A Markdown row's cells, trimmed; the empty ones before the first bar and behind the last are none."""
    parts = [c.strip() for c in line.split("|")]
    return parts[not parts[0] : len(parts) - (len(parts) > 1 and not parts[-1])]


def is_rule(line: str) -> bool:
    return "-" in line and RULE.fullmatch(line) is not None


def is_number(cell: str) -> bool:
    return NUMBER_CELL.fullmatch(cell.strip()) is not None


def number(text: str | None) -> float | None:
    """The first number; null for the signs of no value."""
    plain = (text or "").strip().replace(",", "")
    found = None if plain in NO_VALUE else re.search(r"-?\d+\.?\d*", plain)
    return float(found[0]) if found else None


def numeric_tail(tokens: list[str]) -> list[str]:
    """The numbers and dashes that a line ends with."""
    n = sum(1 for _ in takewhile(lambda t: t == "-" or NUMBER_TOKEN.fullmatch(t), reversed(tokens)))
    return tokens[len(tokens) - n :]


def is_cost(token: str) -> bool:
    return token == "-" or (NUMBER_TOKEN.fullmatch(token) is not None and "." not in token)


def is_rate(token: str) -> bool:
    return token == "-" or ("." in token and (v := number(token)) is not None and LEAST <= v <= MOST)


def row_label(row: list[str], at: int) -> str:
    """The cell of the class column, or else the first that is filled before the first number."""
    if at < len(row) and row[at]:
        return row[at]
    return next((c for c in takewhile(lambda c: not is_number(c), row) if c), "")


def is_class_label(label: str) -> bool:
    return 0 < len(label) <= 40 and not label.startswith(("*", "※", "주")) and BRACKETED.search(bare(label)) is not None


def class_code(label: str) -> str | None:
    """The code in a label: before an inner bracket, in the last bracket (no word of Hangul), or before the first."""
    clean = bare(label)
    last = BRACKETED.search(clean)
    found = NESTED.search(clean) or (last if last and not re.search("[가-힣]{2}", last[1]) else None) or LEADING.search(clean)
    return found[1] if found else None


def account_type(label: str, code: str | None) -> str | None:
    clean = re.sub(SPLICED, "", bare(label))
    for words, kind in ((("퇴직연금",), "퇴직연금"), (("연금저축", "개인연금"), "연금저축"), (("퇴직",), "퇴직연금")):
        if any(w in clean for w in words):
            return kind
    short = (code or "").upper().replace("-", "")
    return next((kind for end, kind in ACCOUNTS.items() if code and short.endswith(end)), None)


def channel(label: str, code: str | None) -> str | None:
    clean, short = bare(label), (code or "").upper().replace("-", "")
    named = next((w for w in ("온라인슈퍼", "온라인", "오프라인") if w in clean), None)
    by_code = "온라인슈퍼" if short.startswith("S") else "온라인" if short.endswith("E") else "오프라인" if short.endswith(("P", "P2")) else None
    return named or by_code


@dataclass
class Line:
    row: list[str]
    numbers: int

    @classmethod
    def of(cls, text: str) -> Line:
        row = cells(text)
        return cls(row, sum(map(is_number, row)))

    def anchor(self) -> tuple[int, bool] | None:
        """(class column, whether labels are codes without brackets) where the line opens a table."""
        heads = [bare(c) for c in self.row]
        for test, plain in ((lambda h: CLASS in h, False), (lambda h: h == KIND, True)):
            at = next((k for k, h in enumerate(heads) if test(h)), None)
            if at is not None:
                return at, plain
        return None


def columns_of(head: list[list[str]], at: int) -> dict[str, int | None] | None:
    """Which column holds what, by the innermost words of the head and by all of them; null without a total fee."""
    inner = [bare(next((c for c in reversed(column) if c), "")) for column in zip(*head)]
    every = [bare("".join(column)) for column in zip(*head)]
    first = lambda test: next((k for k in range(len(inner)) if test(k)), None)
    total = lambda words: first(lambda k: k != at and TOTAL in words[k] and COST not in words[k] and PEER not in every[k] and FRONT not in every[k])
    fee = total(inner)
    fee = total(every) if fee is None else fee
    if fee is None:
        return None
    return {
        "total": fee, "front": first(lambda k: FRONT in inner[k]), "sales": first(lambda k: SALES in inner[k]), "peer": first(lambda k: PEER in inner[k]),
        "cost": first(lambda k: k != fee and TOTAL in inner[k] and COST in inner[k]),
    }


def body_of(lines: list[Line], at: int, plain: bool) -> tuple[list[tuple[str, list[str]]], int]:
    """(label, cells) of the data rows, and how many lines they took. A line without numbers goes on with the label
    before it while that has not closed its bracket; more than STRAYS such lines, or a longer text, end the table."""
    rows: list[tuple[str, list[str]]] = []
    strays = 0
    for used, line in enumerate(lines):
        label = row_label(line.row, at)
        if line.numbers:
            rows.append((label, line.row))
            strays = 0
            continue
        if not 0 < len(label) <= SHORT:
            return rows, used
        if rows and not plain and not re.search(r"[)）]\s*$", rows[-1][0]):
            rows[-1] = ((rows[-1][0] + label).strip(), rows[-1][1])
        strays += 1
        if strays > STRAYS:
            return rows, used
    return rows, len(lines)


def tables_of(text: str) -> Iterator[tuple[dict, bool, list[tuple[str, list[str]]]]]:
    """(columns, whether labels are bare codes, rows) of every table with a total fee."""
    lines = [Line.of(x) for x in text.split("\n") if not is_rule(x)]
    at = 0
    while at < len(lines):
        opened = lines[at].anchor()
        if opened is None:
            at += 1
            continue
        same = list(takewhile(lambda x: len(x.row) == len(lines[at].row), lines[at:]))
        head = [same[0], *takewhile(lambda x: x.numbers < 2, same[1:HEAD])]
        columns = columns_of([x.row for x in head], opened[0])
        at += len(head)
        if columns:
            rows, used = body_of(same[len(head) :], *opened)
            at += used
            if rows:
                yield columns, opened[1], rows


def summaries_of(text: str) -> Iterator[dict]:
    """Rows of a summary: a line that ends with four rates and five whole costs, its label above it, and its code in the
    line or in at most two below."""
    lines = [x.strip() for x in text.split("\n")]
    tails = [numeric_tail(x.split()) for x in lines]
    is_fee = [len(t) >= 9 and all(map(is_cost, t[-5:])) and all(map(is_rate, t[-9:-5])) for t in tails]
    above: list[str] = []
    skip = 0
    for i, line in enumerate(lines):
        if i < skip:
            continue
        if not is_fee[i]:
            names = line and len(line) <= 40 and not NOTE.match(line) and (any(w in line for w in LABEL_WORDS) or SUMMARY_CODE.search(line))
            above = [*above, line][-3:] if names else []
            continue
        tokens = line.split()
        own = tokens[: len(tokens) - len(tails[i])]
        skip = i + 1
        while not SUMMARY_CODE.search(bare("".join(own))) and skip < min(len(lines), i + 3):
            below = lines[skip]
            if not below or len(below) > 40 or NOTE.match(below) or len(tails[skip]) >= 9:
                break
            own.append(below)
            skip += 1
        code = SUMMARY_CODE.search(bare(" ".join(own)))
        if code:
            free = any("없음" in x for x in [*tokens, *own])
            rates = [number(x) for x in tails[i][-9:-5]]
            yield {"label": " ".join(above + own).strip(), "code": code[1], "front": "없음" if free else "-" if "-" in tails[i][:-9] else None, "rates": rates}
        above = []


def rows_of(text: str) -> Iterator[dict]:
    """The fee rows of one text; fees outside 0 to 10 percent are misread and left out."""
    get = lambda row, k: row[k] if k is not None and k < len(row) else None
    found = []
    for columns, plain, rows in tables_of(text):
        for label, row in rows:
            if plain or is_class_label(label):
                code = bare(label) if plain and not class_code(label) else class_code(label)
                found.append({"label": label, "code": code, "front": get(row, columns["front"]) or None, "rates": [number(get(row, columns[c])) for c in ("total", "sales", "peer", "cost")]})
    for r in [*found, *summaries_of(text)]:
        if r["code"] and r["rates"][0] is not None and LEAST <= r["rates"][0] <= MOST:
            yield {
                "class_label": r["label"], "class_code": r["code"], "account_type": account_type(r["label"], r["code"]), "channel": channel(r["label"], r["code"]), "front_load_text": r["front"],
                **dict(zip(("fee_total", "fee_distribution", "fee_peer_avg", "fee_total_cost"), r["rates"])),
            }


FEES = "class_label string, class_code string, account_type string, channel string, front_load_text string, fee_total double, fee_distribution double, fee_peer_avg double, fee_total_cost double"


def may_hold_fees(text: Column) -> Column:
    """The cheap gate before parsing: the word for a total fee, and one of the marks of a fee table, whatever the blanks."""
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    some = F.lit(False)
    for m in MARKERS:
        some = some | flat.contains(m)
    return F.coalesce(flat.contains(TOTAL) & some, F.lit(False))


def fee_rows(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key and FEES: a row for each fee row of each chunk (key, text)."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEES.split(", ")]
        kinds = [pa.string()] * 5 + [pa.float64()] * 4
        for batch in batches:
            found = [(k, r) for k, t in zip(batch.column(0), batch.column(1).to_pylist()) for r in rows_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in found], batch.schema.field(0).type), *(pa.array([r[n] for _, r in found], t) for n, t in zip(names, kinds))], [key, *names])

    return chunks.filter(may_hold_fees(F.col("text"))).select(key, "text").mapInArrow(run, f"{key} {kind}, {FEES}")
