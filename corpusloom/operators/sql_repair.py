"""Repairs of generated SELECT statements over a fee table, before they run: a statement is cut at its top level, and
predicates are replaced, never guessed at. Statements that a rule does not fit come back as they are."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Columns, words and forms that the rules look for.
FEE_COLUMNS = ("fund_name", "class_code", "account_type", "channel", "fee_total", "page")
RATES = ("fee_total", "fee_distribution", "fee_peer_avg", "fee_total_cost")
CLASS_CODE = re.compile(r"(?<![0-9A-Za-z])[ABCRSJ][0-9]?(?:-[A-Za-z][0-9]?[a-z]?)?[a-z]?(?![0-9A-Za-z])")
SUPERLATIVE = re.compile(r"(?:가장|제일)\s*(?:싼|낮|비싼|높|저렴)|최저|최고|최소|최대|저렴한\s*순|비싼\s*순|순위|정렬")
AGGREGATE = re.compile(r"\b(?:MIN|MAX|AVG|SUM|COUNT|GROUP_CONCAT)\s*\(|\bGROUP\s+BY\b", re.I)
SPLICED, JOINED_BLANK = re.compile("없음|투자비용"), re.compile(r"(?<=[가-힣\-])\s+(?=[가-힣])")
ALWAYS = "1=1"
#: What the top level is read by: strings and brackets as wholes, words, and the rest sign by sign.
TOKEN = re.compile(r"'(?:[^']|'')*'|\w+|.", re.S)


def _top(sql: str) -> list[tuple[str, int, int]]:
    """(word, start, end), upper case, of the words outside brackets and strings."""
    out, depth = [], 0
    for m in TOKEN.finditer(sql):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth and re.match(r"\w", m[0]):
            out.append((m[0].upper(), m.start(), m.end()))
    return out


def split_top(text: str, word: str) -> list[str]:
    """The parts between a word (AND, OR) that stands outside brackets and strings; blank parts are none."""
    cuts = [(s, e) for w, s, e in _top(text) if w == word.upper()]
    starts, ends = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)]
    return [p for s, e in zip(starts, ends) if (p := text[s:e].strip())]


@dataclass
class Parts:
    """A statement up to and with WHERE, its conditions, and what follows them."""

    head: str
    where: str
    tail: str

    @classmethod
    def of(cls, sql: str) -> Parts | None:
        words = _top(sql)
        begin = next((e for w, _, e in words if w == "WHERE"), None)
        if begin is None:
            return None
        after = [(w, s) for w, s, _ in words if s >= begin]
        end = next((s for (w, s), (x, _) in zip(after, [*after[1:], ("", 0)]) if w in ("LIMIT", "HAVING") or (w in ("ORDER", "GROUP") and x == "BY")), len(sql))
        return cls(sql[:begin], sql[begin:end], sql[end:])


def branches(sql: str) -> tuple[str, list[str], str] | None:
    """(head, conditions of each fund, tail) of a comparison: conditions joined by OR, or such in brackets beside common
    ones, which go to each. Null for aggregates, and unless every condition names a fund."""
    parts = None if AGGREGATE.search(sql) else Parts.of(sql)
    if not parts:
        return None
    named = lambda conditions: len(conditions) > 1 and all("fund_name" in c.lower() for c in conditions)
    whole = split_top(parts.where, "OR")
    if named(whole):
        return parts.head, whole, parts.tail
    common = split_top(parts.where, "AND")
    for i, term in enumerate(common):
        if term[:1] == "(" and term[-1:] == ")" and named(inner := split_top(term[1:-1], "OR")):
            return parts.head, [" AND ".join([*common[:i], f"({c})", *common[i + 1 :]]) for c in inner], parts.tail
    return None


def literals(sql: str, column: str) -> list[str]:
    """The strings that a column is compared with, by = or IN."""
    lists = re.findall(rf"\b{column}\s*(?:=|IN\s*\()\s*((?:'(?:[^']|'')*'[\s,]*)+)", sql, re.I)
    return [x.replace("''", "'") for part in lists for x in re.findall(r"'((?:[^']|'')*)'", part)]


def _neutral(sql: str, column: str) -> str:
    """Comparisons of the column with strings hold always; IS NULL stays."""
    return re.sub(rf"\b{column}\s*(?:=\s*'(?:[^']|'')*'|IN\s*\((?:[^')]|'(?:[^']|'')*')*\))", ALWAYS, sql, flags=re.I)


def compares(sql: str) -> bool:
    """Whether several funds or classes are asked for at once."""
    several = lambda column: re.search(rf"\b{column}\s+IN\s*\(", sql, re.I) and len(literals(sql, column)) > 1
    return bool(branches(sql) or several("fund_name") or several("class_code"))


def without_limit(sql: str) -> str:
    """A comparison's LIMIT would hide one side; it goes."""
    parts = Parts.of(sql)
    if not parts or not compares(sql):
        return sql
    tail = re.sub(r"(?i)\bLIMIT\s+\d+\b", "", parts.tail)
    return f"{parts.head}{parts.where}{tail}".strip()


def names_class(question: str) -> bool:
    return "클래스" in question or CLASS_CODE.search(question) is not None


def without_invented_class(sql: str, question: str) -> str:
    """A class that the question does not name is no condition."""
    return sql if names_class(question) else _neutral(sql, "class_code")


def without_account(sql: str) -> str:
    """The last rung before giving up on no rows."""
    return _neutral(sql, "account_type")


def account_in_class(sql: str, kinds: dict[str, str]) -> str:
    """An account word in a class condition becomes an account condition; kinds maps words without blanks to account
    types. A list that mixes both becomes their OR, in brackets."""

    def moved(m: re.Match) -> str:
        values = re.findall(r"'((?:[^']|'')*)'", m[0])
        accounts = [kinds[k] for v in values if (k := re.sub(r"\s+", "", v)) in kinds]
        classes = [v for v in values if re.sub(r"\s+", "", v) not in kinds]
        if not accounts:
            return m[0]
        some = lambda column, xs: f"{column} = '{xs[0]}'" if len(xs) == 1 else f"{column} IN ({', '.join(f"'{x}'" for x in xs)})"
        account = some("account_type", list(dict.fromkeys(accounts)))
        return f"({account} OR {some('class_code', classes)})" if classes else account

    return re.sub(r"\bclass_code\s*(?:=\s*'(?:[^']|'')*'|IN\s*\((?:[^')]|'(?:[^']|'')*')*\))", moved, sql, flags=re.I)


def widened(sql: str, question: str) -> str:
    """A plain fee query without a class, an account or a superlative shows every class and channel of what it finds."""
    head = re.match(r"\s*SELECT\s+(.*?)\s+FROM\s", sql, re.I | re.S)
    columns = head[1].lower() if head else ""
    narrow = names_class(question) or SUPERLATIVE.search(question) or literals(sql, "class_code") or re.search(r"\baccount_type\s*=\s*'", sql, re.I)
    if narrow or "fee_total" not in columns or ("class_code" in columns and "channel" in columns):
        return sql
    wide = f"SELECT DISTINCT {', '.join(FEE_COLUMNS)}{sql[head.end(1) :]}"
    parts = Parts.of(wide)
    return f"{parts.head}{parts.where.rstrip()} ORDER BY channel, account_type, fee_total" if parts else wide


def is_concept(sql: str, question: str, signals: tuple[str, ...], rows: int) -> bool:
    """Whether rows should be withheld: the statement names no fund and the question neither compares, sorts nor sums up
    (has none of the signals), so that it asks for an idea, not for rows."""
    parts = Parts.of(sql)
    where = parts.where.lower() if parts else ""
    return bool(rows) and "fund_name" not in where and "fund_code" not in where and not re.search(r"\bkr\d[a-z0-9]{9,11}\b", where) and not any(s in question.lower() for s in signals)


def clean_label(label: str) -> str:
    """For display: words that slipped in from other cells go, then blanks between Hangul."""
    return JOINED_BLANK.sub("", SPLICED.sub("", label))


def as_table(rows: list[dict], columns: list[str]) -> str:
    """Rows as lines of cells; rates with a percent sign, four digits that count."""

    def cell(name: str, value) -> str:
        if isinstance(value, float):
            return f"{value:.4g}" + "%" * (name in RATES)
        return "" if value is None else clean_label(value) if name == "class_label" and isinstance(value, str) else str(value)

    return "\n".join(" | ".join(x) for x in [columns, *([cell(c, r.get(c)) for c in columns] for r in rows)])


def merged(parts: list[list[dict]], most: int = 50) -> list[dict]:
    """The rows of several statements, each once, in order, at most so many."""
    once = {tuple(sorted((k, repr(v)) for k, v in r.items())): r for rows in reversed(parts) for r in reversed(rows)}
    return list(reversed(once.values()))[:most]


# How far behind its fund a class may stand (looked for at once, at most), and the shape of the new statement.
AT_ONCE, AT_MOST = 15, 30
REBUILT = "SELECT fund_name, class_code, fee_total, front_load_text, page FROM fund_fees WHERE {} ORDER BY fee_total ASC LIMIT 50"


def funds_in(question: str, short: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, full name) of known short names of three letters or more, in order; the longer takes a place first."""
    taken = bytearray(len(question))
    out = []
    for name in sorted((n for n in short if len(n) >= 3), key=lambda n: (-len(n), n)):
        place = question.find(name)
        span = slice(place, place + len(name))
        if place >= 0 and not any(taken[span]):
            taken[span] = b"\1" * len(name)
            out.append((span.start, span.stop, short[name]))
    return sorted(out)


def _classes(codes: list[str], least: int) -> re.Pattern | None:
    longest_first = sorted({c for c in codes if len(c) >= least}, key=lambda c: (-len(c), c))
    return re.compile(rf"(?<![A-Za-z0-9-])(?:{'|'.join(map(re.escape, longest_first))})(?![A-Za-z0-9-])") if longest_first else None


def rebuilt(question: str, short: dict[str, str], codes: list[str]) -> str | None:
    """A statement made of the funds and classes that a question names, for when the generated one found no rows. A class
    goes to the fund that ends last before it. Codes of one letter count only right behind a fund, as names hold letters
    too. Null unless two funds or two classes are named, as there is nothing to compare then."""
    funds, anywhere, any_code = funds_in(question, short), _classes(codes, 2), _classes(codes, 1)
    seen = [(m.start(), m[0]) for m in anywhere.finditer(question)] if anywhere else []
    at_once = [(end, m[0]) for _, end, _ in funds if any_code and (m := any_code.search(question[end : end + AT_ONCE])) and all(end != p for p, _ in seen)]
    asked: dict[str, set[str]] = {}
    for place, code in sorted(seen + at_once):
        end, fund = max(((e, f) for _, e, f in funds if e <= place), default=(-AT_MOST - 1, ""))
        if place - end <= AT_MOST and fund:
            asked.setdefault(fund, set()).add(code.strip().upper().replace("-", "").replace(" ", ""))
    if sum(map(len, asked.values())) < 2:
        return None

    def condition(fund: str, classes: set[str]) -> str:
        literals = [f"'{c}'" for c in sorted(classes)]
        wanted = f"= {literals[0]}" if len(literals) == 1 else f"IN ({', '.join(literals)})"
        return f"(fund_name = '{fund.replace("'", "''")}' AND UPPER(REPLACE(class_code,'-','')) {wanted})"

    return REBUILT.format(" OR ".join(condition(f, c) for f, c in asked.items()))


def census(codes: list[str | None], accounts: dict[str | None, int], width: int = 58) -> tuple[str, str]:
    """What a prompt says of the table as it is now: the class codes, in lines that end once they pass a width, without
    codes that a neighbouring cell slipped into; and the rows of each account type, those without one last."""
    real = sorted({c for c in codes if c and not SPLICED.search(c)})
    lines: list[str] = []
    for c in real:
        lines[-1:] = [f"{lines[-1]}, {c}"] if lines and len(lines[-1]) <= width else [*lines[-1:], c]
    kinds = [f"'{k}'({n}행)" for k, n in sorted((k, n) for k, n in accounts.items() if k)]
    return ",\n".join(lines), ", ".join([*kinds, f"NULL({accounts.get(None, 0)}행)"])


def attempted(question: str, generate, run, most: int = 2) -> tuple[list, list[str]]:
    """(rows, trace) of a generated statement. generate takes the question and the attempts before, as (statement, fault),
    and run gives rows; a fault is told to the next attempt, and after the last there are no rows, so that the answer
    comes from the search alone."""
    before: list[tuple[str, str]] = []
    while len(before) < most:
        sql = ""
        try:
            sql = generate(question, tuple(before))
            return list(run(sql)), [f"attempt {i + 1}: {fault}" for i, (_, fault) in enumerate(before)]
        except Exception as e:  # noqa: BLE001  whatever is wrong with a statement is told to its writer
            before.append((sql, f"{type(e).__name__}: {e}"))
    return [], [f"attempt {i + 1}: {fault}" for i, (_, fault) in enumerate(before)]


def rebuilt_each(question: Column, short: dict[str, str], codes: list[str]) -> Column:
    """rebuilt() of a column; null questions give null."""

    @F.pandas_udf(StringType())
    def run(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: None if q is None else rebuilt(q, short, codes))

    return run(question)
