"""Relational work on a fee-like table: identity, copies, conflicts, guarded and relaxed queries, calculators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a query must not contain; replace() as a function is allowed.
DENIED = ("insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "pragma", "vacuum", "merge", "truncate", "grant", "revoke", "exec")
LIMIT = 50
#: A quoted string or name, a comment, or any other sign.
PIECE = re.compile(r"""(?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<comment>--[^\n]*|/\*.*?(?:\*/|$))|(?P<plain>.)""", re.S)


def outside_quotes(sql: str) -> str:
    """sql with the insides of its strings and quoted names left out."""
    return PIECE.sub(lambda m: m[0][0] * 2 if m["quoted"] else m[0], sql)


def uncommented(sql: str) -> str:
    """sql without comments; what looks like one inside quotes stays."""
    return PIECE.sub(lambda m: " " if m["comment"] else m[0], sql)


def fenced(answer: str) -> str:
    """The statement of an answer: what stands in its first fenced block, or all of it."""
    found = re.search(r"```(?:sql)?\s*(.*?)```", answer, re.S | re.I)
    return (found[1] if found else answer).strip()


def checked(sql: str) -> str:
    """One plain SELECT, with a LIMIT put on where it has none; ValueError otherwise. Words inside quotes are not looked
    at, and the statement's strings stay as they are."""
    sql = uncommented(fenced(sql)).strip().rstrip(";").strip()
    bare = outside_quotes(sql).lower()
    if not re.match(r"select\b", bare):
        raise ValueError("not a SELECT")
    denied = re.search(rf"\b(?:{'|'.join(DENIED)})\b|\breplace\b(?!\s*\()", bare)
    if denied:
        raise ValueError(f"not allowed: {denied[0].upper()}")
    if ";" in bare:
        raise ValueError("several statements")
    return sql if re.search(r"\blimit\b", bare) else f"{sql} LIMIT {LIMIT}"


def absorbed(rows: DataFrame, code: str, same: list[str]) -> DataFrame:
    """Drops rows without a code that have a sibling with one; nulls equal nulls."""
    coded = rows.filter(F.col(code).isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in same)).distinct()
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    bare = rows.filter(F.col(code).isNull()).join(coded, match, "left_anti")
    return rows.filter(F.col(code).isNotNull()).unionByName(bare)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys (none null) with several values."""
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return rows.filter(usable).groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.min(value).alias("least"), F.max(value).alias("most")).filter("values > 1")


def relaxed(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Zero-row ladder for names (qid, want) against names (name): exact, then without spaces and case, then the core
    without what stands in brackets, the last only where one name matches. Gives qid, rung, matches."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    core = lambda c: flat(F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)", ""))
    known = names.select(F.col("name")).distinct()
    by = lambda rung, f: asked.select("qid", f(F.col("want")).alias("_k")).join(known.select(f(F.col("name")).alias("_k")), "_k").groupBy("qid").agg(F.count("*").alias("matches")).withColumn("rung", F.lit(rung))
    steps = by(0, lambda c: c).unionByName(by(1, flat)).unionByName(by(2, core).filter("matches = 1"))
    best = steps.groupBy("qid").agg(F.min_by("matches", "rung").alias("matches"), F.min("rung").alias("rung"))
    return asked.join(best, "qid", "left").select("qid", F.coalesce("rung", F.lit(9)).alias("rung"), F.coalesce("matches", F.lit(0)).alias("matches"))


def withdrawal_limit(value: Column, year: Column) -> Column:
    """value / (11 - year) * 1.2; null for years under 1 (not eligible) and from 11 (no limit)."""
    return F.when(year.between(1, 10), value / (11 - year) * 1.2)


def tax_credit(pension: Column, other: Column, rate: Column, cap_pension: float, cap_all: float) -> Column:
    return F.least(F.least(pension, F.lit(cap_pension)) + other, F.lit(cap_all)) * rate


def bracket(rows: DataFrame, value: str, brackets: DataFrame) -> DataFrame:
    """rows with the bracket (lo, hi, label) that holds value; brackets is a short list."""
    return rows.join(F.broadcast(brackets), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left").drop("lo", "hi")


def threshold(value: Column, steps: list[int]) -> Column:
    """The highest of a short list of thresholds that value reaches; null below all."""
    return F.array_max(F.filter(F.array(*(F.lit(s).cast("long") for s in steps)), lambda s: s <= value))


def stored(asked: DataFrame, values: DataFrame) -> DataFrame:
    """asked (want) with the stored values (value) that begin so; a word that none begins with stays as it is."""
    known = values.distinct()
    return asked.join(known, F.startswith("value", "want"), "left").select("want", F.coalesce("value", "want").alias("stored"))


def branches(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """branch, n: how many rows each branch of a disjunction has, zeros too, in one scan."""
    counts = rows.agg(*(F.count_if(c).alias(str(i)) for i, c in enumerate(conditions)))
    return counts.unpivot([], [str(i) for i in range(len(conditions))], "branch", "n").select(F.col("branch").cast("int").alias("branch"), "n")


def without_blank(rows: DataFrame, hidden: tuple[str, ...] = ("chunk_id", "source_path")) -> DataFrame:
    """rows without columns that are null or blank throughout (0 is not blank), and without hidden ones."""
    shown = [c for c in rows.columns if c not in hidden]
    filled = rows.agg(*(F.bool_or(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in shown)).first()
    return rows.select(*(c for c in shown if filled[c]))


def missing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Asked (family, number) that are not known although the family has two members or more."""
    known = known.distinct()
    families = known.groupBy("family").agg(F.count("*").alias("n")).filter("n >= 2")
    return asked.join(families, "family", "left_semi").join(known, ["family", "number"], "left_anti")


def nearest_before(rows: DataFrame, key: str, at: str, mark: Column, code: Column, most: int) -> DataFrame:
    """at, mark: for each code the last mark of its key before it, if at most `most` away."""
    before = F.last(F.when(mark, F.col(at)), ignorenulls=True).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_m", before).filter(code).select(at, F.when(F.col(at) - F.col("_m") <= most, F.col("_m")).alias("mark"))
