"""Scores of answers against a gold set, by weighted requirements, sources and places; and reports on runs.

Gold: question_id, required (type 'number' or 'text', values, alts, weight, evidence), sources (file, aliases, locator),
contradiction_phrases. Runs: question_id, answer, retrieved_context, sources (as text), error, http_status. A question
without a run is MISSING_FROM_RUN with scores of zero; null lists are empty; shares without a base are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import any_in, flat, locator_in, number_in

GOLD = "question_id string, required array<struct<type:string,values:array<double>,alts:array<string>,weight:double,evidence:boolean>>, sources array<struct<file:string,aliases:array<string>,locator:string>>, contradiction_phrases array<string>"
# An answer that begins so is a fallback; what an answer must have.
FALLBACK = "답변 생성에 실패"
FIELDS = ("question_id", "question", "answer", "retrieved_context", "trace")
SLOW = 240.0
# Shares of accuracy, retrieval, citation and grounding in the composite, and of sources and places in citation.
ACCURACY, RETRIEVAL, CITATION, GROUNDING = 0.5, 0.2, 0.15, 0.15
SOURCES, PLACES = 2 / 3, 1 / 3


def _met(req: Column, text: Column) -> Column:
    of_number = F.exists(F.coalesce(req["values"], F.array().cast("array<double>")), lambda v: number_in(v, text))
    return F.when(req["type"] == "number", of_number).otherwise(any_in(F.coalesce(req["alts"], F.array().cast("array<string>")), text))


def _weight(reqs: Column, test) -> Column:
    return F.aggregate(reqs, F.lit(0.0), lambda s, r: s + F.when(test(r), F.coalesce(r["weight"], F.lit(1.0))).otherwise(F.lit(0.0)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def scored(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """question_id, state, answer_cov, retrieval_cov, grounding, source_recall, locator_recall, contradictions."""
    has = lambda c, kind="string": F.col(c).cast(kind) if c in runs.columns else F.lit(None).cast(kind)
    run = runs.select("question_id", F.lit(True).alias("_ran"), F.coalesce(has("answer"), F.lit("")).alias("_a"), F.coalesce(has("retrieved_context"), F.lit("")).alias("_c"), F.coalesce(has("sources"), F.lit("")).alias("_s"), has("error").alias("_e"), has("http_status", "int").alias("_h"))
    both = gold.join(run, "question_id", "left").withColumn("_fa", flat(F.col("_a"))).withColumn("_fc", flat(F.col("_c"))).withColumn("_cited", F.concat_ws("\n", "_s", "_c", "_a"))
    reqs = F.coalesce("required", F.array().cast(gold.schema["required"].dataType))
    checked = F.transform(reqs, lambda r: F.struct(r["weight"].alias("weight"), F.coalesce(r["evidence"], F.lit(False)).alias("evidence"), _met(r, F.col("_fa")).alias("said"), _met(r, F.col("_fc")).alias("read")))
    files = F.coalesce("sources", F.array().cast(gold.schema["sources"].dataType))

    def place(s: Column) -> Column:
        stem = lambda n: F.regexp_replace(F.regexp_replace(n, r".*/", ""), r"(?<=.)\.[^.]*$", "")
        names = F.concat(F.array(s["file"]), F.coalesce(s["aliases"], F.array().cast("array<string>")))
        found = any_in(F.filter(F.concat(names, F.transform(names, stem)), lambda n: n.isNotNull()), flat(F.col("_cited")))
        where = F.trim(F.coalesce(s["locator"], F.lit("")))
        return F.struct(found.alias("found"), (where != "").alias("has"), (found & (where != "") & locator_in(where, F.col("_cited"))).alias("at"))

    wide = both.withColumn("_r", checked).withColumn("_p", F.transform(files, place))
    count = lambda c, test: F.size(F.filter(c, test)).cast("double")
    r, p = F.col("_r"), F.col("_p")
    ran = F.coalesce("_ran", F.lit(False))
    scores = {
        "answer_cov": F.coalesce(_share(_weight(r, lambda x: x["said"]), _weight(r, lambda x: F.lit(True))), F.lit(0.0)),
        "retrieval_cov": _share(_weight(r, lambda x: x["evidence"] & x["read"]), _weight(r, lambda x: x["evidence"])),
        "grounding": _share(_weight(r, lambda x: x["evidence"] & x["said"] & x["read"]), _weight(r, lambda x: x["evidence"] & x["said"])),
        "source_recall": _share(count(p, lambda x: x["found"]), F.size(p)),
        "locator_recall": _share(count(p, lambda x: x["at"]), count(p, lambda x: x["has"])),
    }
    phrases = F.coalesce("contradiction_phrases", F.array().cast("array<string>"))
    contra = F.size(F.filter(phrases, lambda x: (flat(x) != "") & F.col("_fa").contains(flat(x))))
    failed = (F.trim("_a") == "") | (F.coalesce("_e", F.lit("")) != "") | (F.coalesce("_h", F.lit(200)) != 200) | F.trim("_a").startswith(FALLBACK)
    done = wide.select("question_id", ran.alias("_ok"), failed.alias("_f"), contra.alias("contradictions"), *(F.when(ran, v).otherwise(F.lit(0.0)).alias(k) for k, v in scores.items()))
    cov = F.col("answer_cov")
    state = F.when(~F.col("_ok"), "MISSING_FROM_RUN").when(F.col("_f"), "INFRA_FAIL").when(F.col("contradictions") > 0, "CONTRADICTION_REVIEW").when(cov >= 0.999, "AUTO_CORRECT").when(cov > 0, "PARTIAL_REVIEW").otherwise("SEMANTIC_REVIEW")
    return done.select("question_id", state.alias("state"), *scores, F.when(F.col("_ok"), F.col("contradictions")).otherwise(0).alias("contradictions"))


def composite(scores: DataFrame) -> DataFrame:
    """rows and the composite of scored() in one row. Nulls count in no mean, a mean of nothing is zero, and answers that
    failed for the service's sake count in all means but grounding's."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    cited = mean("source_recall") * SOURCES + mean("locator_recall") * PLACES
    grounded = mean(F.when(F.col("state") != "INFRA_FAIL", F.col("grounding")))
    return scores.agg(F.count("*").alias("rows"), (mean("answer_cov") * ACCURACY + mean("retrieval_cov") * RETRIEVAL + cited * CITATION + grounded * GROUNDING).alias("composite"))


def group_means(scores: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and size of each group, the best first."""
    return scores.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("rows")).orderBy(F.desc("mean"), key)


def source_recall(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, pages (share of gold pages among the evidence's), funds (share of funds), from rows (question_id,
    fund, page); a question without evidence has zero."""
    pages = gold.select("question_id", "fund", "page").distinct()
    by_page = evidence.select("question_id", "fund", "page").distinct().withColumn("_p", F.lit(1))
    by_fund = evidence.select("question_id", "fund").distinct().withColumn("_f", F.lit(1))
    met = pages.join(by_page, ["question_id", "fund", "page"], "left").join(by_fund, ["question_id", "fund"], "left")
    return met.groupBy("question_id").agg((F.count("_p") / F.count("*")).alias("pages"), (F.count("_f") / F.count("*")).alias("funds"))


def failure_history(runs: DataFrame) -> DataFrame:
    """question_id and the runs (run_id) in which it failed, in order."""
    return runs.filter("failed").groupBy("question_id").agg(F.sort_array(F.collect_set("run_id")).alias("runs"))


def problems(responses: DataFrame) -> DataFrame:
    """responses with the list of what is wrong: absent or null fields, fields that are no strings, a status other than
    200, a slow answer."""
    strings = {f.name for f in responses.schema if f.dataType.simpleString() == "string"}
    found = [F.lit(f"missing {c}") if c not in responses.columns else F.when(F.col(c).isNull(), F.lit(f"null {c}")) if c in strings else F.lit(f"not a string: {c}") for c in FIELDS]
    if "http_status" in responses.columns:
        found.append(F.when(F.coalesce("http_status", F.lit(0)) != 200, F.lit("status")))
    if "elapsed_sec" in responses.columns:
        found.append(F.when(F.col("elapsed_sec") > SLOW, F.lit("slow")))
    return responses.withColumn("problems", F.array_compact(F.array(*found)))


def opening_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id and the text of its first chunk, by page and ordinal; chunks without a page come last."""
    return chunks.groupBy("doc_id").agg(F.min_by("text", F.struct(F.col("page").isNull(), "page", "ordinal")).alias("text"))


def capped(evidence: DataFrame, key: str, order: str, most: int = 4) -> DataFrame:
    """The first `most` rows of each question and key."""
    place = F.row_number().over(Window.partitionBy("qid", key).orderBy(order))
    return evidence.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def compared(hits: DataFrame, named: DataFrame, pool: int = 12) -> DataFrame:
    """For questions that name two funds or more (qid, fund) the best of each fund's hits (qid, fund, chunk_id, rank), as
    many as fit evenly and two at least, one fund after another in the order of names; other questions have no row."""
    asked = named.distinct().withColumn("n", F.count("*").over(Window.partitionBy("qid"))).filter("n >= 2")
    place = F.row_number().over(Window.partitionBy("qid", "fund").orderBy("rank"))
    best = hits.join(asked, ["qid", "fund"]).withColumn("of_fund", place).filter(F.col("of_fund") <= F.greatest(F.lit(2), F.floor(F.lit(pool) / F.col("n"))))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("fund", "of_fund"))).select("qid", "chunk_id", "fund", "rank")


def aliases_in(question: Column, aliases: Column) -> Column:
    """The aliases (array of strings) that stand in a question where no longer one does, by place, as structs (at, alias).
    Each counts where it stands first; of equally long ones the first in the order of letters."""
    spans = F.filter(F.transform(F.array_distinct(aliases), lambda a: F.struct((-F.length(a)).alias("size"), a.alias("alias"), F.instr(question, a).alias("at"))), lambda s: (s["at"] > 0) & (s["size"] < 0))
    free = lambda taken, s: ~F.exists(taken, lambda t: (s["at"] < t["at"] - t["size"]) & (t["at"] < s["at"] - s["size"]))
    none = F.filter(spans, lambda s: F.lit(False))
    kept = F.aggregate(F.sort_array(spans), none, lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken))
    return F.sort_array(F.transform(kept, lambda s: F.struct(s["at"].alias("at"), s["alias"].alias("alias"))))


def renamed(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows under new ids (old_id, new_id); rows without a new id keep theirs."""
    return rows.join(ids.select(F.col("old_id").alias(key), "new_id"), key, "left").withColumn(key, F.coalesce("new_id", key)).drop("new_id")


def swap_report(old: DataFrame, new: DataFrame, expected: int, key: str = "chunk_id") -> dict[str, object]:
    """Checks before a new version takes an old one's place: the counts, ids that stand twice, ids on one side only."""
    ids = lambda df: df.select(key)
    n = new.count()
    out = {"old": old.count(), "new": n, "repeated": n - ids(new).distinct().count(), "only_old": ids(old).exceptAll(ids(new)).count(), "only_new": ids(new).exceptAll(ids(old)).count()}
    return out | {"ready": n == expected and not out["repeated"]}
