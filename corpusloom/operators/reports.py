"""Reports on runs and on tables: failures, changes, stability, tokens, answers against points, a table's values, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scoring import FALLBACK

# From which share on a question counts as answered, up to which as not, and what counts as a change.
ANSWERED, UNANSWERED, CHANGED = 0.999, 0.001, 0.01
# How a trace states its tokens; letters of an answer that hold its conclusion; words of not knowing.
TOKENS = r"토큰: 입력 ([\d,]+) \+ 출력 ([\d,]+) = ([\d,]+) \(HCX 호출 (\d+)회\)"
CONCLUSION = 250
UNSURE = ("확인되지 않", "확인할 수 없", "찾지 못", "정보가 없", "자료에 없", "포함되어 있지 않", "알 수 없", "제공되지 않", "언급되어 있지 않", "나와 있지 않", "확인이 어렵")
# Words that ask for the lowest and for the highest.
LOWEST = ("가장 싼", "가장 낮은", "가장 저렴", "싼 순", "낮은 순", "저렴한 순", "제일 싼", "제일 낮은", "제일 저렴", "최저")
HIGHEST = ("가장 비싼", "가장 높은", "비싼 순", "높은 순", "제일 비싼", "최고")
# Signs inside a name that do not count, a name with a number, mentions that make a number known.
NAME_SIGNS, SERIES, MENTIONS = r"(?U)[\s·,/\-]", r"[가-힣A-Za-z]{3,}\d{3,4}(?!\d)", 5
LONGEST_NAME = 20


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.lit("|".join(words)))


def infra_reason(answer: Column, error: Column, status: Column) -> Column:
    """Why an answer tells nothing of the system's knowledge: 'empty', 'error: …' (60 letters), 'HTTP n', 'fallback'; else
    null. A null status is that of a run without HTTP."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(text == "", F.lit("empty")).when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), F.substring(error, 1, 60)))
        .when(status.isNotNull() & (status != 200), F.concat(F.lit("HTTP "), status.cast("string"))).when(text.startswith(FALLBACK), F.lit("fallback"))
    )


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """question_id, delta, direction, was, is: what two runs (question_id, answer_cov, state) that both have a question
    say of it; a null share is none at all."""
    share = lambda side: F.coalesce(F.col(f"{side}.answer_cov"), F.lit(0.0))
    delta = share("n") - share("b")
    both = now.alias("n").join(before.alias("b"), "question_id")
    direction = F.when(delta > CHANGED, "up").when(delta < -CHANGED, "down").otherwise("same")
    return both.select("question_id", delta.alias("delta"), direction.alias("direction"), F.col("b.state").alias("was"), F.col("n.state").alias("is"))


def spread(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, sd (of a sample; of one run 0), low, high over runs, a row each with the metrics as columns."""
    long = runs.unpivot([], metrics, "metric", "value") if len(metrics) > 1 else runs.select(F.lit(metrics[0]).alias("metric"), F.col(metrics[0]).alias("value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def stability(runs: DataFrame) -> DataFrame:
    """question_id, kind over all runs (question_id, answer_cov): answered in each 'good', in none 'bad', else 'flaky'."""
    share = F.coalesce("answer_cov", F.lit(0.0))
    kind = F.when(F.bool_and(share >= ANSWERED), "good").when(F.bool_and(share < UNANSWERED), "bad").otherwise("flaky")
    return runs.groupBy("question_id").agg(kind.alias("kind"))


def tokens_of(runs: DataFrame) -> DataFrame:
    """runs (question_id, trace, seconds) that state their tokens: question_id, prompt, completion, total, calls, seconds."""
    count = lambda i: F.replace(F.regexp_extract("trace", TOKENS, i), F.lit(","), F.lit("")).cast("long")
    told = runs.filter(F.regexp_like("trace", F.lit(TOKENS)))
    return told.select("question_id", *(count(i).alias(n) for i, n in enumerate(("prompt", "completion", "total", "calls"), 1)), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def token_report(used: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row: sums over tokens_of(), means for each question and call, tokens a minute, and what share of each limit
    (name to tokens a minute) that is. Ratios without a base are null."""
    sums = used.agg(F.count("*").alias("questions"), *(F.sum(c).alias(c) for c in ("prompt", "completion", "total", "calls", "seconds")))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    rate = F.try_divide(F.col("total") * F.lit(60.0), F.col("seconds"))
    return sums.select("*", ratio("total", "questions").alias("each"), ratio("total", "calls").alias("call"), rate.alias("minute"), *((rate / n).alias(f"of_{k}") for k, n in limits.items()))


def heaviest(used: DataFrame, most: int = 5) -> DataFrame:
    return used.orderBy(F.desc("total"), "question_id").limit(most)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s,]", "")


def _found(points: Column, plain: Column) -> Column:
    """The points that stand in a plain text; a point is alternatives between bars, and a blank one is none."""
    return F.filter(points, lambda p: F.exists(F.split(p, r"\|"), lambda a: (_plain(a) != "") & plain.contains(_plain(a))))


def answer_checks(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """question_id, answer_ok, context_ok, warnings, admits of gold (question_id, covered, points, wrong) that has a run
    (question_id, answer, context). ok: all points stand there. warnings: wrong marks in the answer's opening, unless all
    points stand in it, as exceptions behind a right answer are no faults. A question that the corpus does not cover has
    admits alone: whether the answer says that it does not know."""
    none = F.array().cast("array<string>")
    both = gold.join(runs, "question_id").withColumns({"_a": _plain(F.col("answer")), "_c": _plain(F.col("context")), "_p": F.coalesce("points", none)})
    whole = lambda text: F.size(_found(F.col("_p"), F.col(text))) == F.size("_p")
    opening = _plain(F.substring("answer", 1, CONCLUSION))
    marked = F.filter(F.coalesce("wrong", none), lambda w: opening.contains(_plain(w)))
    warnings = F.when(whole("_a") & (F.size("_p") > 0), none).otherwise(marked)
    admits = F.exists(F.array(*(F.lit(u) for u in UNSURE)), lambda u: F.col("_a").contains(_plain(u)))
    covered = F.coalesce("covered", F.lit(True))
    return both.select("question_id", F.when(covered, whole("_a")).alias("answer_ok"), F.when(covered, (F.col("_c") != "") & whole("_c")).alias("context_ok"), F.when(covered, warnings).alias("warnings"), F.when(~covered, admits).alias("admits"))


def census(rows: DataFrame, counted: str, listed: str) -> DataFrame:
    """kind, value, n: rows of each value of counted, null among them, and the values of listed with their length, by which
    they are tried, the longer first."""
    return rows.groupBy(F.lit(counted).alias("kind"), F.col(counted).cast("string").alias("value")).agg(F.count("*").alias("n")).unionByName(
        rows.filter(F.col(listed).isNotNull()).select(F.lit(listed).alias("kind"), F.col(listed).cast("string").alias("value")).distinct().withColumn("n", F.length("value").cast("long")))


def superlatives(rows: DataFrame, question: str, value: str, order: list[str]) -> DataFrame:
    """rows (qid, question, …) with place: by value upwards if the question asks for the lowest, downwards if for the
    highest, in the order given if for neither; nulls come last either way."""
    sign = F.when(_any(F.col(question), LOWEST), 1).when(_any(F.col(question), HIGHEST), -1)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last(F.col(value) * sign), *order))
    return rows.withColumn("place", place)


def _numbered(text: Column) -> Column:
    runs = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), NAME_SIGNS, ""), F.lit(SERIES), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.right(F.regexp_replace(r, r"\d+$", ""), F.lit(LONGEST_NAME)).alias("family"), F.regexp_extract(r, r"\d+$", 0).alias("number")))


def series(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """family, number, name: numbered names (name), and numbers that chunks (text) give a known family MENTIONS times, under
    the family's name and the number; fewer may be names of the past. Of names that share family and number the least."""
    named = names.select("name", F.explode(_numbered(F.col("name"))).alias("s")).groupBy("s.family", "s.number").agg(F.min("name").alias("name"))
    said = chunks.select(F.explode(_numbered(F.col("text"))).alias("s")).groupBy(F.col("s.family").alias("run"), F.col("s.number").alias("number")).agg(F.count("*").alias("n"))
    # a run of letters may hold more than a name: its longest ending that is a family counts
    endings = said.select("run", "number", "n", F.explode(F.transform(F.sequence(F.lit(3), F.length("run")), lambda k: F.right(F.col("run"), k))).alias("family"))
    met = endings.join(named.select("family").distinct(), "family").groupBy("run", "number").agg(F.max_by("family", F.length("family")).alias("family"), F.first("n").alias("n"))
    often = met.groupBy("family", "number").agg(F.sum("n").alias("n")).filter(F.col("n") >= MENTIONS)
    new = often.join(named, ["family", "number"], "left_anti").select("family", "number", F.concat("family", "number").alias("name"))
    return named.unionByName(new)


def trips(calls: DataFrame, who: str, order: str, failed: Column, threshold: int = 2) -> DataFrame:
    """who, begin, n: stretches of failed calls on end that reach the threshold, at which a breaker opens."""
    per = Window.partitionBy(who).orderBy(order)
    marked = calls.select(who, order, F.coalesce(failed, F.lit(False)).alias("_f"), F.sum((~F.coalesce(failed, F.lit(False))).cast("int")).over(per).alias("_g"))
    return marked.filter("_f").groupBy(who, "_g").agg(F.min(order).alias("begin"), F.count("*").alias("n")).filter(F.col("n") >= threshold).drop("_g")


def owner_ranks(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """qid, variant, rank: where the owning document (qid, owner) first stands among hits (qid, variant, owner, rank); null
    where a variant's hits lack it, so that a filter which loses the document is seen."""
    tried = owners.join(hits.select("variant").distinct(), F.lit(True))  # variants are few: the filters tried
    return tried.join(hits, ["qid", "variant", "owner"], "left").groupBy("qid", "variant").agg(F.min("rank").alias("rank"))


#: Bytes of a question set that are hashed as one text; a larger one is none.
MOST_QUESTIONS = 64 << 20


def fingerprint(questions: DataFrame) -> DataFrame:
    """The SHA-256 of questions (place, question_id, question) as one JSON list in order of place, with sorted keys and no
    blanks; nulls are null. ValueError if they are too many to be a question set."""
    size = questions.agg(F.sum(F.octet_length(F.coalesce("question", F.lit(""))) + 64)).scalar()
    if (questions.sparkSession.range(1).select(size).first()[0] or 0) > MOST_QUESTIONS:
        raise ValueError("too many questions for one fingerprint")
    one = F.struct("place", F.struct("question", "question_id").alias("q"))
    rows = questions.agg(F.sort_array(F.collect_list(one)).alias("x"))
    return rows.select(F.sha2(F.to_json(F.transform("x", lambda r: r["q"]), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
