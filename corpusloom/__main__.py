"""python -m corpusloom: index and search a corpus, build its fee table, ask an adapter a set of questions, serve one, run a
registered query. Tables are Parquet; each command says what columns it reads."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import engine, serving
from .operators import index
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *arguments: str, **options: dict) -> None:
        one = commands.add_parser(name, help=about)
        for a in arguments:
            one.add_argument(a)
        for option, how in options.items():
            one.add_argument("--" + option.replace("_", "-"), **how)

    add("index", "write a keyword index of chunks (chunk_id, text), unless the one there is current", "chunks", "index")
    add("search", "the chunks that a question finds in an index", "index", "question", k={"type": int, "default": 5}, chunks={"help": "show their texts"}, json={"action": "store_true"})
    add("fees", "write the fee table of chunks (chunk_id, text, perhaps fund_code) and what was skipped", "chunks", "out")
    add("finish", "write the final corpus and print its report against the chunks before", "before", "final", "out")
    add("ask", "answers of an adapter, module:function, to questions (question_id, question)", "questions", "adapter", "out")
    add("serve", "serve an adapter, module:function, of (question, question_id)", "adapter", port={"type": int, "default": 8000}, host={"default": "127.0.0.1"})
    add("query", "run a registered query over a folder of tables", "name", "folder", out={"help": "write Parquet instead of showing"})
    return top


def _shown(rows: DataFrame, as_json: bool = False) -> None:
    """A screenful: reports and results of a search, which are small by their making, or the head of a query's rows."""
    if as_json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        rows.show(50, truncate=100)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "serve":
        serving.server(engine.loaded(a.adapter), a.port, a.host, responses=serving.Responses()).serve_forever()
        return
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    read = spark.read.parquet
    if a.command == "index":
        print("written" if index.ensure(read(a.chunks), a.index) else "current")
    elif a.command == "search":
        found = index.search(spark.createDataFrame([(0, a.question)], "qid int, text string"), a.index, a.k).drop("qid")
        _shown((found.join(read(a.chunks).select("chunk_id", "text"), "chunk_id") if a.chunks else found).orderBy("rank"), a.json)
    elif a.command == "fees":
        _shown(sinks.write_fees(read(a.chunks), a.out))
    elif a.command == "finish":
        sinks.write_final(read(a.final), a.out)
        _shown(sinks.final_report(read(a.before), read(a.out)).orderBy("name"))
    elif a.command == "ask":
        engine.answered(read(a.questions), a.adapter).write.mode("overwrite").parquet(a.out)
    else:
        from .plans.registry import QUERIES

        rows = QUERIES[a.name](spark, a.folder)
        rows.write.mode("overwrite").parquet(a.out) if a.out else _shown(rows)


if __name__ == "__main__":
    main()
