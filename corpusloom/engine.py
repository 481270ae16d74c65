"""How parts are plugged together: settings, functions by name, stages, and adapters that answer questions."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.retrieval import dummy_embedding

#: Fields of an answer; an adapter that fails gives them too.
FIELDS = ("question_id", "question", "answer", "sources", "trace")


@dataclass(frozen=True)
class Settings:
    """Where a retriever finds its data."""

    chunks: str
    index: str
    vectors: str | None = None
    fees: str | None = None


def loaded(name: str) -> Callable:
    """The function of 'module:function'; ValueError for another form, ImportError or AttributeError if it is not there."""
    module, mark, function = name.partition(":")
    if not (module and mark and function):
        raise ValueError(f"not module:function: {name}")
    return getattr(importlib.import_module(module), function)


#: Embedders by name: from a text column to an array column.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"dummy": dummy_embedding}


def embedder(name: str) -> Callable[[Column], Column]:
    return loaded(name) if ":" in name else EMBEDDERS[name]


def through(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df after every stage, in order; one plan, which Catalyst sees as a whole."""
    for stage in stages:
        df = df.transform(stage)
    return df


def answered(questions: DataFrame, adapter: str) -> DataFrame:
    """FIELDS of every question (question_id, question) by an adapter, 'module:function' from a question to a text or to
    a dict of fields. What an adapter raises becomes the trace of an empty answer, so that a run is always whole. A null
    question is asked as the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = loaded(adapter)

        def one(key, text) -> tuple:
            text = text or ""
            try:
                got = ask(text)
                got = got if isinstance(got, dict) else {"answer": got}
            except Exception as e:  # noqa: BLE001  an adapter's fault is its answer's
                got = {"trace": f"{type(e).__name__}: {e}"}
            return (key, text, *("" if got.get(f) is None else str(got[f]) for f in FIELDS[2:]))

        for pdf in batches:
            yield pd.DataFrame([one(k, t) for k, t in zip(pdf["question_id"], pdf["question"])], columns=list(FIELDS))

    rows = questions.select(F.col("question_id").cast("string").alias("question_id"), F.col("question").cast("string").alias("question"))
    return rows.mapInPandas(run, ", ".join(f"{f} string" for f in FIELDS))
