"""Batch question answering: cache, then retrieval and reranking, context, and a given generator.

The generator, like any model, is a function the caller gives; the plan decides what reaches it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import has_cjk
from tessella.operators import cache, retrieval
from tessella.session import cut_lineage

NOTHING_FOUND = "No documents were found for this question."
ATTEMPTS = 3
PREVIEW = 600


def generated(prompts: DataFrame, generate: Callable[[str], str], attempts: int = ATTEMPTS) -> DataFrame:
    """(ask_id, answer): the generator's answer; one with CJK characters is asked for again, up to ``attempts`` times; an error gives its text."""

    @F.pandas_udf(T.StringType())
    def run(context: pd.Series) -> pd.Series:
        def one(c):
            answer = None
            for _ in range(attempts):
                try:
                    answer = generate(c)
                except Exception as e:  # a failed call is an answer of its own
                    return f"generation_failed: {e}"
                if not any("一" <= ch <= "鿿" for ch in answer):
                    return answer
            return answer

        return context.map(one)

    return prompts.select("ask_id", run("context").alias("answer"))


def answered(asked: DataFrame, state: DataFrame, docs: DataFrame, generate: Callable[[str], str], k: int = retrieval.TOP_K) -> DataFrame:
    """(ask_id, answer, origin) for every asked question (ask_id, question, model, embedding).

    Origin: ``exact`` and ``similar`` come from the cache, ``none`` where no document was found, else ``generated``.
    """
    exact = cache.exact_lookup(state, asked).select("ask_id", "id", F.lit("exact").alias("origin"))
    rest = asked.join(exact, "ask_id", "left_anti")
    similar = cache.similar_lookup(state, rest).select("ask_id", "id", F.lit("similar").alias("origin"))
    hits = cut_lineage(exact.unionByName(similar))
    known = hits.join(state.select("id", "answer"), "id").select("ask_id", "answer", "origin")
    open_ = cut_lineage(asked.join(hits, "ask_id", "left_anti"))
    found = retrieval.overlap_top_k(docs, open_.select(F.col("ask_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text")), k)
    prompts = retrieval.context(found, docs, "source").withColumnRenamed("query_id", "ask_id")
    new = generated(prompts, generate).select("ask_id", "answer", F.lit("generated").alias("origin"))
    empty = open_.join(prompts, "ask_id", "left_anti").select("ask_id", F.lit(NOTHING_FOUND).alias("answer"), F.lit("none").alias("origin"))
    return known.unionByName(new).unionByName(empty)


def previews(answers: DataFrame) -> DataFrame:
    """(ask_id, preview, foreign): the first characters on one line, with a mark of CJK characters."""
    flat = F.translate(F.coalesce("answer", F.lit("")), "\n", " ")
    return answers.select("ask_id", F.when(F.length(flat) > PREVIEW, F.concat(F.left(flat, F.lit(PREVIEW)), F.lit("…"))).otherwise(flat).alias("preview"), has_cjk(flat).alias("foreign"))
