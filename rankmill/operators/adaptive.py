"""Answering with or without sources: routing, gating, generation, judging, and comparisons of two generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators import rag, retrieval

LLM = Callable[[str], str]


@cache
def _loaded(make: Callable[[], LLM]) -> LLM:
    return make()


def generate_with(prompts: DataFrame, make: Callable[[], LLM], out: str = "reply") -> DataFrame:
    """Like ``rag.generate``, for a model that is costly to load: ``make`` is called once per worker process."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields) + f", {out} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm = _loaded(make)
        for pdf in batches:
            yield pdf.assign(**{out: [llm(p) for p in pdf["prompt"]]})

    return prompts.mapInPandas(run, schema)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def require_matched(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    """Stops with the number of keys that have no counterpart."""
    n = unmatched(left, right, key).count()
    if n:
        raise ValueError(f"{n} values of {key} have no {what}")


def adaptive_answers(queries: DataFrame, router: LLM, llm: LLM, ranked: DataFrame, confidence: DataFrame, corpus: DataFrame, threshold: float = 0.70, k: int = 4, transcripts: DataFrame | None = None) -> DataFrame:
    """``(query_id, route, gate, top_score, used_docs, n_sources, reply, trace)``.

    The router decides whether to search.  A search whose best confidence stays
    below the threshold is answered from the model's own knowledge.
    ``transcripts(query_id, transcript)`` go before the question.
    """
    q = queries.select("query_id", "query_text")
    asked = rag.generate(q.withColumn("prompt", F.coalesce("query_text", F.lit(""))), router, out="said").withColumn("route", rag.route(F.coalesce("said", F.lit("")))).drop("said", "prompt")
    gates = retrieval.confidence_gate(confidence, threshold)
    prompts = rag.build_prompts(q, ranked, corpus, k).withColumnRenamed("prompt", "sourced")
    x = asked.join(gates, "query_id", "left").join(prompts, "query_id", "left")
    search = F.col("route") == "SEARCH"
    gate = F.when(search, F.coalesce("gate", F.lit("closed")))
    used = search & (gate == "open") & F.col("sourced").isNotNull()
    x = x.withColumn("used_docs", used).withColumn("gate", gate).withColumn("top_score", F.when(search, F.col("top_score"))).withColumn("n_sources", F.when(used, F.col("n_refs")).otherwise(0))
    before = F.lit("")
    if transcripts is not None:
        x = x.join(transcripts, "query_id", "left")
        before = F.coalesce("transcript", F.lit(""))
    x = x.withColumn("prompt", F.concat(before, F.when(F.col("used_docs"), F.col("sourced")).otherwise(F.concat(F.lit("Question: "), F.coalesce("query_text", F.lit(""))))))
    out = rag.generate(x.select("query_id", "route", "gate", "top_score", "used_docs", "n_sources", "prompt"), llm)
    return out.drop("prompt").withColumn("trace", rag.trace(F.col("route"), F.col("gate"), F.coalesce("top_score", F.lit(0.0)), F.col("n_sources")))


def judge_prompts(claims: DataFrame, sources: DataFrame, corpus: DataFrame, instruction: str = "Is the claim supported by the references? End with VERDICT: YES, PARTIAL or NO.") -> DataFrame:
    """One prompt per claim, with the references it is judged by.

    ``claims(query_id, claim_idx, claim, cited_refs)``; ``sources(query_id, top_k_doc_ids)``
    gives the documents that the numbers stand for.
    """
    docs = corpus.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("answer_body").alias("body"))
    top = sources.select("query_id", F.posexplode_outer("top_k_doc_ids").alias("i", "doc_id")).join(docs, "doc_id", "left")
    block = F.concat(F.lit("] "), F.coalesce("title", F.lit("?")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    top = top.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct(F.col("i") + 1, block)))).alias("blocks"))
    # a query's references are put together once, not for each claim
    refs = claims.join(top, "query_id").filter(F.size("cited_refs") > 0)
    text = F.array_join(F.transform(F.array_sort("cited_refs"), lambda r: F.concat(F.lit("["), r.cast("string"), F.coalesce(F.col("blocks")[r], F.lit("] ?\n\n")))), "\n\n")
    return refs.select("query_id", "claim_idx", "claim", F.concat(F.lit(instruction + "\n\n"), text, F.lit("\n\nClaim: "), F.col("claim")).alias("prompt"))


def judge(claims: DataFrame, sources: DataFrame, corpus: DataFrame, llm: LLM) -> DataFrame:
    """Every claim's label from the judge's text."""
    said = rag.generate(judge_prompts(claims, sources, corpus), llm, out="raw")
    return claims.join(said.select("query_id", "claim_idx", "claim", "raw"), ["query_id", "claim_idx", "claim"], "left").withColumn("label", rag.parse_verdict(F.col("raw")))


def compare_answers(prompts: DataFrame, before: LLM, after: LLM) -> DataFrame:
    """Both generators' answers to the same prompts."""
    return rag.generate(rag.generate(prompts, before, out="answer_before"), after, out="answer_after")
