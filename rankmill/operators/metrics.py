"""Ranking quality: NDCG, reciprocal rank, recall, and comparisons of two rankings.

Judged queries are the base: a query without any result counts as zero, one
without judgements is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def per_query(ranked: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, at: int = 10, deep: int = 100) -> DataFrame:
    """``(query_id, ndcg, mrr, recall)`` of every judged query."""
    judged = qrels if queries is None else qrels.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    hits = ranked.filter(F.col("rank") <= max(at, deep)).join(judged, ["query_id", "doc_id"])
    return _ideal(judged, ["query_id"], at).join(_reached(hits, ["query_id"], at, deep), "query_id", "left").select("query_id", *_measures())


def _ideal(judged: DataFrame, by: list[str], at: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("grade"), "doc_id")
    return (
        judged.withColumn("r", F.row_number().over(w)).groupBy(*by)
        .agg(F.sum(F.when(F.col("r") <= at, gain(F.col("grade"), F.col("r")))).alias("ideal"), F.count_if(F.expr("grade >= 1")).alias("n_relevant"))
    )


def _reached(hits: DataFrame, by: list[str], at: int, deep: int) -> DataFrame:
    return hits.groupBy(*by).agg(
        F.sum(F.when(F.col("rank") <= at, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.min(F.when((F.col("grade") >= 1) & (F.col("rank") <= at), F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") >= 1) & (F.col("rank") <= deep)).alias("found"),
    )


def _measures() -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.when(F.col("ideal") > 0, F.coalesce("dcg", zero) / F.col("ideal")).otherwise(zero).alias("ndcg"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.when(F.col("n_relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("n_relevant")).otherwise(zero).alias("recall"),
    ]


def _means() -> list[Column]:
    return [F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"), F.count("ndcg").alias("n_queries")]


def evaluate(ranked: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, at: int = 10, deep: int = 100) -> DataFrame:
    """One row of means; NULLs if no query is judged."""
    return per_query(ranked, qrels, queries, at, deep).agg(*_means())


def compare(a: DataFrame, b: DataFrame, fail: float = 0.10, gap: float = 0.10) -> DataFrame:
    """Per query who wins by more than ``gap`` in NDCG; both below ``fail`` fail together."""
    x = a.select("query_id", F.col("ndcg").alias("ndcg_a")).join(b.select("query_id", F.col("ndcg").alias("ndcg_b")), "query_id")
    delta = F.col("ndcg_a") - F.col("ndcg_b")
    return x.withColumn("bucket", F.when(F.greatest("ndcg_a", "ndcg_b") < fail, "both_fail").when(delta > gap, "a_wins").when(delta < -gap, "b_wins").otherwise("tie")).withColumn("delta", delta)


def bucket_counts(compared: DataFrame) -> DataFrame:
    n = compared.groupBy("bucket").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(compared.agg(F.count("*").alias("total")))).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))  # one row


def oracle(compared: DataFrame) -> DataFrame:
    """Means of both, the mean of the better one per query, and their correlation."""
    return compared.agg(
        F.round(F.avg("ndcg_a"), 6).alias("mean_a"), F.round(F.avg("ndcg_b"), 6).alias("mean_b"), F.round(F.avg(F.greatest("ndcg_a", "ndcg_b")), 6).alias("mean_best"), F.round(F.corr("ndcg_a", "ndcg_b"), 6).alias("correlation"))


def examples(compared: DataFrame, first_a: DataFrame, first_b: DataFrame, titles: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` widest differences of each bucket with both first documents' titles (``?`` if unknown)."""
    w = Window.partitionBy("bucket").orderBy(F.desc(F.round(F.abs("delta"), 6)), "query_id")
    top = compared.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
    for name, ranked in (("a", first_a), ("b", first_b)):
        best = ranked.filter("rank = 1").join(titles, "doc_id", "left").select("query_id", F.coalesce("title", F.lit("?")).alias(f"title_{name}"))
        top = top.join(best, "query_id", "left").withColumn(f"title_{name}", F.coalesce(f"title_{name}", F.lit("?")))
    return top.select("bucket", "nth", "query_id", F.round("delta", 6).alias("delta"), "title_a", "title_b")


def report(hits: DataFrame, qrels: DataFrame, queries: DataFrame, names: DataFrame, at: int = 10, deep: int = 100) -> DataFrame:
    """The means of every method on every corpus variant and split, one row each: those of ``names(run, method, variant, split)``.

    ``hits(run, method, query_id, rank, grade)`` are the ranks of relevant
    documents, ``queries(split, query_id)`` the queries of each split.
    """
    judged = qrels.join(queries.select("split", "query_id").distinct(), "query_id")
    base = _ideal(judged, ["split", "query_id"], at).join(F.broadcast(names), "split")  # a row per method, variant and split
    keys = ["run", "method", "query_id"]
    means = base.join(_reached(hits, keys, at, deep), keys, "left").select("run", "method", *_measures()).groupBy("run", "method").agg(*_means())
    out = names.join(means, ["run", "method"], "left")
    return out.select("method", "variant", "split", "ndcg", "mrr", "recall", F.coalesce("n_queries", F.lit(0)).alias("n_queries"))
