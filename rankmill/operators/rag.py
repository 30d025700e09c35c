"""Data plumbing around retrieval-augmented answers: prompts, claims, verdicts, routing.

Language models are callables passed in; the stubs here are deterministic and
only serve tests and dry runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.sources.tables import CLAIMS

LABEL_SCORE = {"yes": 1.0, "partial": 0.5, "no": 0.0}


def context_bucket(best_grade: Column) -> Column:
    return F.when(best_grade >= 2, "good_context").when(best_grade == 1, "weak_context").when(best_grade == 0, "no_context").otherwise("unknown")


def eval_queries(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """Judged queries with their top documents in rank order, best grade among them, and context bucket."""
    judged = qrels.select("query_id").distinct()
    top = ranked.filter(F.col("rank") <= k).join(judged, "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left")
    per = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top_k_doc_ids"), F.max(F.coalesce("grade", F.lit(0))).alias("best_grade"))
    return per.join(queries.select("query_id", "query_text"), "query_id").withColumn("bucket", context_bucket(F.col("best_grade")))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = 25, prime: int = 1_000_003) -> DataFrame:
    """``n`` rows of each stratum, or all of a smaller one, by arithmetic hash of an integer key; then in another hash's order."""
    h = (F.col(key) * 7919) % prime
    w = Window.partitionBy(stratum).orderBy(h, F.col(key))
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col(key) * 104_729) % prime, F.col(key)))).drop("nth")


def context_blocks(docs: Column, gap: str = "\n\n") -> Column:
    """Numbered documents ``[1] title`` and body, from an ordered array of (title, body)."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(d["title"], F.lit("?")), F.lit(gap), F.coalesce(d["body"], F.lit("")))), "\n\n")


def build_prompts(queries: DataFrame, ranked: DataFrame, corpus: DataFrame, k: int = 4, instruction: str = "Use only the numbered references.") -> DataFrame:
    """``(query_id, n_refs, prompt)``: the instruction, the question, and the first ``k`` documents in rank order."""
    docs = corpus.groupBy("doc_id").agg(F.min(F.struct("title", F.col("answer_body").alias("body"))).alias("d"))
    top = ranked.filter(F.col("rank") <= k).join(docs, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"]).alias("docs"))
    prompt = F.concat(F.lit(instruction + "\n\nQuestion: "), F.coalesce("query_text", F.lit("")), F.lit("\n\n"), context_blocks(F.col("docs")))
    return queries.join(top, "query_id").select("query_id", F.size("docs").alias("n_refs"), prompt.alias("prompt"))


def parse_claims(claims_json: Column, k: Column | int) -> Column:
    """Claims with text, citations sorted, distinct and within 1..k; unreadable JSON gives none."""
    kk = F.lit(k) if isinstance(k, int) else k
    parsed = F.coalesce(F.from_json(claims_json, CLAIMS), F.array().cast(CLAIMS))
    kept = F.filter(parsed, lambda c: F.length(F.trim(F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"\s+", " "))) > 0)
    none = F.array().cast("array<int>")
    return F.transform(kept, lambda c: F.struct(c["text"].alias("text"), F.array_sort(F.array_distinct(F.filter(F.coalesce(c["citations"], none), lambda x: (x >= 1) & (x <= kk)))).alias("citations")))


def readable(claims: Column) -> Column:
    """One line per claim, with its citations or ``[-]``."""
    marks = lambda c: F.when(F.size(c) == 0, "[-]").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), ""))
    return F.array_join(F.transform(claims, lambda c: F.concat(c["text"], F.lit(" "), marks(c["citations"]))), "\n")


def claim_rows(generations: DataFrame, k: Column | int) -> DataFrame:
    """One row per claim: its number, text, the references to judge it by (all k if it cites none) and whether it cites none."""
    kk = F.lit(k) if isinstance(k, int) else k
    rows = generations.withColumn("k", kk).select("query_id", "bucket", "k", F.posexplode(parse_claims(F.col("claims_json"), F.col("k"))).alias("i", "c"))
    uncited = F.size("c.citations") == 0
    return rows.select("query_id", "bucket", (F.col("i") + 1).alias("claim_idx"), F.col("c.text").alias("claim"), F.when(uncited & (F.col("k") >= 1), F.sequence(F.lit(1), F.greatest("k", F.lit(1)))).otherwise(F.col("c.citations")).alias("cited_refs"), uncited.alias("uncited"))


def parse_verdict(raw: Column) -> Column:
    """The last verdict named in a judge's text, or ``unparsed``."""
    found = F.regexp_extract_all(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit(r"VERDICT:\s*(YES|PARTIAL|NO)"), F.lit(1))
    return F.when(F.size(found) > 0, F.lower(F.element_at(found, -1))).otherwise("unparsed")


def label_score(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABEL_SCORE.items() for x in kv])[label]


def faithfulness(judged: DataFrame) -> DataFrame:
    """Mean score per query over claims with a readable verdict."""
    return judged.filter("label <> 'unparsed'").groupBy("query_id", "bucket").agg(F.avg(label_score(F.col("label"))).alias("faithfulness"))


def faithfulness_by_bucket(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """Per bucket: mean over scored queries, how many were scored, and how many there are."""
    faith = faithfulness(judged).groupBy("bucket").agg(F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.count("*").alias("n_scored"))
    total = queries.select("query_id", "bucket").distinct().groupBy("bucket").agg(F.count("*").alias("n_queries"))
    return total.join(faith, "bucket", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def route(reply: Column) -> Column:
    """SEARCH if the router's reply says so anywhere, else ANSWER."""
    return F.when(F.upper(reply).contains("SEARCH"), "SEARCH").otherwise("ANSWER")


def trace(route_: Column, gate: Column, cosine: Column, n_sources: Column) -> Column:
    """What a reader is told about how an answer came about; NULL without a route."""
    score = F.format_string("%.2f", F.floor(cosine * 100 + 0.5) / 100)
    return (
        F.when(route_ == "ANSWER", "from the model alone")
        .when((route_ == "SEARCH") & (gate == "open"), F.concat(F.lit("from "), F.coalesce(n_sources, F.lit(0)).cast("string"), F.lit(" document(s), best match "), score))
        .when(route_ == "SEARCH", F.concat(F.lit("from the model alone: best match only "), score))
    )


def generate(prompts: DataFrame, llm: Callable[[str], str], attempts: int = 3, out: str = "reply") -> DataFrame:
    """Adds the model's reply; a call that fails ``attempts`` times gives NULL and not a failed job."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields) + f", {out} string"

    def ask(prompt: str) -> str | None:
        for _ in range(attempts):
            try:
                return llm(prompt)
            except Exception:  # the callable may be remote
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [ask(p) for p in pdf["prompt"]]})

    return prompts.mapInPandas(run, schema)


def generate_claims(prompts: DataFrame, llm: Callable[[str], str], k: Column | int, attempts: int = 3) -> DataFrame:
    """Adds ``claims`` (text, citations within 1..k): a reply that is no complete JSON is asked for again, up to ``attempts`` times, then there are none.

    The reply is a list of claims or an object with such a list under ``claims``.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", claims_json string"

    def ask(prompt: str) -> str:
        for _ in range(attempts):
            try:
                value = json.loads(llm(prompt))
            except Exception:  # a cut reply, or a failed call
                continue
            found = value.get("claims") if isinstance(value, dict) else value
            return json.dumps(found if isinstance(found, list) else [], ensure_ascii=False)
        return "[]"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(claims_json=[ask(p) for p in pdf["prompt"]])

    out = prompts.mapInPandas(run, schema)
    return out.withColumn("claims", parse_claims(F.col("claims_json"), k)).drop("claims_json")
