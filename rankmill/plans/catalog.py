"""Queries of the retrieval and ranking operators, with the SQL that gives the same result.

Search queries are every question whose id is divisible by 100, against all
documents; evaluation runs over all judged queries of the validation split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.functions.html_text import clean_html
from rankmill.operators import etl, history, ltr, metrics, rag, retrieval
from rankmill.plans.stores import bm25_index, corpus_vectors, documents, encoder
from rankmill.session import Scratch, spread
from rankmill.sources.tables import corpus_text, describe, file_manifest, load

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared inputs ---


def _search_queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "questions").filter("id % 100 = 0 and title is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("title").alias("query_text"))


def _val(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "splits").filter("split = 'val'").select("query_id", "query_text")


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return etl.build_qrels(load(spark, d, "corpus"))


def _bm25(spark: SparkSession, d: str, mode: str = "code", queries: DataFrame | None = None, variant: str | None = None, k: int = 100, packed: bool = False) -> DataFrame:
    return retrieval.search_bm25(bm25_index(spark, d, mode, variant), _val(spark, d) if queries is None else queries, k, mode, packed=packed)


def _vectors(spark: SparkSession, d: str, queries: DataFrame | None = None, variant: str | None = None, k: int = 100, packed: bool = False) -> DataFrame:
    """The dense list: cosines of the hashing encoder, over the whole corpus."""
    q = _val(spark, d) if queries is None else queries
    return retrieval.search_dense(corpus_vectors(spark, d, variant), q.select("query_id", encoder()("query_text").alias("embedding")), k, packed=packed)


def _tok(t: str, mode: str = "code") -> str:
    if mode == "basic":
        return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"
    parts = r"regexp_extract_all(regexp_replace(c, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return (
        f"flatten(list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*'), lambda c: list_concat("
        f"list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: not regexp_full_match(p, '[0-9]+')), "
        f"case when regexp_matches(c, '[A-Za-z]') and (regexp_matches(c, '[._]') or len({parts}) > 1) then [lower(c)] else [] end)))"
    )


_DOCS_SQL = "docs as (select doc_id, min(text) as text from corpus group by doc_id)"
_VAL_SQL = "val as (select query_id, query_text from splits where split = 'val')"
_SEARCH_SQL = "val as (select id as query_id, min(title) as query_text from questions where id % 100 = 0 and title is not null group by id)"
_QRELS_SQL = "qrels as (select question_id as query_id, doc_id, max(case when is_accepted then 3 when answer_score >= 4 then 2 when answer_score >= 1 then 1 else 0 end) as grade from corpus where from_eval_query group by all)"


def _bm25_sql(name: str, mode: str = "code") -> str:
    n = name
    return f"""
{n}_tok as (select doc_id, {_tok('coalesce(text, chr(0))', mode)} as terms from docs),
{n}_st as (select count(*) as n, avg(len(terms)) as a from {n}_tok),
{n}_tf as (select doc_id, len(terms) as dl, term, count(*) as tf from (select doc_id, terms, unnest(terms) as term from {n}_tok) group by all),
{n}_df as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from {n}_tf, {n}_st group by term, n),
{n}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('query_text', mode)}) as term from val) group by all),
{n}_sc as (select query_id, doc_id, round(sum(qtf * idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from {n}_q join {n}_tf using (term) join {n}_df using (term), {n}_st group by all),
{n} as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from {n}_sc) where rank <= 100)"""


def _vector_sql(name: str) -> str:
    n = name
    hashed = f"select {{id}} as id, unnest(list_transform({{terms}}, lambda t: cast('0x' || substr(md5(t), 1, 8) as bigint))) as h from {{of}}"
    doc = hashed.format(id="doc_id", terms=_tok("coalesce(text, chr(0))"), of="docs")
    query_ = hashed.format(id="query_id", terms=_tok("coalesce(query_text, chr(0))"), of="val")
    return f"""
{n}_d as (select id as doc_id, h % 256 as bucket, sum(case when (h >> 20) & 1 = 1 then 1 else -1 end)::double as v from ({doc}) group by all),
{n}_v as (select id as query_id, h % 256 as bucket, sum(case when (h >> 20) & 1 = 1 then 1 else -1 end)::double as v from ({query_}) group by all),
{n}_dn as (select doc_id, sqrt(coalesce(sum(v * v), 0.0)) as len from docs left join {n}_d using (doc_id) group by doc_id),
{n}_vn as (select query_id, sqrt(coalesce(sum(v * v), 0.0)) as len from val left join {n}_v using (query_id) group by query_id),
{n}_dot as (select query_id, doc_id, sum({n}_d.v * {n}_v.v) as dot from {n}_d join {n}_v using (bucket) group by all),
{n}_sc as (select query_id, doc_id, case when a.len > 0 and b.len > 0 then round(coalesce(dot, 0.0) / (a.len * b.len), 6) + 0.0 else 0.0 end as score from {n}_vn a cross join {n}_dn b left join {n}_dot using (query_id, doc_id)),
{n} as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from {n}_sc) where rank <= 100)"""


def _metrics_sql(name: str, of: str) -> str:
    return f"""
{name}_ideal as (select query_id, sum(case when r <= 10 then (pow(2.0, grade) - 1) / log2(r + 1.0) end) as ideal, count(*) filter (grade >= 1) as n_rel
  from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as r from qrels where query_id in (select query_id from val)) group by query_id),
{name}_hit as (select query_id, sum(case when rank <= 10 then (pow(2.0, grade) - 1) / log2(rank + 1.0) end) as dcg, min(case when grade >= 1 and rank <= 10 then rank end) as f, count(*) filter (grade >= 1) as found
  from {of} join qrels using (query_id, doc_id) group by query_id),
{name} as (select query_id, case when ideal > 0 then coalesce(dcg, 0.0) / ideal else 0.0 end as ndcg, coalesce(1.0 / f, 0.0) as mrr, case when n_rel > 0 then coalesce(found, 0) / n_rel else 0.0 end as recall
  from {name}_ideal left join {name}_hit using (query_id))"""


def _rrf_sql(name: str, k: str = "60") -> str:
    return f"""
{name}_p as (select query_id, doc_id, a.rank as r0, b.rank as r1 from code a full join vec b using (query_id, doc_id)),
{name} as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, r0 asc nulls last, r1 asc nulls last, doc_id) as int) as rank
  from (select *, round(coalesce(1.0::double / ({k} + r0), 0.0) + coalesce(1.0::double / ({k} + r1), 0.0), 12) as score from {name}_p)) where rank <= 100)"""


_TWO = f"with {_DOCS_SQL}, {_VAL_SQL}, {_QRELS_SQL}, {_bm25_sql('code')}, {_vector_sql('vec')}"
_ONE = f"with {_DOCS_SQL}, {_VAL_SQL}, {_QRELS_SQL}, {_bm25_sql('code')}"


# --- tables to corpus ---


@query("select id, tags, score from questions where contains(lower(tags), '|python|') or contains(lower(tags), '|pandas|') or contains(lower(tags), '|numpy|')")
def tag_filter(spark, d):
    return etl.tagged(load(spark, d, "questions"), "python", "pandas", "numpy").select("id", "tags", "score")


@query("""select id, accepted_answer_id, case when is_eval_query and accepted_answer_id not in (select id from answers) then false else is_eval_query end as is_eval_query, loaded_at from questions""")
def eval_query_flags(spark, d):
    q = etl.finalise_eval_flag(load(spark, d, "questions"), load(spark, d, "answers").select("id"))
    return q.select("id", "accepted_answer_id", "is_eval_query", "loaded_at")


@query("select id, question_id, score from answers where question_id in (select id from questions)")
def answers_of_known_questions(spark, d):
    return etl.answers_of(load(spark, d, "answers"), load(spark, d, "questions")).select("id", "question_id", "score")


@query("""select a.id as doc_id, a.question_id, q.title, q.body as question_body, a.body as answer_body, q.title || chr(10) || chr(10) || a.body as text, a.score as answer_score, a.id = q.accepted_answer_id as is_accepted, q.is_eval_query as from_eval_query
from (select distinct id, question_id, body, score from answers) a join (select distinct id, title, body, accepted_answer_id, is_eval_query from questions) q on a.question_id = q.id""")
def corpus_assembly(spark, d):
    q = load(spark, d, "questions").select("id", "title", "body", "accepted_answer_id", "is_eval_query").distinct()
    a = load(spark, d, "answers").select("id", "question_id", "body", "score").distinct()
    return etl.build_corpus(q, a, "body", "body")


@query("""select doc_id, title || chr(10) || chr(10) || question_body || chr(10) || chr(10) || answer_body as text from corpus""")
def corpus_text_with_question(spark, d):
    return corpus_text(load(spark, d, "corpus"), "b")


@query("""select count(*) as n_questions, count(*) filter (is_eval_query) as n_eval, count(*) filter (is_closed) as n_closed, min(creation_date)::date as earliest, max(creation_date)::date as latest,
(select count(*) from answers) as n_answers from questions""")
def posts_summary(spark, d):
    return etl.posts_summary(load(spark, d, "questions"), load(spark, d, "answers"))


@query("""select count(*) filter (accepted_answer_id = 0) as n_no_accepted_zero, count(*) filter (accepted_answer_id is null) as n_no_accepted_null, count(*) filter (is_closed is null) as n_closed_null,
count(*) filter (is_eval_query is null) as n_eval_null, count(*) filter (body is null) as n_body_null, count(*) filter (body = '') as n_body_empty, count(*) filter (title is null) as n_title_null, count(*) filter (score > 20) as n_score_high from questions""")
def missing_values(spark, d):
    return etl.missing_values(load(spark, d, "questions"))


@query("""select count(*) as n_rows, count(*) - count(distinct doc_id) as n_repeats, count(*) filter (answer_body = '') as n_empty, count(*) filter (length(answer_body) < 15) as n_short, round(avg(length(answer_body))) as avg_chars,
cast(max(length(answer_body)) as int) as max_chars, count(*) filter (answer_body like '%<p>%' or answer_body like '%</%>%' or answer_body like '%&lt;%' or answer_body like '%&amp;%') as n_markup from corpus""")
def clean_report(spark, d):
    return etl.clean_report(load(spark, d, "corpus"), "doc_id", "answer_body")


@query("""select count(*) as n_docs, count(distinct question_id) as n_questions, count(*) filter (is_accepted) as n_accepted, count(*) filter (from_eval_query) as n_from_eval, round(avg(length(text))) as avg_chars,
cast(max(length(text)) as int) as max_chars, count(*) filter (length(text) between 200 and 600) as n_ordinary from corpus""")
def corpus_report(spark, d):
    return etl.corpus_report(load(spark, d, "corpus"))


@query(f"with {_QRELS_SQL} select * from qrels")
def qrels(spark, d):
    return _qrels(spark, d)


@query(f"with {_QRELS_SQL} select grade, count(*) as n, round(100.0 * count(*) / (select count(*) from qrels), 2)::double as pct from qrels group by grade")
def grade_histogram(spark, d):
    return etl.grade_histogram(_qrels(spark, d))


@query(f"""with {_QRELS_SQL}, per as (select query_id, count(*) as n, count(*) filter (grade = 3) as best from qrels group by query_id)
select count(*) as n_queries, sum(n)::bigint as n_judgements, count(*) filter (best > 1) as n_many_best, count(*) filter (best = 0) as n_no_best, round(sum(n)::double / count(*), 6) as avg_judged from per""")
def qrels_report(spark, d):
    return etl.qrels_report(_qrels(spark, d))


@query("""select id as query_id, title as query_text, creation_date, case when year(creation_date) < 2021 then 'train' when year(creation_date) < 2022 then 'val' else 'test' end as split from questions where is_eval_query""")
def time_split(spark, d):
    return etl.split_queries(load(spark, d, "questions"))


@query("""select split, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2)::double as pct, min(creation_date)::date as earliest, max(creation_date)::date as latest from splits group by split""")
def split_report(spark, d):
    s = load(spark, d, "splits")
    per = s.groupBy("split").agg(F.count("*").alias("n"), F.min("creation_date").cast("date").alias("earliest"), F.max("creation_date").cast("date").alias("latest"))
    total = s.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("split", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"), "earliest", "latest")  # one row


# --- text ---


@query()
def html_clean(spark, d):
    return spread(load(spark, d, "answers").select("id", "body")).select("id", clean_html("body").alias("body_clean"))


@query()
def html_clean_questions(spark, d):
    return etl.clean_questions(load(spark, d, "questions")).select("id", "title", "body_clean")


@query(r"""select id, case when length(body) > 700 then substr(body, 1, 700) || ' [' || (length(body) - 700)::varchar || ' more chars]' else body end as preview,
substr(trim(regexp_replace(body, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), 1, 180) as snippet from answers""")
def text_previews(spark, d):
    return load(spark, d, "answers").select("id", tx.preview(F.col("body")).alias("preview"), tx.snippet(F.col("body")).alias("snippet"))


@query(r"""select id, case when length(title) > 40 then substr(title, 1, 40) || '...' else title end as short_title, regexp_extract(model, '([^/\\]*)$', 1) as model_name,
least(1.0, greatest(0.0, max_tokens / case when n_ctx > 0 then n_ctx end))::double as fill, greatest(1, least(8192, max_tokens)) as max_tokens from conversations""")
def conversation_labels(spark, d):
    return load(spark, d, "conversations").select(
        "id", tx.short_title(F.col("title")).alias("short_title"), tx.basename(F.col("model")).alias("model_name"), tx.fill_ratio(F.col("max_tokens"), F.col("n_ctx")).alias("fill"), tx.clamp(F.col("max_tokens"), 1, 8192).alias("max_tokens"))


@query(f"with {_DOCS_SQL} select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_tok('text')}) as term from docs) group by term")
def tokenize_docs(spark, d):
    t = documents(spark, d).select("doc_id", F.explode(tx.term_bag("text")).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@query(f"with {_DOCS_SQL} select doc_id, len({_tok('text', 'basic')}) as n_terms from docs")
def tokenize_basic(spark, d):
    return documents(spark, d).select("doc_id", F.size(tx.tokenize("text", "basic")).cast("long").alias("n_terms"))


# --- retrieval ---


@query(f"""with {_DOCS_SQL}, {_VAL_SQL}, {_bm25_sql('code')} select term, df, round(idf, 6) as idf from code_df join (select term, count(*) as df from code_tf group by term) using (term)""")
def bm25_terms(spark, d):
    return bm25_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_DOCS_SQL}, {_SEARCH_SQL}, {_bm25_sql('code')} select * from code")
def bm25_topk(spark, d):
    return _bm25(spark, d, queries=_search_queries(spark, d))


@query(f"{_ONE} select query_id, doc_id, rank, coalesce(title, '?') as title from code join (select doc_id, min(title) as title from corpus group by doc_id) using (doc_id) where rank <= 5")
def search_results(spark, d):
    return retrieval.with_documents(_bm25(spark, d).filter("rank <= 5"), load(spark, d, "corpus")).select("query_id", "doc_id", "rank", "title")


_DENSE_SQL = """dense as (select * from (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from
(select q.vec_id as query_id, d.vec_id as doc_id, round(list_dot_product(q.embedding::double[], d.embedding::double[]), 6) as score from embeddings q, embeddings d where q.vec_id % 100 = 0)) where rank <= 100)"""


def _dense(spark, d):
    e = load(spark, d, "embeddings")
    return retrieval.search_dense(e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(f"with {_DENSE_SQL} select * from dense")
def dense_topk(spark, d):
    return _dense(spark, d)


@query(f"with {_DENSE_SQL} select query_id, max(score) as top_score, case when max(score) >= 0.7 then 'open' else 'closed' end as gate from dense where query_id <> doc_id group by query_id")
def confidence_gate(spark, d):
    return retrieval.confidence_gate(_dense(spark, d).filter("query_id <> doc_id"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as length from embeddings")
def vector_lengths(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding"))), 6).alias("length"))


@query(f"{_TWO}, {_rrf_sql('rrf')} select * from rrf")
def rrf_fuse(spark, d):
    return retrieval.fuse_rrf([_bm25(spark, d), _vectors(spark, d)])


_SWEEP = (10, 20, 40, 60, 100, 200)


@query(f"{_TWO}, " + ", ".join(f"{_rrf_sql(f'f{k}', str(k))}, {_metrics_sql(f'm{k}', f'f{k}')}" for k in _SWEEP)
       + " ".join(f"{' union all' if i else ''} select {k} as k, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall, count(*) as n_queries from m{k}" for i, k in enumerate(_SWEEP)))
def rrf_sweep(spark, d):
    """Both lists are computed once and fused again for each k."""
    from functools import reduce

    s = Scratch(spark, "sweep")
    a, b = s.write(_bm25(spark, d)), s.write(_vectors(spark, d))
    judged, val = s.write(_qrels(spark, d)), _val(spark, d)
    return reduce(DataFrame.unionByName, [metrics.evaluate(retrieval.fuse_rrf([a, b], k), judged, val).withColumn("k", F.lit(k)) for k in _SWEEP])


@query(f"{_TWO}, {_rrf_sql('rrf', '5')} select * from rrf")
def hybrid_search(spark, d):
    """BM25 and vectors of the whole corpus, fused."""
    return retrieval.fuse_rrf([_bm25(spark, d), _vectors(spark, d)], 5)


# --- evaluation ---


@query(f"{_ONE}, {_metrics_sql('m', 'code')} select round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall, count(*) as n_queries from m")
def eval_metrics(spark, d):
    return metrics.evaluate(_bm25(spark, d), _qrels(spark, d), _val(spark, d))


@query(f"{_ONE}, {_metrics_sql('m', 'code')} select query_id, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr, round(recall, 6) as recall from m")
def per_query_metrics(spark, d):
    return metrics.per_query(_bm25(spark, d), _qrels(spark, d), _val(spark, d)).select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")])


def _compared(spark, d):
    judged, val = _qrels(spark, d), _val(spark, d)
    s = Scratch(spark, "compared")
    a, b = s.write(_bm25(spark, d)), s.write(_vectors(spark, d))  # both are read more than once
    return metrics.compare(metrics.per_query(a, judged, val), metrics.per_query(b, judged, val)), a, b


_CMP = f"""{_TWO}, {_metrics_sql('ma', 'code')}, {_metrics_sql('mb', 'vec')},
cmp as (select query_id, ma.ndcg as a, mb.ndcg as b, ma.ndcg - mb.ndcg as delta, case when greatest(ma.ndcg, mb.ndcg) < 0.1 then 'both_fail' when ma.ndcg - mb.ndcg > 0.1 then 'a_wins' when ma.ndcg - mb.ndcg < -0.1 then 'b_wins' else 'tie' end as bucket from ma join mb using (query_id))"""


@query(f"{_CMP} select bucket, count(*) as n, round(100.0 * count(*) / (select count(*) from cmp), 2)::double as pct from cmp group by bucket")
def failure_buckets(spark, d):
    return metrics.bucket_counts(_compared(spark, d)[0])


@query(f"{_CMP} select round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(greatest(a, b)), 6) as mean_best, round(corr(a, b), 6) as correlation from cmp")
def oracle_bound(spark, d):
    return metrics.oracle(_compared(spark, d)[0])


@query(f"""{_CMP}, t as (select doc_id, min(title) as title from corpus group by doc_id),
top as (select *, cast(row_number() over (partition by bucket order by round(abs(delta), 6) desc, query_id) as int) as nth from cmp)
select bucket, nth, query_id, round(delta, 6) as delta, coalesce(x.title, '?') as title_a, coalesce(y.title, '?') as title_b from top
left join (select query_id, title from code join t using (doc_id) where rank = 1) x using (query_id) left join (select query_id, title from vec join t using (doc_id) where rank = 1) y using (query_id) where nth <= 10""")
def failure_examples(spark, d):
    compared, a, b = _compared(spark, d)
    titles = load(spark, d, "corpus").groupBy("doc_id").agg(F.min("title").alias("title"))
    return metrics.examples(compared, a, b, titles)


# --- learning to rank ---


def _features(spark, d):
    return ltr.build_features(_bm25(spark, d), _vectors(spark, d), _qrels(spark, d))


_FEAT = f"""{_TWO}, feat as (select query_id, doc_id, a.score as bm25_score, a.rank::double as bm25_rank, b.score as dense_score, b.rank::double as dense_rank,
round(coalesce(1.0::double / (5 + a.rank), 0.0) + coalesce(1.0::double / (5 + b.rank), 0.0), 12) as rrf_score, coalesce(grade, 0) as label from code a full join vec b using (query_id, doc_id) left join qrels using (query_id, doc_id))"""


@query(f"{_FEAT} select * from feat")
def ltr_features(spark, d):
    return _features(spark, d)


@query(f"{_FEAT} select count(*) as n_rows, count(distinct query_id) as n_queries, round(count(*) filter (label > 0)::double / count(*), 6) as positive_rate from feat")
def ltr_feature_summary(spark, d):
    return ltr.feature_summary(_features(spark, d))


@query(f"{_FEAT} select query_id, count(*) as n_candidates from feat group by query_id")
def ltr_group_sizes(spark, d):
    return ltr.group_sizes(_features(spark, d))


def _train_valid(spark, d):
    judged = _qrels(spark, d)
    both = []
    for split in ("train", "val"):
        q = load(spark, d, "splits").filter(F.col("split") == split).select("query_id", "query_text").join(judged.select("query_id").distinct(), "query_id", "left_semi")
        both.append(ltr.candidates(_bm25(spark, d, queries=q, packed=True), _vectors(spark, d, q, packed=True), judged))
    return tuple(both)


@query()
def ltr_rerank(spark, d):
    """Candidates of the validation split, ordered by trees trained on the training split."""
    a, b = _train_valid(spark, d)
    b.rows = Scratch(spark, "ltr").write(b.rows)  # read twice
    return ltr.rerank(b, ltr.train(a, b, ltr.Params(min_rows=20, rounds=60, patience=15))).drop("top_score")


@query()
def ltr_tune(spark, d):
    return ltr.tune(*_train_valid(spark, d), n=12)


# --- answers ---


@query(f"""{_ONE}, top as (select query_id, list(doc_id order by rank) as top_k_doc_ids, max(coalesce(grade, 0)) as best_grade from code left join qrels using (query_id, doc_id) where rank <= 4 and query_id in (select query_id from qrels) group by query_id)
select query_id, query_text, array_to_string(top_k_doc_ids, ',') as doc_ids, best_grade, case when best_grade >= 2 then 'good_context' when best_grade = 1 then 'weak_context' when best_grade = 0 then 'no_context' else 'unknown' end as bucket from top join val using (query_id)""")
def rag_eval_queries(spark, d):
    return rag.eval_queries(_bm25(spark, d), _qrels(spark, d), _val(spark, d)).select("query_id", "query_text", F.array_join(F.col("top_k_doc_ids").cast("array<string>"), ",").alias("doc_ids"), "best_grade", "bucket")


@query("""with g as (select query_id, min(bucket) as bucket from rag_generations where query_id is not null group by query_id),
s as (select *, row_number() over (partition by bucket order by (query_id * 7919) % 1000003, query_id) as nth from g)
select query_id, bucket, cast(row_number() over (order by (query_id * 104729) % 1000003, query_id) as int) as position from s where nth <= 25""")
def stratified_sample(spark, d):
    g = load(spark, d, "rag_generations").filter("query_id is not null").groupBy("query_id").agg(F.min("bucket").alias("bucket"))
    return rag.stratified_sample(g, "bucket", "query_id")


@query(f"""{_ONE}, t as (select doc_id, min(row(title, answer_body)) as x from corpus group by doc_id),
refs as (select query_id, count(*) as n_refs, string_agg('[' || rank || '] ' || coalesce(x[1], '?') || chr(10) || chr(10) || coalesce(x[2], ''), chr(10) || chr(10) order by rank) as docs from code join t using (doc_id) where rank <= 4 group by query_id)
select query_id, cast(n_refs as int) as n_refs, 'Use only the numbered references.' || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || chr(10) || docs as prompt from val join refs using (query_id)""")
def prompt_build(spark, d):
    return rag.build_prompts(_val(spark, d), _bm25(spark, d, k=4), load(spark, d, "corpus"))


_CLAIMS = r"""with c as (select distinct query_id, bucket, claims_json from rag_generations where query_id is not null),
p as (select *, case when json_valid(claims_json) and json_type(claims_json) = 'ARRAY' then list_filter(from_json(claims_json, '[{"text":"VARCHAR","citations":["INTEGER"]}]'), lambda x: length(trim(regexp_replace(coalesce(x.text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')) > 0) else [] end as claims from c),
r as (select query_id, bucket, claims_json, unnest(claims) as x, generate_subscripts(claims, 1) as i from p),
k as (select query_id, bucket, claims_json, cast(i as int) as claim_idx, x.text as claim, list_sort(list_distinct(list_filter(coalesce(x.citations, []), lambda n: n between 1 and 4))) as cited from r)"""


@query(f"{_CLAIMS} select query_id, bucket, claim_idx, claim, array_to_string(case when len(cited) = 0 then [1, 2, 3, 4] else cited end, ',') as cited_refs, len(cited) = 0 as uncited from k")
def claims_parse(spark, d):
    g = load(spark, d, "rag_generations").filter("query_id is not null").select("query_id", "bucket", "claims_json").distinct()
    return rag.claim_rows(g, 4).withColumn("cited_refs", F.array_join(F.col("cited_refs").cast("array<string>"), ","))


@query(f"{_CLAIMS} select query_id, string_agg(claim || ' ' || case when len(cited) = 0 then '[-]' else array_to_string(list_transform(cited, lambda n: '[' || n || ']'), '') end, chr(10) order by claim_idx) as answer from k group by query_id, bucket, claims_json")
def readable_answers(spark, d):
    g = load(spark, d, "rag_generations").filter("query_id is not null").select("query_id", "bucket", "claims_json").distinct()
    out = g.select("query_id", rag.readable(rag.parse_claims(F.col("claims_json"), 4)).alias("answer"))
    return out.filter("answer <> ''")


def _judged(spark, d):
    """Claims with a stub judge's text: a verdict by arithmetic on the row's numbers."""
    n = (F.col("query_id") + F.col("claim_idx")) % 4
    raw = F.concat(F.lit("Verdict: yes was my first thought. "), F.when(n == 0, "VERDICT: NO").when(n == 1, "verdict:  partial").when(n == 2, "VERDICT: YES").otherwise("perhaps"))
    rows = load(spark, d, "rag_generations").filter("query_id is not null").select("query_id", "bucket", "claims_json").distinct()
    return rag.claim_rows(rows, 4).withColumn("raw", F.when(n == 3, F.lit("perhaps")).otherwise(raw)).withColumn("label", rag.parse_verdict(F.col("raw")))


_JUDGED = f"{_CLAIMS}, j as (select *, case (query_id + claim_idx) % 4 when 0 then 'no' when 1 then 'partial' when 2 then 'yes' else 'unparsed' end as label from k)"


@query(f"{_JUDGED} select query_id, claim_idx, label from j")
def verdict_parse(spark, d):
    return _judged(spark, d).select("query_id", "claim_idx", "label")


@query(f"""{_JUDGED}, f as (select query_id, bucket, avg(case label when 'yes' then 1.0::double when 'partial' then 0.5 else 0.0 end) as s from j where label <> 'unparsed' group by query_id, bucket),
n as (select bucket, count(*) as n_queries from (select distinct query_id, bucket from rag_generations where query_id is not null) group by bucket)
select bucket, n_queries, round(avg(s), 6) as faithfulness, count(s) as n_scored from n left join f using (bucket) group by bucket, n_queries""")
def faithfulness(spark, d):
    queries = load(spark, d, "rag_generations").filter("query_id is not null").select("query_id", "bucket")
    return rag.faithfulness_by_bucket(_judged(spark, d), queries)


_PROMPTS = f"""{_ONE}, t as (select doc_id, min(row(title, answer_body)) as x from corpus group by doc_id),
prompts as (select query_id, 'Use only the numbered references.' || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || chr(10) || docs as prompt from val join
(select query_id, string_agg('[' || rank || '] ' || coalesce(x[1], '?') || chr(10) || chr(10) || coalesce(x[2], ''), chr(10) || chr(10) order by rank) as docs from code join t using (doc_id) where rank <= 4 group by query_id) using (query_id))"""


@query(f"{_PROMPTS} select query_id, length(prompt) || ' characters read' as reply from prompts")
def generate_stub(spark, d):
    """Prompts answered by a deterministic stub in place of a language model."""
    prompts = rag.build_prompts(_val(spark, d), _bm25(spark, d), load(spark, d, "corpus"))
    return rag.generate(prompts, lambda p: f"{len(p)} characters read").select("query_id", "reply")


@query("""select distinct id, case when route = 'ANSWER' then 'from the model alone' when route = 'SEARCH' and gate = 'open' then 'from ' || coalesce(json_array_length(sources_json), 0) || ' document(s), best match ' || printf('%.2f', floor(top_cosine * 100 + 0.5) / 100)
when route = 'SEARCH' then 'from the model alone: best match only ' || printf('%.2f', floor(top_cosine * 100 + 0.5) / 100) end as trace from messages where role = 'assistant'""")
def trace_badges(spark, d):
    m = load(spark, d, "messages").filter("role = 'assistant'")
    return m.select("id", rag.trace(F.col("route"), F.col("gate"), F.col("top_cosine"), F.json_array_length("sources_json")).alias("trace")).distinct()


# --- history ---

_MSG = "m as (select distinct id, conversation_id, role, content, created_at, context_used from messages where conversation_id is not null and content is not null and created_at is not null)"


def _messages(spark, d):
    return load(spark, d, "messages").select("id", "conversation_id", "role", "content", "created_at", "context_used").filter("conversation_id is not null and content is not null and created_at is not null").distinct()


@query(f"""with {_MSG}, c as (select *, len({_tok('content')}) as cost from m), r as (select *, sum(cost) over (partition by conversation_id order by created_at desc, id desc rows between unbounded preceding and current row) as running from c)
select conversation_id, id, cast(cost as int) as cost, cast(running as bigint) as running from r where running <= 60""")
def history_budget(spark, d):
    return history.fit_history(_messages(spark, d), 60).select("conversation_id", "id", "cost", "running")


@query(f"""with {_MSG}, c as (select *, len({_tok('content')}) as cost from m), r as (select *, sum(cost) over (partition by conversation_id order by created_at desc, id desc rows between unbounded preceding and current row) as running from c)
select conversation_id, '--- Earlier turns ---' || chr(10) || string_agg(case when role = 'user' then 'User' else 'Assistant' end || ': ' || content, chr(10) order by created_at, id) || chr(10) || '--- End of earlier turns ---' || chr(10) as transcript from r where running <= 400 group by conversation_id""")
def transcripts(spark, d):
    """What of each conversation fits into 400 terms, as text."""
    return history.format_history(history.fit_history(_messages(spark, d), 400))


@query("select conversation_id, max_by(context_used, id) as context_used from messages where role = 'assistant' and context_used is not null group by conversation_id")
def last_context(spark, d):
    return history.last_context(load(spark, d, "messages"))


@query("select model, max(created_at) as last_used from conversations where model is not null group by model order by last_used desc, model limit 20")
def recent_models(spark, d):
    return history.recent_models(load(spark, d, "conversations"))


@query("""with t as (select cast(make_timestamp(cast(max(created_at) * 1000000 as bigint)) as date) as today from conversations),
g as (select created_at, date_diff('day', cast(make_timestamp(cast(created_at * 1000000 as bigint)) as date), today) as days from conversations, t where created_at is not null)
select case when days <= 0 then 'today' when days = 1 then 'yesterday' else 'earlier' end as day_group, count(*) as n, max(created_at) as newest from g group by 1""")
def day_groups(spark, d):
    c = load(spark, d, "conversations").filter("created_at is not null")
    today = c.agg(F.timestamp_seconds(F.max("created_at")).cast("date").alias("today"))
    return history.sidebar(c.crossJoin(F.broadcast(today)), F.col("today"))  # one row


@query("""select c.id, coalesce(p.title, c.title) as title, c.model, coalesce(p.max_tokens, c.max_tokens) as max_tokens from conversations c left join (select id, 'Renamed' as title, case when id % 2 = 0 then 77 end as max_tokens from conversations where id % 3 = 0) p using (id)""")
def partial_update(spark, d):
    c = load(spark, d, "conversations")
    patch = c.filter("id % 3 = 0").select("id", F.lit("Renamed").alias("title"), F.when(F.col("id") % 2 == 0, 77).alias("max_tokens"))
    return history.partial_update(c, patch).select("id", "title", "model", "max_tokens")


@query("select conversation_id, count(*) as n from messages where conversation_id is null or conversation_id not in (select id from conversations where title like 'A%' or id % 2 = 1) group by conversation_id")
def cascade_delete(spark, d):
    c, m = load(spark, d, "conversations"), load(spark, d, "messages")
    _, left = history.cascade_delete(c, m, c.filter("title like 'A%' or id % 2 = 1").select("id"))
    return left.groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("select s.query_id, s.split from splits s where s.query_id not in (select query_id from rag_generations where query_id is not null)")
def pending_queries(spark, d):
    return history.pending(load(spark, d, "splits"), load(spark, d, "rag_generations").filter("query_id is not null"), "query_id").select("query_id", "split")


# --- sources ---


@query("""select cast(column_index - 1 as int) as position, column_name, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'TIMESTAMP' then 'timestamp_ntz' when 'DOUBLE' then 'double' end as column_type, true as is_nullable
from (select *, row_number() over (order by column_index) as nth from duckdb_columns() where table_name = 'questions')""")
def table_schema(spark, d):
    return describe(load(spark, d, "questions"))


@query()
def table_files(spark, d):
    return file_manifest(spark, d).groupBy().agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


# --- routing, judging ---


def _even(text: str) -> str:
    return "search" if len(text) % 2 == 0 else "answer"


def _flow_sql(threshold: float) -> str:
    search = "length(query_text) % 2 = 0"
    return f"""{_TWO}, g as (select query_id, max(score) as top from vec group by query_id), n as (select query_id, count(*) as n from code where rank <= 4 group by query_id)
select query_id, case when {search} then 'SEARCH' else 'ANSWER' end as route, case when {search} then case when top >= {threshold} then 'open' else 'closed' end end as gate,
case when {search} then top end as top_score, {search} and coalesce(top, 0) >= {threshold} and n is not null as used_docs, cast(case when {search} and top >= {threshold} then coalesce(n, 0) else 0 end as int) as n_sources from val left join g using (query_id) left join n using (query_id)"""


def _flow(spark, d, threshold):
    from rankmill.operators.adaptive import adaptive_answers

    out = adaptive_answers(_val(spark, d), _even, lambda p: f"{len(p)} characters read", _bm25(spark, d, k=4), _vectors(spark, d, k=1), load(spark, d, "corpus"), threshold)
    return out.select("query_id", "route", "gate", "top_score", "used_docs", "n_sources")


@query(_flow_sql(0.70))
def adaptive_flow(spark, d):
    """Router, gate on the best cosine, and generator, with stubs in place of models."""
    return _flow(spark, d, 0.70)


@query(_flow_sql(0.35))
def adaptive_flow_low(spark, d):
    """The same with a threshold that fits the hashing encoder's lower cosines, so that gates open too."""
    return _flow(spark, d, 0.35)


_JUDGE = f"""{_CLAIMS.replace('with c as', f"with {_DOCS_SQL}, val as (select query_id, min(query_text) as query_text from rag_generations where query_id is not null group by query_id), {_bm25_sql('code')}, c as")},
refs as (select distinct query_id, claim_idx, claim, unnest(case when len(cited) = 0 then [1, 2, 3, 4] else cited end) as ref from k where query_id in (select query_id from code)),
t as (select doc_id, min(title) as title, min(answer_body) as body from corpus group by doc_id),
p as (select query_id, claim_idx, claim, string_agg('[' || ref || '] ' || coalesce(title, '?') || chr(10) || chr(10) || coalesce(body, ''), chr(10) || chr(10) order by ref) as context from refs left join code on code.query_id = refs.query_id and code.rank = ref left join t using (doc_id) group by all)"""


@query(_JUDGE.replace("p as (select query_id,", "pr as (select refs.query_id,").replace("p as (select *,", "p as (select *,") + """,
said as (select query_id, claim_idx, claim, length('Is the claim supported by the references? End with VERDICT: YES, PARTIAL or NO.' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Claim: ' || claim) as n from pr)
select k.query_id, k.claim_idx, k.claim, coalesce(case n % 3 when 0 then 'yes' when 1 then 'partial' else 'no' end, 'unparsed') as label from (select distinct query_id, claim_idx, claim from k) k left join said using (query_id, claim_idx, claim)""")
def judge_stub(spark, d):
    """Claims judged against their references by a deterministic stub."""
    from rankmill.operators.adaptive import judge

    g = load(spark, d, "rag_generations").filter("query_id is not null").select("query_id", "bucket", "claims_json").distinct()
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cited_refs"))))  # a claim made more than once is judged by all that it cites
    claims = rag.claim_rows(g, 4).groupBy("query_id", "claim_idx", "claim").agg(refs.alias("cited_refs"))
    queries = load(spark, d, "rag_generations").filter("query_id is not null").groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    ranked = _bm25(spark, d, queries=queries, k=4)
    sources = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top_k_doc_ids"))
    return judge(claims, sources, load(spark, d, "corpus"), lambda p: "VERDICT: " + ("YES", "PARTIAL", "NO")[len(p) % 3]).select("query_id", "claim_idx", "claim", "label")


@query("select distinct query_id from rag_generations where query_id is not null and query_id not in (select query_id from splits)")
def unmatched_queries(spark, d):
    from rankmill.operators.adaptive import unmatched

    return unmatched(load(spark, d, "rag_generations").filter("query_id is not null"), load(spark, d, "splits"), "query_id")
