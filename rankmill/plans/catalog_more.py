"""Queries of saved indexes, online search, evaluation by method, raw posts, text rules, chat history flows and incremental reads, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.functions import text as tx
from rankmill.functions.html_text import clean_html
from rankmill.operators import adaptive, etl, history, ltr, metrics, rag, retrieval
from rankmill.plans import catalog as c
from rankmill.plans.stores import bm25_index, corpus_vectors, encoder
from rankmill.session import Scratch
from rankmill.sources.tables import check_manifest, load, load_many, write_table
from rankmill.streaming.resume import process_new_files

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- saved indexes, online search, evaluation ---


@query(f"{c._ONE} select * from code")
def bm25_index_roundtrip(spark, d):
    """The index written to a folder, read back, and searched."""
    to = Scratch(spark, "roundtrip").path + "/bm25"
    bm25_index(spark, d).save(to)
    return retrieval.search_bm25(retrieval.BM25Index.load(spark, to), c._val(spark, d))


@query(f"with {c._DENSE_SQL} select * from dense")
def vector_index_roundtrip(spark, d):
    to = Scratch(spark, "roundtrip").path + "/vectors"
    e = load(spark, d, "embeddings")
    retrieval.save_vectors(e.select(F.col("vec_id").alias("doc_id"), "embedding"), to)
    return retrieval.search_dense(retrieval.load_vectors(spark, to), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(f"{c._TWO} select * from vec")
def encoded_topk(spark, d):
    """The corpus and the validation queries through the encoder, compared by cosine."""
    return c._vectors(spark, d)


def _toy_model():
    """A stand-in for a sentence model: lengths and counts of two letters."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count("e"), t.count("a"), 1.0] for t in texts])


@query("""with v as (select query_id, [length(t)::double, (length(t) - length(replace(t, 'e', '')))::double, (length(t) - length(replace(t, 'a', '')))::double, 1.0] as v from (select query_id, 'query: ' || coalesce(query_text, '') as t from splits))
select query_id, round(v[1] / sqrt(list_dot_product(v, v)), 4) as first, round(v[2] / sqrt(list_dot_product(v, v)), 4) as second, len(v) as dim from v""")
def encoder_hook(spark, d):
    """Any model as the encoder, loaded once per worker process, with a prefix before queries."""
    e = load(spark, d, "splits").select("query_id", retrieval.model_encoder(_toy_model, "query: ")("query_text").alias("v"))
    at = lambda i: F.round(F.col("v")[i].cast("double"), 4)
    return e.select("query_id", at(0).alias("first"), at(1).alias("second"), F.size("v").cast("long").alias("dim"))


def _stump(feature: str, threshold: float, low: float, high: float, missing_left: bool) -> dict:
    return {"feature": [ltr.FEATURES.index(feature), -1, -1], "threshold": [threshold, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "missing_left": [missing_left, True, True], "value": [0.0, low, high]}


#: A small model whose result SQL can state; trained ones are in ``ltr_rerank``.
FIXED = ltr.Model(trees=[_stump("rrf_score", 0.2, -1.0, 1.0, True), _stump("dense_rank", 3.0, 0.5, 0.0, False), _stump("bm25_score", 12.0, -0.25, 0.25, True)])
_RANKED = """ranked as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, rrf_score desc, doc_id) as int) as rank from (select query_id, doc_id, rrf_score, round(
case when rrf_score > 0.2 then 1.0::double else -1.0 end + case when dense_rank <= 3 then 0.5 else 0.0 end + case when bm25_score > 12 then 0.25 else -0.25 end, 9) as score from feat))"""


@query(f"""{c._FEAT}, {_RANKED}, conf as (select query_id, max(score) as top_cosine from vec group by query_id)
select query_id, doc_id, r.rank, r.score, top_cosine, coalesce(title, '?') as title from ranked r join conf using (query_id) left join (select doc_id, min(title) as title from corpus group by doc_id) using (doc_id) where r.rank <= 4""")
def hybrid_online(spark, d):
    """Both searches, features, a ranking model that was saved and loaded, the best four documents with their titles, and the best cosine."""
    to = Scratch(spark, "model").path + "/ranker"
    FIXED.save(spark, to)
    ranked = retrieval.search_hybrid(bm25_index(spark, d), corpus_vectors(spark, d), encoder(), c._val(spark, d), ltr.Model.load(spark, to))
    ranked = ranked.filter("top_score is not null").withColumnRenamed("top_score", "top_cosine")
    return retrieval.with_documents(ranked, load(spark, d, "corpus")).select("query_id", "doc_id", "rank", "score", "top_cosine", "title")


VARIANTS, SPLITS, METHODS = ("a", "b"), ("val", "test"), ("bm25", "dense", "hybrid", "ltr")


def _report_sql() -> str:
    parts = {"a": "title || chr(10) || chr(10) || answer_body", "b": "title || chr(10) || chr(10) || question_body || chr(10) || chr(10) || answer_body"}
    of = {"bm25": "code", "dense": "vec", "hybrid": "rrf", "ltr": "(select * from ranked where rank <= 100)"}
    out = []
    for v in VARIANTS:
        for s in SPLITS:
            base = f"{c._FEAT}, {_RANKED}, {c._rrf_sql('rrf')}".replace(c._DOCS_SQL, f"docs as (select doc_id, min({parts[v]}) as text from corpus group by doc_id)").replace("split = 'val'", f"split = '{s}'")
            rows = " union all ".join(f"select '{m}' as method, '{v}' as variant, '{s}' as split, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall, count(*) as n_queries from m_{m}" for m in METHODS)
            out.append(f"select * from ({base}, " + ", ".join(c._metrics_sql(f"m_{m}", of[m]) for m in METHODS) + f" {rows})")
    return " union all ".join(out)


@query(_report_sql())
def eval_report(spark, d):
    """Every method on every corpus variant and split."""
    judged, rows, names = Scratch(spark, "report").write(c._qrels(spark, d)), [], []
    queries = load(spark, d, "splits").select("split", "query_id", "query_text")
    for v in VARIANTS:
        for split in SPLITS:
            q = queries.filter(F.col("split") == split)
            rows.append(ltr.candidates(c._bm25(spark, d, queries=q, variant=v, packed=True), c._vectors(spark, d, q, v, packed=True), judged, run=len(rows)).rows)
            names += [(len(rows) - 1, m, v, split) for m in METHODS]
    hits = ltr.judged_ranks(ltr.Candidates(reduce(DataFrame.unionByName, rows)), FIXED)
    return metrics.report(hits, judged, queries, spark.createDataFrame(names, "run int, method string, variant string, split string"))


@query(c.SQL["rrf_sweep"].replace(" select 10 as k", ", sweep as (select 10 as k") + ") select * from sweep order by ndcg desc, k limit 1")
def best_rrf_k(spark, d):
    """The constant of the fusion with the best NDCG."""
    return ltr.best_of(c.rrf_sweep(spark, d), "ndcg", "k")


# --- raw posts ---


def _raw(spark, d):
    """Questions, answers and deletions in the form of a raw dump: one table, type codes, text as bytes, numbers as text."""
    b = lambda x: F.col(x).cast("binary")
    none = F.lit(None)
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    closed = F.when(F.col("is_closed"), stamp("2020-06-01 00:00:00")).when(~F.col("is_closed"), stamp("1970-01-01 00:00:00"))
    q = load(spark, d, "questions").select(
        F.col("id").alias("Id"), F.lit(1).alias("PostTypeId"), b("title").alias("Title"), b("body").alias("Body"), F.upper("tags").cast("binary").alias("Tags"), none.cast("binary").alias("ParentId"), F.col("accepted_answer_id").alias("AcceptedAnswerId"),
        F.col("score").alias("Score"), F.col("view_count").alias("ViewCount"), F.col("answer_count").alias("AnswerCount"), F.col("creation_date").alias("CreationDate"), closed.alias("ClosedDate"))
    a = load(spark, d, "answers").select(
        F.col("id").alias("Id"), F.lit(2).alias("PostTypeId"), none.cast("binary").alias("Title"), b("body").alias("Body"), none.cast("binary").alias("Tags"), F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("question_id").cast("string")).cast("binary").alias("ParentId"),
        none.cast("bigint").alias("AcceptedAnswerId"), F.col("score").alias("Score"), none.cast("int").alias("ViewCount"), none.cast("int").alias("AnswerCount"), F.col("creation_date").alias("CreationDate"), none.cast("timestamp_ntz").alias("ClosedDate"))
    other = load(spark, d, "post_deletions").select(
        F.col("post_id").alias("Id"), F.lit(5).alias("PostTypeId"), *[none.cast(t).alias(n) for n, t in (("Title", "binary"), ("Body", "binary"), ("Tags", "binary"), ("ParentId", "binary"), ("AcceptedAnswerId", "bigint"), ("Score", "int"), ("ViewCount", "int"), ("AnswerCount", "int"))],
        F.col("deleted_at").alias("CreationDate"), none.cast("timestamp_ntz").alias("ClosedDate"))
    return q.unionByName(a).unionByName(other)


@query("select 1 as post_type, count(*) as n from questions union all select 2, count(*) from answers union all select 5, count(*) from post_deletions")
def raw_type_counts(spark, d):
    return etl.type_counts(_raw(spark, d))


@query("""select id, title, body, lower(tags) as tags, accepted_answer_id, score, view_count, answer_count, creation_date, is_closed, accepted_answer_id > 0 and score >= 1 and not is_closed as is_eval_query from questions where contains(lower(tags), '|python|')""")
def raw_questions(spark, d):
    return etl.tagged(etl.typed_posts(_raw(spark, d))[0], "python")


@query("select id, case when id % 7 = 0 then null else question_id end as question_id, body, score, creation_date from answers")
def raw_answers(spark, d):
    return etl.typed_posts(_raw(spark, d))[1]


@query("select count(*) as n_raw, count(*) as n_clean, true as is_complete, count(*) - count(distinct id) as n_repeats from answers")
def clean_counts(spark, d):
    """As many cleaned answers as raw ones, and rows repeated under one id."""
    a = load(spark, d, "answers")
    return etl.same_counts(a, etl.clean_answers(a), "id")


@query("select * from questions order by id, loaded_at, score, view_count, answer_count limit 1")
def sample_row(spark, d):
    """One row to look at, the same on every run."""
    return load(spark, d, "questions").orderBy("id", "loaded_at", "score", "view_count", "answer_count").limit(1)


# --- text rules ---

_ESCAPED = (("a\\x0Ab", "a\nb"), ("caf\\xC3\\xA9", "café"), ("\\xFF", "�"), ("plain text", "plain text"), ("\\xe2\\x82\\xac", "€"), ("\\xZZ", "\\xZZ"), ("x \\x41\\x", "x A\\x"))
_HTML = (("<p>a<br>b</p>", "a\nb"), ("<p>Use <code>x</code></p><pre>y</pre>", "Use x\ny"), ('<a href="u">t</a><img src="i">', "t"), ("&#46backends", "&#46backends"), ("<b>open &amp; shut", "open & shut"), ("<script>x</script>a<!-- c -->b", "ab"),
         ("<ul><li>1</li><li>2</li></ul>end", "1\n2\n\nend"), ("a &lt; b &copy; c & d", "a < b © c & d"), ("x \\x26amp; y", "x & y"))


def _literals(cases) -> str:
    quoted = lambda s: " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))
    return "select * from (values " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in cases) + ") t(raw, text)"


@query(_literals(_ESCAPED))
def unescape_cases(spark, d):
    return spark.createDataFrame(_ESCAPED, "raw string, _ string").select("raw", tx.unescape_bytes("raw").alias("text"))


@query(_literals(_HTML))
def html_cases(spark, d):
    return spark.createDataFrame(_HTML, "raw string, _ string").select("raw", clean_html("raw").alias("text"))


@query("""select id, array_to_string(list_transform(string_split(body, '&'), lambda p, i: case when i = 1 then p when regexp_matches(p, '^(#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);') then '&' || p else '&amp;' || p end), '') as body from answers""")
def ampersands(spark, d):
    return load(spark, d, "answers").select("id", tx.escape_stray_ampersands("body").alias("body"))


@query("""select doc_id, 'https://example.org/a/' || doc_id as url, case when n >= 1048576 then printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) when n >= 1024 then printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) else n || ' B' end as size,
case when n >= 1024 then floor(n / 1024.0 + 0.5)::bigint || 'K' else n::varchar end as short from (select doc_id, strlen(text) * 3 as n from corpus)""")
def label_formats(spark, d):
    """Addresses, sizes and token counts as a reader sees them."""
    n = F.octet_length("text").cast("long") * 3
    return load(spark, d, "corpus").select("doc_id", tx.answer_url(F.col("doc_id"), "https://example.org/a/").alias("url"), tx.human_bytes(n).alias("size"), tx.short_count(n).alias("short"))


@query("""select vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) as total, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) as length from (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)""")
def unit_vectors(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", retrieval.normalised(F.col("embedding")).alias("e"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return e.select("vec_id", F.round(add(F.col("e")), 6).alias("total"), F.round(F.sqrt(retrieval.dot(F.col("e"), F.col("e"))), 6).alias("length"))


# --- answers ---


@query(f"{c._PROMPTS} select query_id, 'short: ' || (length(prompt) % 10) as answer_before, 'long: ' || length(prompt) as answer_after from prompts")
def answers_compared(spark, d):
    """Two generators on the same prompts; the second is made once per worker process."""
    prompts = Scratch(spark, "prompts").write(rag.build_prompts(c._val(spark, d), c._bm25(spark, d), load(spark, d, "corpus")))
    first = adaptive.generate_with(prompts, _first, "answer_before")
    return adaptive.generate_with(first, _second, "answer_after").select("query_id", "answer_before", "answer_after")


def _first():
    return lambda p: f"short: {len(p) % 10}"


def _second():
    return lambda p: f"long: {len(p)}"


def _claiming(prompt: str) -> str:
    """A stub that answers in JSON, or breaks off."""
    n = len(prompt)
    if n % 5 == 0:
        return '{"claims": [{"text": "cut'
    return '{"claims": [{"text": "size %d", "citations": [9, %d, 1, 1]}, {"text": "  ", "citations": [1]}]}' % (n, 1 + n % 4)


@query(f"{c._PROMPTS} select query_id, length(prompt) % 5 = 0 as is_empty, case when length(prompt) % 5 <> 0 then 'size ' || length(prompt) || ' ' || case when length(prompt) % 4 = 0 then '[1]' else '[1][' || (1 + length(prompt) % 4) || ']' end else '' end as answer from prompts")
def claims_generated(spark, d):
    """Claims out of a generator's JSON: cut replies are asked for again and then count as no claims."""
    prompts = rag.build_prompts(c._val(spark, d), c._bm25(spark, d), load(spark, d, "corpus"))
    return rag.generate_claims(prompts, _claiming, 4).select("query_id", (F.size("claims") == 0).alias("is_empty"), rag.readable(F.col("claims")).alias("answer"))


# --- history ---


@query(f"""with {c._MSG}, c as (select m.*, k.n_ctx - k.max_tokens - 48 - 9 as budget, len({c._tok("case when role = 'user' then 'User: ' else 'Assistant: ' end || content")}) * 40 as cost from m join (select distinct id, n_ctx, max_tokens from conversations where id is not null) k on k.id = m.conversation_id),
r as (select *, sum(cost) over (partition by conversation_id order by created_at desc, id desc rows between unbounded preceding and current row) as running from c)
select conversation_id, id, cast(running as bigint) as running from r where running <= budget""")
def history_window(spark, d):
    """What a conversation's context leaves for its history: n_ctx less the reply's share, a margin and the prompt itself."""
    k = load(spark, d, "conversations").filter("id is not null").select(F.col("id").alias("conversation_id"), history.context_budget(F.col("n_ctx"), F.col("max_tokens"), 9).alias("budget")).distinct()
    rows = c._messages(spark, d).join(k, "conversation_id")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    return history.fit_history(rows, F.col("budget"), F.size(tx.term_bag(line)) * 40).select("conversation_id", "id", "running")


_KNOWN = "conversation_id in (select id from conversations where id is not null)"


@query(f"""select id, conversation_id, rule from (select *, unnest(['role', 'content', 'conversation']) as rule from messages)
where case rule when 'role' then coalesce(role not in ('user', 'assistant'), true) when 'content' then content is null else not coalesce({_KNOWN}, false) end""")
def message_violations(spark, d):
    """Rows that break a rule of the history tables."""
    return history.violations(load(spark, d, "messages"), load(spark, d, "conversations"))


@query(f"""select 'kept' as what, count(*) as n, sum(id)::bigint as ids from messages where role in ('user', 'assistant') and content is not null and {_KNOWN}
union all select 'refused', count(*), sum(id)::bigint from messages where not coalesce(role in ('user', 'assistant') and content is not null and {_KNOWN}, false)""")
def chat_insert(spark, d):
    """All messages put into an empty history: the sound ones are in it, the others come back."""
    chats, empty = history.open_history(spark, Scratch(spark, "history").path)
    known = load(spark, d, "conversations").unionByName(chats)
    table, refused = history.insert_messages(empty, load(spark, d, "messages"), known)
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return count(table, "kept").unionByName(count(refused, "refused"))


@query("""select id, title, model, created_at, coalesce(n_ctx, 4096) as n_ctx from conversations
union all select 1, 'New chat', 'stub', 5.0, 4096""")
def conversation_insert(spark, d):
    """A conversation with a setting left to its default."""
    t = history.insert_conversation(load(spark, d, "conversations"), {"id": 1, "model": "stub", "created_at": 5.0, "n_ctx": None}, {"title": "New chat", "n_ctx": 4096, "temperature": 0.7})
    return t.select("id", "title", "model", "created_at", F.coalesce("n_ctx", F.lit(4096)).alias("n_ctx"))


@query("""with p as (select distinct id from conversations), last as (select max(id) as m from messages)
select m + 2 * id - 1 as id, id as conversation_id, 'user' as role, 'question ' || id as content, null as route from p, last where id % 5 <> 0
union all select m + 2 * id, id, 'assistant', 'reply to question ' || id, 'ANSWER' from p, last where id % 5 <> 0
union all select -1, id, 'refused', 'generation', null from p where id % 5 = 0 union all select -1, -3, 'refused', 'conversation', null""")
def post_flow(spark, d):
    """Questions posted to every conversation: both turns are kept, or neither where the generator fails or the conversation is unknown."""
    chats, messages = load(spark, d, "conversations"), load(spark, d, "messages")
    posts = chats.select(F.col("id").alias("post_id"), F.col("id").alias("conversation_id")).distinct().unionByName(spark.createDataFrame([(10**9, -3)], "post_id long, conversation_id long"))
    posts = posts.select("*", F.concat(F.lit("question "), F.col("post_id")).alias("content"), F.lit(1.8e9).alias("created_at"), F.concat(F.lit("question "), F.col("post_id")).alias("prompt"))
    answers = rag.generate(posts.select("post_id", "prompt"), _replying).withColumn("route", F.lit("ANSWER"))
    table, refused = history.post_messages(chats, messages, posts, answers)
    new = table.filter("created_at = 1.8e9").select("id", "conversation_id", "role", "content", "route")
    return new.unionByName(refused.select(F.lit(-1).cast("long").alias("id"), "conversation_id", F.lit("refused").alias("role"), F.col("reason").alias("content"), F.lit(None).cast("string").alias("route")))


def _replying(prompt: str) -> str:
    if int(prompt.split()[1]) % 5 == 0:
        raise TimeoutError("no answer")
    return f"reply to {prompt}"


@query("""select case when days <= 0 then 1 when days = 1 then 2 else 3 end as group_no, case when days <= 0 then 'today' when days = 1 then 'yesterday' else 'earlier' end as day_group, id, title, created_at
from (select *, date_diff('day', cast(make_timestamp(cast(created_at * 1000000 as bigint)) + interval '5 hours 30 minutes' as date), cast(make_timestamp(cast(1767900000.0 * 1000000 as bigint)) + interval '5 hours 30 minutes' as date)) as days from conversations where lower(title) like '%call%')""")
def sidebar_search(spark, d):
    """Conversations whose title has a text, in groups by local day and in order of display."""
    return history.sidebar_rows(load(spark, d, "conversations"), F.lit(1767900000.0), "  CALL ", "+05:30")


@query("select id, conversation_id, 'unknown' as author, used_docs::int as used_docs_code, used_docs from messages")
def history_migrated(spark, d):
    """A column added with its default, one that is there left alone, and the flag's coding both ways."""
    m = history.migrate(load(spark, d, "messages"), {"author": ("string", "unknown"), "role": ("string", "nobody")})
    m = m.withColumn("used_docs_code", history.coded_flag(F.col("used_docs")))
    return m.select("id", "conversation_id", "author", "used_docs_code", history.decoded_flag(F.col("used_docs_code")).alias("used_docs"))


@query("""with newest as (select id as conversation_id from conversations order by created_at desc, id desc limit 1)
select m.id, m.role, m.content from messages m where conversation_id = (select max(conversation_id) from messages where conversation_id in (select id from conversations) and id % 3 <> 0) and id % 3 <> 0""")
def messages_kept(spark, d):
    """The messages of one conversation after some were deleted, in order."""
    m = load(spark, d, "messages")
    m = history.delete_messages(m, m.filter("id % 3 = 0").select("id").distinct()).filter("id is not null")
    last = m.join(history.newest_first(load(spark, d, "conversations")).select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").agg(F.max("conversation_id")).first()[0]
    return history.messages_of(m, last if last is not None else -1).select("id", "role", "content")


@query("""select id, coalesce(list_transform(from_json(sources_json, '[{"title":"VARCHAR"}]'), lambda x: x.title)[1], '') as first_title, coalesce(json_array_length(sources_json), 0)::int as n from messages""")
def message_sources(spark, d):
    s = load(spark, d, "messages").select("id", history.source_titles(F.col("sources_json")).alias("s"))
    return s.select("id", F.coalesce(F.try_element_at("s", F.lit(1))["title"], F.lit("")).alias("first_title"), F.size("s").alias("n"))


# --- files ---


@query("select * from (values ('a.parquet', 10::bigint, 10::bigint, 'complete'), ('b.parquet', 10, 4, 'partial'), ('c.parquet', 10, 0, 'absent')) t(name, n_bytes, n_found, status)")
def manifest_check(spark, d):
    expected = spark.createDataFrame([("a.parquet", 10), ("b.parquet", 10), ("c.parquet", 10)], "name string, n_bytes long")
    return check_manifest(spark.createDataFrame([("a.parquet", 10), ("b.parquet", 4), ("x.parquet", 1)], "name string, n_bytes long"), expected)


@query("select id, body, accepted_answer_id, null as question_id from questions union all select id, body, null, question_id from answers")
def posts_union(spark, d):
    """Two tables of different columns, written by their stage and read as one."""
    to = Scratch(spark, "posts").path
    write_table(load(spark, d, "questions").select("id", "body", "accepted_answer_id"), to, "posts_1")
    write_table(load(spark, d, "answers").select("id", "body", "question_id"), to, "posts_2")
    return load_many(spark, f"{to}/posts_*.parquet").select("id", "body", "accepted_answer_id", "question_id")


@query("select query_id, split, length(query_text) as n from splits")
def stream_new_files(spark, d):
    """A stream that is run, stopped and run again when more files have come: every row is worked on once."""
    to = Scratch(spark, "stream").path
    rows = load(spark, d, "splits").select("query_id", "query_text", "split")
    for part in (F.col("split") == "train", F.col("split") != "train"):
        rows.filter(part).write.mode("append").parquet(f"{to}/in")
        work = lambda df: df.select("query_id", "split", F.length("query_text").alias("n"))
        process_new_files(spark, f"{to}/in", rows.schema, f"{to}/out", f"{to}/checkpoint", work, "query_id").awaitTermination()
    return spark.read.schema("query_id long, split string, n int").parquet(f"{to}/out")


@query("select distinct question_id from answers where question_id is not null and question_id not in (select id from questions where id is not null)")
def unmatched_answers(spark, d):
    """Questions that answers name and that are not there."""
    return adaptive.unmatched(load(spark, d, "answers").filter("question_id is not null"), load(spark, d, "questions").select(F.col("id").alias("question_id")), "question_id")
