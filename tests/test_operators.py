"""Small fixtures for rules that the tables do not reach."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankmill.operators import etl, history, ltr, metrics, rag, retrieval
from rankmill.operators.orphan_refs import Reference, orphan_counts, orphan_references
from rankmill.sources.tables import check_manifest, load
from rankmill.streaming.resume import process_new_files, resume

LIST = "query_id long, doc_id long, score double, rank int"


def test_raw_posts(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    raw = spark.createDataFrame(
        [(1, 1, b"T", b"B", b"|Python|", None, 5, 2, 1, 1, t(2020), t(1970)), (2, 1, b"T", b"B", b"|c|", None, 5, 2, 1, 1, t(2020), t(2021)), (3, 1, b"T", b"B", b"|python|", None, 5, 2, 1, 1, t(2020), None), (4, 2, None, b"A", None, b"1", None, 0, None, None, t(2020), None), (5, 2, None, b"A", None, b"x", None, 0, None, None, t(2020), None)],
        "Id long, PostTypeId int, Title binary, Body binary, Tags binary, ParentId binary, AcceptedAnswerId long, Score int, ViewCount int, AnswerCount int, CreationDate timestamp_ntz, ClosedDate timestamp_ntz",
    )
    q, a = etl.typed_posts(raw)
    assert {r["id"]: (r["is_closed"], r["is_eval_query"]) for r in q.collect()} == {1: (False, True), 2: (True, False), 3: (None, None)}
    assert [r["id"] for r in etl.tagged(q, "python").collect()] == [1, 3]
    assert {r["id"]: r["question_id"] for r in a.collect()} == {4: 1, 5: None}
    assert [r["id"] for r in etl.answers_of(a, q).collect()] == [4]


def test_not_in_with_null(spark):
    q = spark.createDataFrame([(1, 9, True), (2, 7, True), (3, None, True), (4, 9, None)], "id long, accepted_answer_id long, is_eval_query boolean")
    flags = lambda ids: {r["id"]: r["is_eval_query"] for r in etl.finalise_eval_flag(q, spark.createDataFrame(ids, "id long")).collect()}
    assert flags([(7,)]) == {1: False, 2: True, 3: True, 4: None}
    assert flags([(7,), (None,)]) == {1: True, 2: True, 3: True, 4: None}


def test_grades_and_splits(spark):
    df = spark.createDataFrame([(True, -5), (False, 4), (False, 3), (False, 1), (False, 0)], "a boolean, s int")
    assert [r[0] for r in df.select(etl.grade(F.col("a"), F.col("s"))).collect()] == [3, 2, 1, 1, 0]
    days = spark.createDataFrame([(dt.datetime(2020, 12, 31),), (dt.datetime(2021, 1, 1),), (dt.datetime(2022, 1, 1),)], "d timestamp_ntz")
    assert [r[0] for r in days.select(etl.split_of(F.col("d"))).collect()] == ["train", "val", "test"]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 10, 1.0, 1), (1, 20, 0.5, 2), (2, 1, 1.0, 1)], LIST)
    b = spark.createDataFrame([(1, 20, 1.0, 1), (1, 10, 0.5, 2)], LIST)
    out = [tuple(r)[:2] + (round(r["score"], 6), r["rank"]) for r in retrieval.fuse_rrf([a, b], 5).orderBy("query_id", "rank").collect()]
    assert out == [(1, 10, 0.309524, 1), (1, 20, 0.309524, 2), (2, 1, 0.166667, 1)]


def test_metrics(spark):
    qrels = spark.createDataFrame([(1, 1, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (4, 1, 0)], "query_id long, doc_id long, grade int")
    ranked = spark.createDataFrame([(1, 9, 1.0, 1), (1, 1, 0.5, 2), (2, 9, 1.0, 1), (2, 1, 0.5, 2), (2, 2, 0.4, 3)], LIST)
    got = {r["query_id"]: (round(r["ndcg"], 6), r["mrr"], r["recall"]) for r in metrics.per_query(ranked, qrels).collect()}
    assert got[1] == (0.63093, 0.5, 1.0) and got[2][1:] == (0.5, 1.0)
    assert got[3] == (0.0, 0.0, 0.0) and got[4] == (0.0, 0.0, 0.0)
    assert metrics.evaluate(ranked, qrels.filter("false")).first()["ndcg"] is None
    x = spark.createDataFrame([(1, 0.05), (2, 0.5), (3, 0.7), (4, 0.5)], "query_id long, ndcg double")
    y = spark.createDataFrame([(1, 0.09), (2, 0.7), (3, 0.5), (4, 0.55)], "query_id long, ndcg double")
    assert [r["bucket"] for r in metrics.compare(x, y).orderBy("query_id").collect()] == ["both_fail", "b_wins", "a_wins", "tie"]


def test_dense_is_exact(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    want = {(i, int(j)) for i, s in enumerate(np.round(q @ v.T, 6)) for j in np.lexsort((np.arange(300), -s))[:5]}
    for small in (True, False):
        got = {(r["query_id"], r["doc_id"]) for r in retrieval.search_dense(docs, queries, 5, *((64, 512) if small else ())).collect()}
        assert got == want
    assert retrieval.search_dense(docs.filter("false"), queries, 5).count() == 0
    assert spark.range(1).select(retrieval.normalised(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a a c")], "doc_id long, text string")
    ix = retrieval.build_bm25(docs)
    assert ix.stats.first()["n_docs"] == 4
    q = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "zzz")], "query_id long, query_text string")
    assert {r["query_id"] for r in retrieval.search_bm25(ix, q).collect()} == {1}
    assert retrieval.search_bm25(retrieval.build_bm25(docs.filter("false")), q).count() == 0
    g = retrieval.confidence_gate(spark.createDataFrame([(1, 1, 0.7, 1), (2, 1, 0.699, 1)], LIST))
    assert {r["query_id"]: r["gate"] for r in g.collect()} == {1: "open", 2: "closed"}


def test_lambdamart_learns():
    rng = np.random.default_rng(1)
    rows = []
    for q in range(60):
        x = rng.normal(size=(30, 5))
        x[rng.random((30, 5)) < 0.1] = np.nan
        s = np.nan_to_num(x[:, 0]) + 0.5 * np.nan_to_num(x[:, 2])
        rows.append(pd.DataFrame(x, columns=ltr.FEATURES).assign(query_id=q, doc_id=range(30), label=np.select([s > 1.5, s > 0.8], [3, 1], 0)))
    train, valid = pd.concat(rows[:40]), pd.concat(rows[40:])
    m = ltr.fit(train, valid, ltr.Params(min_rows=10, rounds=40))
    y, starts = valid["label"].to_numpy(float), np.arange(0, 601, 30)
    assert m.best_ndcg > ltr.mean_ndcg(rng.normal(size=600), y, starts, 10) + 0.3
    again = ltr.Model.loads(m.dumps())
    x = valid[ltr.FEATURES].to_numpy(float)
    assert np.allclose(again.predict(x), m.predict(x))
    assert m.importance["bm25_score"] > m.importance["rrf_score"]
    assert len({str(c) for c in ltr.configurations(12)}) == 12


def test_claims_and_verdicts(spark):
    js = '[{"text":"t","citations":[3,1,1,9]},{"text":"  ","citations":[]},{"text":"u","citations":[]}]'
    df = spark.createDataFrame([(1, "b", js), (2, "b", "broken"), (3, "b", None)], "query_id long, bucket string, claims_json string")
    rows = rag.claim_rows(df, 4).orderBy("claim_idx").collect()
    assert [(r["claim"], r["cited_refs"], r["uncited"]) for r in rows] == [("t", [1, 3], False), ("u", [1, 2, 3, 4], True)]
    v = spark.createDataFrame([("Verdict: yes … VERDICT: NO",), ("maybe",), (None,)], "r string")
    assert [r[0] for r in v.select(rag.parse_verdict(F.col("r"))).collect()] == ["no", "unparsed", "unparsed"]
    j = spark.createDataFrame([(1, "b", "yes"), (1, "b", "partial"), (1, "b", "unparsed"), (2, "b", "unparsed")], "query_id long, bucket string, label string")
    out = rag.faithfulness_by_bucket(j, j).first()
    assert (out["faithfulness"], out["n_scored"], out["n_queries"]) == (0.75, 1, 2)
    assert rag.generate(spark.createDataFrame([("p",)], "prompt string"), lambda p: 1 / 0).first()["reply"] is None


def test_history(spark):
    m = spark.createDataFrame([(1, 1, "user", "a", 1.0, 4), (2, 1, "user", "b", 2.0, 5), (3, 1, "user", "c", 3.0, 3)], "id long, conversation_id long, role string, content string, created_at double, n int")
    assert {r["id"] for r in history.fit_history(m, 10, F.col("n")).collect()} == {2, 3}
    c = spark.createDataFrame([(1, "t", None), (2, "u", 5)], "id long, title string, max_tokens int")
    up = history.partial_update(c, spark.createDataFrame([(1, None, 7)], "id long, title string, max_tokens int"))
    assert {tuple(r) for r in up.collect()} == {(1, "t", 7), (2, "u", 5)}
    left, msgs = history.cascade_delete(c, m, c.filter("id = 1").select("id"))
    assert left.count() == 1 and msgs.count() == 0
    assert history.insert_conversation(c, {"id": 3}, {"title": "New"}).filter("id = 3").first()["title"] == "New"
    bad = m.withColumn("role", F.lit("system"))
    table, refused = history.insert_messages(m, bad.unionByName(m.limit(1).withColumn("id", F.lit(9).cast("long")).withColumn("conversation_id", F.lit(77).cast("long"))), c)
    assert table.count() == 3 and {(r["id"], tuple(r["rules"])) for r in refused.collect()} == {(1, ("role",)), (2, ("role",)), (3, ("role",)), (9, ("conversation",))}
    table, refused = history.insert_messages(m, m.withColumn("id", F.col("id") + 10).drop("n"), c)
    assert table.count() == 6 and table.filter("n is null").count() == 3 and refused.count() == 0
    posts = spark.createDataFrame([(1, 1, "q1", 9.0), (2, 5, "q2", 9.0), (3, 2, "q3", 9.0)], "post_id long, conversation_id long, content string, created_at double")
    replies = spark.createDataFrame([(1, "r1", 7), (2, "r2", 7), (3, None, 7)], "post_id long, reply string, n int")
    table, refused = history.post_messages(c, m, posts, replies)
    assert {(r["id"], r["role"], r["content"], r["n"]) for r in table.filter("id > 3").collect()} == {(4, "user", "q1", None), (5, "assistant", "r1", 7)}
    assert {(r["post_id"], r["reason"]) for r in refused.collect()} == {(2, "conversation"), (3, "generation")}
    assert history.fit_history(m, F.lit(-1), F.col("n")).count() == 0 and history.fit_history(m, F.lit(100), F.col("n")).count() == 3
    free = m.withColumn("n", F.when(F.col("id") == 2, 11).otherwise(0))
    assert {r["id"] for r in history.fit_history(free, 10, F.col("n")).collect()} == {3}
    assert history.migrate(c, {"n_ctx": ("int", 8192)}).first()["n_ctx"] == 8192
    assert history.delete_messages(m, spark.createDataFrame([(1,)], "id long")).count() == 2
    s = spark.createDataFrame([('["a"]',), ('[{"title":"b","url":"u"}]',), (None,)], "j string").select(history.source_titles(F.col("j")).alias("s"))
    assert [[tuple(x) for x in r["s"]] for r in s.collect()] == [[("a", None)], [("b", "u")], []]


def test_orphans_edges(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    cols = "id long, ref long, loaded_at timestamp_ntz, creation_date timestamp_ntz, has_parent string"  # a clashing extra column
    child = spark.createDataFrame([(1, 10, t(1), t(1), "x"), (1, 10, t(3), t(1), "x"), (2, 0, t(1), t(1), None), (3, None, t(1), t(1), None), (4, 11, t(1), None, None), (5, 12, t(5), t(1), None), (6, 13, None, t(1), None), (None, 14, t(1), t(1), None)], cols)
    parent = spark.createDataFrame([(10, t(2)), (12, t(2)), (13, t(9)), (None, t(1))], "id long, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([(11, "p"), (10, "p"), (12, "other")], "post_id long, post_kind string")
    found = orphan_references([Reference("c", child, "ref", "p", parent, "p")], gone)
    assert {(r["record_id"], r["status"], r["period"]) for r in found.collect()} == {(1, "late", dt.date(2020, 1, 1)), (4, "deleted", None)}
    assert orphan_counts(found).count() == 2
    assert orphan_references([Reference("c", child.filter("false"), "ref", "p", parent, "p")], gone).count() == 0
    hot = spark.range(3000).select(F.col("id"), F.lit(99).cast("long").alias("ref"), F.lit(t(1)).cast("timestamp_ntz").alias("loaded_at"), F.lit(t(1)).cast("timestamp_ntz").alias("creation_date"))
    assert orphan_references([Reference("c", hot, "ref", "p", parent, "p")], gone).count() == 3000


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing"):
        load(spark, str(tmp_path), "nothing")
    want = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, n_bytes long")
    got = spark.createDataFrame([("a", 5), ("b", 4)], "name string, n_bytes long")
    assert {r["name"]: r["status"] for r in check_manifest(got, want).collect()} == {"a": "complete", "b": "partial", "c": "absent"}


def test_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    items.write.parquet(src)
    work = lambda df: df.withColumn("n", F.length("t"))
    for more in (None, [(2, "b"), (3, "c")]):
        if more:
            spark.createDataFrame(more, items.schema).write.mode("append").parquet(src)
        process_new_files(spark, src, items.schema, out, ck, work, "id").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    assert resume(items, items.filter("id = 1"), "id", work).count() == 1


def test_adaptive(spark):
    from rankmill.operators import adaptive

    q = spark.createDataFrame([(1, "find it"), (2, "find"), (3, "hello"), (4, None)], "query_id long, query_text string")
    ranked = spark.createDataFrame([(1, 7, 0.9, 1), (2, 7, 0.5, 1)], LIST)
    corpus = spark.createDataFrame([(7, "T", "B")], "doc_id long, title string, answer_body string")
    rows = {r["query_id"]: r for r in adaptive.adaptive_answers(q, lambda t: "SEARCH" if "find" in t else "no", lambda p: p[:8], ranked, ranked, corpus).collect()}
    assert [(rows[i]["route"], rows[i]["gate"], rows[i]["n_sources"]) for i in (1, 2, 3, 4)] == [("SEARCH", "open", 1), ("SEARCH", "closed", 0), ("ANSWER", None, 0), ("ANSWER", None, 0)]
    assert rows[1]["trace"] == "from 1 document(s), best match 0.90"
    claims = spark.createDataFrame([(1, "b", 1, "c", [1, 9], False)], "query_id long, bucket string, claim_idx int, claim string, cited_refs array<int>, uncited boolean")
    src = spark.createDataFrame([(1, [7])], "query_id long, top_k_doc_ids array<long>")
    assert "[1] T\n\nB\n\n[9] ?" in adaptive.judge_prompts(claims, src, corpus).first()["prompt"]
    assert adaptive.judge(claims, src, corpus, lambda p: "VERDICT: partial").first()["label"] == "partial"
    with pytest.raises(ValueError, match="2 values"):
        adaptive.require_matched(q, ranked.filter("query_id = 1").unionByName(ranked.filter("query_id = 2")), "query_id", "ranking")
    both = adaptive.compare_answers(spark.createDataFrame([("p",)], "prompt string"), str.upper, str.lower).first()
    assert (both["answer_before"], both["answer_after"]) == ("P", "p")
    assert adaptive.generate_with(spark.createDataFrame([("p",)], "prompt string"), lambda: str.upper).first()["reply"] == "P"


def test_bm25_prunes_exactly(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    pick = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    docs, queries = [(i, pick(rng.randint(0, 30))) for i in range(400)], [(i, pick(rng.randint(1, 7))) for i in range(30)]
    terms = {i: Counter(t.split()) for i, t in docs}
    avg = sum(sum(c.values()) for c in terms.values()) / len(docs)
    df = Counter(w for c in terms.values() for w in c)
    want = set()
    for qid, text in queries:
        s = {}
        for w, n in Counter(text.split()).items():
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in terms.items():
                if c[w]:
                    s[i] = s.get(i, 0) + n * idf * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
        want |= {(qid, i) for i, _ in sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:7]}
    index = retrieval.build_bm25(spark.createDataFrame(docs, "doc_id long, text string"))
    frame = spark.createDataFrame(queries, "query_id long, query_text string")
    for seeds, direct in ((1, 0), (3, 0), (3, 10**9)):
        assert {(r["query_id"], r["doc_id"]) for r in retrieval.search_bm25(index, frame, 7, seeds=seeds, direct=direct).collect()} == want


def test_ltr_validates_on_all_queries(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(70):
        x = rng.normal(size=(12, 5))
        s = x[:, 0] + rng.normal(size=12)
        rows.append(pd.DataFrame(x, columns=ltr.FEATURES).assign(query_id=q, doc_id=range(12), label=np.select([s > 1.5, s > 0.8], [3, 1], 0)))
    a, b = pd.concat(rows[:20]), pd.concat(rows[20:])
    train, valid = spark.createDataFrame(a), spark.createDataFrame(b)
    few = ltr.sample_queries(train, 10).toPandas()
    p = ltr.Params(min_rows=5, rounds=12, patience=3)
    want, got = ltr.fit(few, b, p), ltr.train(train, valid, p, queries=10)
    assert len(got.trees) == len(want.trees) and abs(got.best_ndcg - want.best_ndcg) < 1e-9
    for r in ltr.tune(train, valid, n=2, queries=10).collect():
        want = ltr.fit(few, b, ltr.configurations(2)[r["config_id"]])
        assert (r["n_trees"], r["ndcg"]) == (len(want.trees), round(want.best_ndcg, 6))


def test_search_leaves_final_lists_only(spark):
    """Many queries: no list of hits or of local lists is shuffled, and both searches agree with brute force over several blocks and slices."""
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{chr(97 + j)}" for j in rng.integers(0, 20, rng.integers(0, 9)))) for i in range(300)]
    queries = [(i, " ".join(f"w{chr(97 + j)}" for j in rng.integers(0, 20, 3))) for i in range(2100)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "query_id long, query_text string")
    index = retrieval.build_bm25(d)
    found = retrieval.search_bm25(index, q, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # terms of the queries and of the index; hits are not added up in a shuffle
    weights = {(r["term"], r["doc_id"]): r["weight"] for r in index.postings().collect()}
    want = set()
    for i, text in queries:
        s = {j: round(sum(weights.get((w, j), 0.0) for w in text.split()), 6) for j, t in docs if set(text.split()) & set(t.split())}
        want |= {(i, j, n + 1) for n, j in enumerate(sorted(s, key=lambda j: (-s[j], j))[:4])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()} == want
    encode = retrieval.hash_embed(16)
    v, m = (x.select(k, encode(c).alias("embedding")) for x, k, c in ((d, "doc_id", "text"), (q, "query_id", "query_text")))
    a, b = {r[0]: np.array(r[1]) for r in v.collect()}, {r[0]: np.array(r[1]) for r in m.collect()}
    ids = np.array(sorted(a))
    dots = {i: np.round(np.stack([a[j] for j in ids]) @ x, 6) + 0.0 for i, x in b.items()}
    want = {(i, int(ids[j]), n + 1) for i, s in dots.items() for n, j in enumerate(np.lexsort((ids, -s))[:4])}
    for size in (64, 16 << 20):
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.search_dense(v, m, 4, chunk_bytes=size * 128).collect()} == want


def test_ltr_trains_on_all_queries(spark):
    """Trees grown in parts are those of a single machine over all training queries, with missing values."""
    rng = np.random.default_rng(5)
    rows = []
    for q in range(90):
        x = rng.normal(size=(12, 5))
        s = x[:, 0] + rng.normal(size=12)
        x[rng.random(x.shape) < 0.2] = np.nan
        rows.append(pd.DataFrame(x, columns=ltr.FEATURES).assign(query_id=q, doc_id=range(12), label=np.select([s > 1.5, s > 0.8], [3, 1], 0)))
    a, b = pd.concat(rows[:60]), pd.concat(rows[60:])
    train, valid = (spark.createDataFrame(x).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ltr.FEATURES], "query_id", "doc_id", "label") for x in (a, b))
    p = ltr.Params(min_rows=5, rounds=10, patience=10)
    want, got = ltr.fit(a, b, p), ltr.train(train, valid, p)
    assert got.trees == want.trees and got.importance == want.importance
    for r in ltr.tune(train, valid, n=3).collect():
        want = ltr.fit(a, b, ltr.configurations(3)[r["config_id"]])
        assert (r["n_trees"], r["ndcg"]) == (len(want.trees), round(want.best_ndcg, 6))
    edges = ltr._quantiles([c[~np.isnan(c)] for c in a[ltr.FEATURES].to_numpy().T], np.linspace(0, 1, 9)[1:-1], lambda x: x)
    assert np.allclose(edges, [np.nanquantile(a[c], np.linspace(0, 1, 9)[1:-1]) for c in ltr.FEATURES], atol=1e-12)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_come_from_the_index(spark, folder):
    """The index's counts give the encoder's vectors, and stored vectors are searched without a copy."""
    from rankmill import session
    from rankmill.plans import stores

    docs = spark.createDataFrame([(1, "readCsv read_csv pandas"), (2, None), (3, "a b a"), (4, "1 2")], "doc_id long, text string").repartition(2)
    want = {r[0]: r[1] for r in docs.select("doc_id", retrieval.hash_embed(16)("text")).collect()}
    assert {r[0]: r[1] for r in retrieval.hash_vectors(retrieval.build_bm25(docs), 16).collect()} == want
    path = stores.corpus_vectors(spark, folder)
    made = len(session._made)
    q = spark.createDataFrame([(i, "pandas read csv") for i in range(3)], "query_id long, query_text string").select("query_id", stores.encoder()("query_text").alias("embedding"))
    got = [tuple(r) for r in retrieval.search_dense(path, q, 5).orderBy("query_id", "rank").collect()]
    assert len(session._made) == made
    assert got == [tuple(r) for r in retrieval.search_dense(retrieval.load_vectors(spark, path), q, 5).orderBy("query_id", "rank").collect()]


def test_dense_decides_in_double_precision(spark):
    """Scores that single precision can't tell apart keep their order, and a query's rows under one id share a list."""
    docs = spark.createDataFrame([(i, [100.0, i * 1e-5]) for i in range(50)] + [(99, [float("nan"), 1.0])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, -1.0])] + [(i, [0.0, 1.0]) for i in range(2, 3000)], "query_id long, embedding array<double>")
    rows = retrieval.search_dense(docs, queries, 3).filter("query_id <= 2").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in rows] == [(1, 49, 1), (1, 48, 2), (1, 47, 3), (2, 49, 1), (2, 48, 2), (2, 47, 3)]


def test_features_meet_in_one_shuffle(spark):
    a = spark.createDataFrame([(1, 5, 3.0, 1), (1, None, 2.0, 2)], LIST)
    b = spark.createDataFrame([(1, 5, 0.5, 2), (2, 6, 0.9, 1), (1, None, 0.4, 3)], LIST)
    qrels = spark.createDataFrame([(1, 5, 3), (1, 9, 2), (1, None, 1)], "query_id long, doc_id long, grade int")
    f = ltr.build_features(a, b, qrels)
    assert _plan(f).count("Repartition") == 1 and "Join" not in _plan(f)
    got = sorted((r["query_id"], r["doc_id"] or 0, r["bm25_score"] or 0, r["dense_rank"] or 0, r["label"]) for r in f.collect())
    assert got == [(1, 0, 0, 3.0, 0), (1, 0, 2.0, 0, 0), (1, 5, 3.0, 2.0, 3), (2, 6, 0, 1.0, 0)]


def test_searches_are_made_once(spark, folder):
    from rankmill.plans import catalog

    assert "MapInArrow" not in _plan(catalog.failure_examples(spark, folder))


def test_texts_are_not_multiplied(spark):
    """References are put together per query, not per claim; documents are carried once to the prompts."""
    from rankmill.operators import adaptive

    claims = spark.createDataFrame([(1, 1, "c", [1, 2])], "query_id long, claim_idx int, claim string, cited_refs array<int>")
    src, corpus = spark.createDataFrame([(1, [7])], "query_id long, top_k_doc_ids array<long>"), spark.createDataFrame([(7, "T", "B"), (7, None, "A")], "doc_id long, title string, answer_body string")
    p = adaptive.judge_prompts(claims, src, corpus)
    assert "explode(cited_refs" not in _plan(p) and "[1] T\n\nA\n\n[2] ?\n\n\n\nClaim: c" in p.first()["prompt"]
    q, ranked = spark.createDataFrame([(1, "why")], "query_id long, query_text string"), spark.createDataFrame([(1, 7, 0.9, 1)], LIST)
    p = rag.build_prompts(q, ranked, corpus)
    assert "min_by" not in _plan(p) and p.first()["prompt"].endswith("[1] ?\n\nA")


def test_training_features_are_not_stored(spark, folder):
    from rankmill.plans import catalog

    train, valid = catalog._train_valid(spark, folder)
    assert "MapInArrow" in _plan(train) and "MapInArrow" not in _plan(valid)


def test_flow_reads_what_it_uses(spark, folder):
    """Four documents and the best cosine: longer lists are not kept."""
    from rankmill.plans import catalog

    assert "rankmill-flow" not in " ".join(catalog.adaptive_flow_low(spark, folder).inputFiles())


def test_eval_report_plan(spark, folder):
    """All methods, variants and splits come from one plan whose lists meet once (finding 6)."""
    from rankmill.plans import catalog_more

    plan = catalog_more.QUERIES["eval_report"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") < 100


def test_packed_lists():
    """Lists come back as they were, and take under 8 bytes a document."""
    rng = np.random.default_rng(1)
    ids, scores = rng.integers(0, 1_000_000, 100), np.round(np.sort(rng.random(100) * 30)[::-1], 6)
    cases = ((ids, scores), (np.array([-(2**63), 2**60, -5]), np.array([np.nan, 1 / 3, -1e300])), (ids[:1], np.zeros(1)))
    for d, s in cases:
        a, b = retrieval.unpack(retrieval.pack(d, s))
        assert a.tolist() == d.tolist() and b.tobytes() == s.tobytes()
    assert len(retrieval.pack(ids, scores)) < 800


def test_candidates_are_features(spark):
    """Packed lists, also in parts, give the features that tables give, and the same order."""
    docs = spark.createDataFrame([(i, " ".join(["apple", "pear", "plum", "fig"][j % 4] for j in range(i % 7 + 1))) for i in range(60)] + [(None, "apple fig")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple"), (2, "fig pear"), (3, "none"), (4, "plum plum apple")], "query_id long, query_text string")
    qrels = spark.createDataFrame([(1, 3, 2), (2, 5, 1), (2, None, 3), (9, 3, 1)], "query_id long, doc_id long, grade int")
    index, embedded = retrieval.build_bm25(docs), queries.select("query_id", retrieval.hash_embed(64)("query_text").alias("embedding"))
    vectors = retrieval.hash_vectors(index, 64)
    want = ltr.build_features(retrieval.search_bm25(index, queries, 10), retrieval.search_dense(vectors, embedded, 10), qrels, 5, 8)
    packed = ltr.candidates(retrieval.search_bm25(index, queries, 10, packed=True), retrieval.search_dense(vectors, embedded, 10, packed=True), qrels, 5, 8)
    got = packed.features()
    order = lambda x: sorted(map(repr, x.collect()))
    assert order(got.select(want.columns)) == order(want)
    model = ltr.Model(trees=[{"feature": [4, -1, -1], "threshold": [0.2, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "missing_left": [True] * 3, "value": [0.0, -1.0, 1.0]}])
    assert order(ltr.rerank(packed, model, 4).drop("top_score")) == order(ltr.rerank(want, model, 4))


def test_ltr_tune_trains_on_packed_lists(spark, folder):
    """Training reads the packed lists after one shuffle by query, without a table of features before it (finding 9)."""
    from rankmill.plans import catalog

    for part in catalog._train_valid(spark, folder):
        assert isinstance(part, ltr.Candidates)
        assert "bm25_score" not in part.rows._jdf.queryExecution().executedPlan().toString()


def test_hybrid_online_plan(spark, folder):
    """Both lists meet packed and are ranked there: no table of hits is sorted or written (finding 7)."""
    from rankmill.plans import catalog_more

    plan = catalog_more.QUERIES["hybrid_online"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("found#") > 1
