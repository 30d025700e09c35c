"""From raw posts to questions, answers, corpus, judgements and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions.html_text import clean_html
from rankmill.functions.text import has_tag, unescape_entities


def typed_posts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and answers out of one table of raw posts whose text columns may be binary.

    Parents that are no numbers become NULL; a close date before 2005 means open, a NULL one
    leaves the flags NULL.
    """
    q = raw.filter(F.col("PostTypeId") == 1)
    opened = F.year("ClosedDate") < 2005
    questions = q.select(
        F.col("Id").cast("long").alias("id"), F.col("Title").cast("string").alias("title"), F.col("Body").cast("string").alias("body"), F.lower(F.col("Tags").cast("string")).alias("tags"),
        F.col("AcceptedAnswerId").cast("long").alias("accepted_answer_id"), F.col("Score").cast("int").alias("score"), F.col("ViewCount").cast("int").alias("view_count"),
        F.col("AnswerCount").cast("int").alias("answer_count"), F.col("CreationDate").alias("creation_date"), (~opened).alias("is_closed"),
        ((F.col("AcceptedAnswerId") > 0) & (F.col("Score") >= 1) & opened).alias("is_eval_query"),
    )
    a = raw.filter(F.col("PostTypeId") == 2)
    answers = a.select(
        F.col("Id").cast("long").alias("id"), F.col("ParentId").cast("string").try_cast("long").alias("question_id"), F.col("Body").cast("string").alias("body"),
        F.col("Score").cast("int").alias("score"), F.col("CreationDate").alias("creation_date"),
    )
    return questions, answers


def type_counts(raw: DataFrame) -> DataFrame:
    """Rows per type code, in order of the code."""
    return raw.groupBy(F.col("PostTypeId").alias("post_type")).agg(F.count("*").alias("n")).orderBy("post_type")


def same_counts(raw: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Rows before and after cleaning, whether they are as many, and rows repeated under one key."""
    one = raw.agg(F.count("*").alias("n_raw")).crossJoin(clean.agg(F.count("*").alias("n_clean"), (F.count("*") - F.countDistinct(key)).alias("n_repeats")))  # one row each
    return one.select("n_raw", "n_clean", (F.col("n_raw") == F.col("n_clean")).alias("is_complete"), "n_repeats")


def tagged(questions: DataFrame, *tags: str) -> DataFrame:
    return questions.filter(has_tag("tags", *tags))


def answers_of(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers whose question is there."""
    return answers.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi")


def finalise_eval_flag(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """The evaluation flag, withdrawn where the accepted answer is not there.

    As with NOT IN: one NULL among the answers' ids leaves every flag as it was.
    """
    ids = answers.agg(F.count_if(F.col("id").isNull()).alias("n_null"))
    known = answers.filter("id is not null").select(F.col("id").alias("accepted_answer_id")).distinct().withColumn("known", F.lit(True))
    lost = F.col("is_eval_query") & F.col("accepted_answer_id").isNotNull() & F.col("known").isNull() & (F.col("n_null") == 0)
    rows = questions.drop("known").join(known, "accepted_answer_id", "left").crossJoin(F.broadcast(ids))  # one row
    return rows.withColumn("is_eval_query", F.when(lost, False).otherwise(F.col("is_eval_query"))).select(questions.columns)


def clean_questions(questions: DataFrame) -> DataFrame:
    """Titles without character references, bodies as plain text in a last column ``body_clean``."""
    return questions.withColumn("title", unescape_entities("title")).withColumn("body_clean", clean_html("body")).drop("body")


def clean_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("body_clean", clean_html("body")).drop("body")


def build_corpus(questions: DataFrame, answers: DataFrame, question_body: str = "body_clean", answer_body: str = "body_clean") -> DataFrame:
    """One document per answer of a known question."""
    q, a = questions.alias("q"), answers.alias("a")
    return a.join(q, F.col("a.question_id") == F.col("q.id")).select(
        F.col("a.id").alias("doc_id"), F.col("a.question_id").alias("question_id"), F.col("q.title").alias("title"), F.col(f"q.{question_body}").alias("question_body"), F.col(f"a.{answer_body}").alias("answer_body"),
        F.concat("q.title", F.lit("\n\n"), f"a.{answer_body}").alias("text"), F.col("a.score").alias("answer_score"), (F.col("a.id") == F.col("q.accepted_answer_id")).alias("is_accepted"), F.col("q.is_eval_query").alias("from_eval_query"),
    )


def grade(is_accepted: Column, score: Column, good: int = 4, fair: int = 1) -> Column:
    """3 for the accepted answer, else 2, 1 or 0 by score."""
    return F.when(is_accepted, 3).when(score >= good, 2).when(score >= fair, 1).otherwise(0)


def build_qrels(corpus: DataFrame) -> DataFrame:
    """Graded judgements ``(query_id, doc_id, grade)`` of evaluation questions' answers; rows repeated in the corpus count once."""
    rows = corpus.filter("from_eval_query").select(F.col("question_id").alias("query_id"), "doc_id", grade(F.col("is_accepted"), F.col("answer_score")).alias("grade"))
    return rows.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def split_of(created: Column, val_year: int = 2021, test_year: int = 2022) -> Column:
    return F.when(F.year(created) < val_year, "train").when(F.year(created) < test_year, "val").otherwise("test")


def split_queries(questions: DataFrame, val_year: int = 2021, test_year: int = 2022) -> DataFrame:
    """Evaluation questions by the time they were asked."""
    return questions.filter("is_eval_query").select(F.col("id").alias("query_id"), F.col("title").alias("query_text"), "creation_date", split_of(F.col("creation_date"), val_year, test_year).alias("split"))


def posts_summary(questions: DataFrame, answers: DataFrame) -> DataFrame:
    q = questions.agg(F.count("*").alias("n_questions"), F.count_if("is_eval_query").alias("n_eval"), F.count_if("is_closed").alias("n_closed"), F.min("creation_date").cast("date").alias("earliest"), F.max("creation_date").cast("date").alias("latest"))
    return q.crossJoin(answers.agg(F.count("*").alias("n_answers")))  # one row each


def missing_values(questions: DataFrame) -> DataFrame:
    """How often each kind of absent value occurs."""
    return questions.agg(
        F.count_if(F.expr("accepted_answer_id = 0")).alias("n_no_accepted_zero"), F.count_if(F.expr("accepted_answer_id is null")).alias("n_no_accepted_null"), F.count_if(F.expr("is_closed is null")).alias("n_closed_null"),
        F.count_if(F.expr("is_eval_query is null")).alias("n_eval_null"), F.count_if(F.expr("body is null")).alias("n_body_null"), F.count_if(F.expr("body = ''")).alias("n_body_empty"), F.count_if(F.expr("title is null")).alias("n_title_null"), F.count_if(F.expr("score > 20")).alias("n_score_high"),
    )


def clean_report(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Invariants of a cleaned table: repeats, empty and short bodies, lengths, markup left."""
    b = F.col(body_col)
    return df.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(id_col)).alias("n_repeats"), F.count_if(b == "").alias("n_empty"), F.count_if(F.length(b) < 15).alias("n_short"),
        F.round(F.avg(F.length(b))).alias("avg_chars"), F.max(F.length(b)).alias("max_chars"), F.count_if(b.like("%<p>%") | b.like("%</%>%") | b.like("%&lt;%") | b.like("%&amp;%")).alias("n_markup"),
    )


def corpus_report(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count("*").alias("n_docs"), F.countDistinct("question_id").alias("n_questions"), F.count_if("is_accepted").alias("n_accepted"), F.count_if("from_eval_query").alias("n_from_eval"),
        F.round(F.avg(F.length("text"))).alias("avg_chars"), F.max(F.length("text")).alias("max_chars"), F.count_if(F.expr("length(text) between 200 and 600")).alias("n_ordinary"),
    )


def grade_histogram(qrels: DataFrame) -> DataFrame:
    n = qrels.groupBy("grade").agg(F.count("*").alias("n"))
    total = qrels.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("grade", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))  # one row


def qrels_report(qrels: DataFrame) -> DataFrame:
    """Judged queries and documents, and queries without exactly one best answer."""
    per = qrels.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.expr("grade = 3")).alias("best"))
    return per.agg(
        F.count("*").alias("n_queries"), F.sum("n").alias("n_judgements"), F.count_if(F.expr("best > 1")).alias("n_many_best"), F.count_if(F.expr("best = 0")).alias("n_no_best"),
        F.round(F.expr("try_divide(sum(n), count(*))"), 6).alias("avg_judged"),
    )
