"""Queries of the general data-quality problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankmill.operators.orphan_refs import Reference, orphan_counts, orphan_references
from rankmill.sources.tables import load


def _references(spark: SparkSession, folder: str) -> DataFrame:
    questions = load(spark, folder, "questions").select("id", "accepted_answer_id", "loaded_at", "creation_date")
    answers = load(spark, folder, "answers").select("id", "question_id", "loaded_at", "creation_date")
    deletions = load(spark, folder, "post_deletions").select("post_id", "post_kind")
    return orphan_references(
        [Reference("questions", questions, "accepted_answer_id", "answers", answers, "answer"), Reference("answers", answers, "question_id", "questions", questions, "question")],
        deletions,
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference to a post that is absent, deleted or loaded only later."""
    return _references(spark, folder).select("table_name", "record_id", "status").distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved references per referring table, month and status."""
    return orphan_counts(_references(spark, folder))


_STATUS = """
with child as (
  select 'answers' as parent_table, 'answer' as kind, accepted_answer_id as ref_key, 'questions' as table_name, id as record_id, min(loaded_at) as child_loaded, min(creation_date) as created
  from questions where accepted_answer_id <> 0 and id is not null group by accepted_answer_id, id
  union all
  select 'questions', 'question', question_id, 'answers', id, min(loaded_at), min(creation_date)
  from answers where question_id <> 0 and id is not null group by question_id, id),
parent as (
  select 'answers' as parent_table, id, min(loaded_at) as parent_loaded from answers group by id
  union all select 'questions', id, min(loaded_at) from questions group by id),
found as (
  select table_name, record_id, ref_key, cast(date_trunc('month', created) as date) as period,
    case when p.id is null then case when exists (select 1 from post_deletions d where d.post_id = ref_key and d.post_kind = kind) then 'deleted' else 'missing' end
         when parent_loaded > child_loaded then 'late' end as status
  from child c left join parent p on p.parent_table = c.parent_table and p.id = c.ref_key)
"""

QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p6_found": _STATUS + "select distinct table_name, record_id, status from found where status is not null",
    "p6_counts": _STATUS + "select table_name, period, status, count(*) as n_references, count(distinct ref_key) as n_keys from found where status is not null group by all",
}
