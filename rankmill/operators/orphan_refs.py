"""References to records that do not exist, or that arrived after what refers to them.

Parent and child keys are put into one long table, tagged by parent table, and
grouped by (parent table, key).  The aggregation combines before the shuffle,
so a key with a third of all rows sends one row per map task.  Groups without a
parent flag are orphans; groups whose parent was loaded after a child hold late
references.  Only those groups are joined back to the children, and periods are
counted from there.

Defined cases: a key that is NULL or 0 refers to nothing.  Rows repeated under
one id count once; if their references differ, each distinct reference counts.
A record with NULL id is skipped.  With a NULL load time on either side nothing
is late.  A NULL creation date gives a NULL period.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``child.key`` refers to ``parent.id``; ``kind`` is the parent's name in the list of deletions."""

    child_name: str
    child: DataFrame
    key: str
    parent_name: str
    parent: DataFrame
    kind: str
    id: str = "id"
    parent_id: str = "id"
    loaded: str = "loaded_at"
    created: str = "creation_date"


def _children(refs: list[Reference]) -> DataFrame:
    def one(r: Reference) -> DataFrame:
        c = r.child.select(
            F.lit(r.parent_name).alias("parent_table"), F.col(r.key).cast("long").alias("ref_key"), F.lit(r.child_name).alias("table_name"),
            F.col(r.id).cast("long").alias("record_id"), F.col(r.loaded).alias("loaded"), F.col(r.created).alias("created"),
        )
        return c.filter("ref_key is not null and ref_key <> 0 and record_id is not null")

    rows = reduce(DataFrame.unionByName, map(one, refs))
    return rows.groupBy("parent_table", "ref_key", "table_name", "record_id").agg(F.min("loaded").alias("child_loaded"), F.min("created").alias("created"))


def orphan_references(refs: list[Reference], deletions: DataFrame) -> DataFrame:
    """``(table_name, record_id, ref_key, status, period)`` of every unresolved reference.

    ``deletions(post_id, post_kind)`` lists deleted records.  ``status`` is missing,
    deleted or late; ``period`` is the first day of the month of ``created``.
    """
    children = _children(refs)
    none = F.lit(None).cast("timestamp_ntz")
    no = F.lit(False)
    long = [children.select("parent_table", "ref_key", no.alias("has_parent"), no.alias("listed"), none.alias("parent_loaded"), F.col("child_loaded").alias("first_child"), F.lit(True).alias("has_child"))]
    for r in {(x.parent_name, x.kind): x for x in refs}.values():
        long.append(r.parent.select(
            F.lit(r.parent_name).alias("parent_table"), F.col(r.parent_id).cast("long").alias("ref_key"), F.lit(True).alias("has_parent"), no.alias("listed"),
            F.col(r.loaded).cast("timestamp_ntz").alias("parent_loaded"), none.alias("first_child"), no.alias("has_child"),
        ))
        long.append(deletions.filter(F.col("post_kind") == r.kind).select(
            F.lit(r.parent_name).alias("parent_table"), F.col("post_id").cast("long").alias("ref_key"), no.alias("has_parent"), F.lit(True).alias("listed"),
            none.alias("parent_loaded"), none.alias("first_child"), no.alias("has_child"),
        ))
    groups = (
        reduce(DataFrame.unionByName, long).groupBy("parent_table", "ref_key")
        .agg(F.max("has_parent").alias("has_parent"), F.max("listed").alias("listed"), F.max("has_child").alias("has_child"), F.min("parent_loaded").alias("parent_loaded"), F.min("first_child").alias("first_child"))
        .filter("has_child and (not has_parent or parent_loaded > first_child)")
    )
    late = F.col("has_parent") & (F.col("parent_loaded") > F.col("child_loaded"))
    return (
        children.join(groups.select("parent_table", "ref_key", "has_parent", "listed", "parent_loaded"), ["parent_table", "ref_key"])
        .withColumn("status", F.when(late, "late").when(~F.col("has_parent"), F.when(F.col("listed"), "deleted").otherwise("missing")))
        .filter("status is not null")
        .select("table_name", "record_id", "ref_key", "status", F.date_trunc("month", "created").cast("date").alias("period"))
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Unresolved references per table, period and status."""
    return found.groupBy("table_name", "period", "status").agg(F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_keys"))
