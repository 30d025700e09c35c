"""Rebuilding conversations from message rows.

Messages carry no parent pointer, so one is derived: the parent of a message is
the message kept just before it.  A global order comes from range partitions on
(conversation, time, id), which also cuts a conversation that holds a third of
all rows into many tasks; what crosses a partition's border is carried by one
row per partition.  Parents are then resolved by pointer jumping: every round
doubles the distance a pointer spans, so a conversation of n messages takes
log2(n) joins on unique keys.  Chains that reach no root are orphans, chains
that never end are cycles; root-to-leaf depth is the turn number.

Resent messages: within a block of equal neighbours only the first is kept; if
one of the block comes more than ``gap_s`` later than it, that one would be
kept too and two turns of one speaker would follow each other, so the
conversation is broken.  Hence minima and maxima per block suffice.

Defined cases: a message repeated under one id counts once (of differing rows
the least in (conversation, time, role, content) order counts); a NULL id, role,
time or content, an unknown role or blank content breaks its conversation; a
NULL conversation_id and conversations without messages give no rows; equal
times are ordered by id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.session import Scratch, parallelism
from rankmill.sources.tables import load

#: Spellings of the two speaker roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant"}
#: A character that is neither white space nor of zero width (format characters and joiners count as zero width).
VISIBLE = r"[^\s\p{Z}\p{Cf}\x{85}\x{1c}-\x{1f}\x{034f}\x{115f}\x{1160}\x{3164}\x{ffa0}]"
#: Above this, created_at counts milliseconds.
MILLIS_FROM = 1e11


def normal_messages(messages: DataFrame) -> DataFrame:
    """One fixed-width row per message id: role, time in microseconds, content fingerprint, and whether it is sound."""
    at = F.when(F.col("created_at") > MILLIS_FROM, F.col("created_at") / 1000).otherwise(F.col("created_at"))
    sound_time = F.col("created_at").isNotNull() & ~F.isnan("created_at")
    name = F.lower(F.regexp_replace("role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[name]
    rows = messages.filter("conversation_id is not null").select(
        F.col("id").cast("long").alias("message_id"), F.col("conversation_id").cast("long").alias("conversation_id"),
        F.when(sound_time, F.round(at * 1e6)).cast("long").alias("at"), F.when(role == "user", 0).when(role == "assistant", 1).alias("role"),
        F.xxhash64("content").alias("content_hash"), F.length("content").alias("content_length"), F.coalesce(F.col("content").rlike(VISIBLE), F.lit(False)).alias("visible"),
    )
    cols = ["conversation_id", "at", "role", "content_hash", "content_length", "visible"]
    kept = rows.filter("message_id is not null").groupBy("message_id").agg(F.min(F.struct(*cols)).alias("m")).select("message_id", "m.*")
    return kept.unionByName(rows.filter("message_id is null"))


def resolve_pointers(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Root, depth and status of every node by pointer jumping.

    ``nodes(id, parent)``: ids are unique, a root has a NULL parent.  Gives
    ``(id, root, depth, status)`` with status ok, orphan (its chain ends at a
    parent that does not exist; root and depth are NULL) or cycle.
    """
    first = nodes.select("id", F.coalesce("parent", "id").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("parent").isNull(), F.lit("ok")).alias("status"))
    state = scratch.write(first)
    total, span = state.count(), 1
    while True:
        todo = state.filter("status is null")
        left = todo.count()
        if not left or span > total:  # a chain without a cycle has fewer links than there are nodes
            break
        at = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next_ptr"), F.col("hops").alias("more"), F.col("status").alias("next_status"), F.lit(True).alias("there"))
        moved = todo.drop("status").join(at, "ptr", "left").select(
            "id", F.coalesce("next_ptr", "ptr").alias("ptr"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.when(F.col("there").isNull(), "orphan").otherwise(F.col("next_status")).alias("status"),
        )
        new = scratch.write(state.filter("status is not null").unionByName(moved))
        scratch.drop(state)
        state, span = new, span * 2
    ok = F.col("status") == "ok"
    return state.select("id", F.when(ok, F.col("ptr")).alias("root"), F.when(ok, F.col("hops")).alias("depth"), F.coalesce("status", F.lit("cycle")).alias("status"))


def _in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbers blocks of equal neighbours in (conversation, time, id) order: adds ``head`` and a consecutive ``block``."""
    spark = rows.sparkSession
    order = ["conversation_id", "at", "message_id"]
    ranged = scratch.write(rows.repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()))
    same = ["conversation_id", "role", "content_hash", "content_length"]
    w = Window.partitionBy("part").orderBy(*order)
    local = ranged.withColumn("rn", F.row_number().over(w)).withColumn("before", F.lag(F.struct(*same)).over(w))
    # one row per partition, so its size is bounded by their number
    edge = ranged.groupBy("part").agg(F.max_by(F.struct(*same), F.struct(*order)).alias("edge")).withColumn("part", F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")))
    local = local.join(F.broadcast(edge.filter("part is not null")), "part", "left").withColumn("before", F.when(F.col("rn") == 1, F.col("edge")).otherwise(F.col("before")))
    differs = F.col("before").isNull()
    for c in same:
        differs = differs | (F.col(f"before.{c}") != F.col(c))
    local = local.withColumn("head", differs).withColumn("upto", F.sum(F.col("head").cast("long")).over(w))
    local = scratch.write(local.select("part", *order, *same[1:], "head", "upto"))
    total = local.groupBy("part").agg(F.max("upto").alias("n"))
    ahead = total.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return local.join(F.broadcast(ahead), "part").withColumn("block", F.col("upto") + F.col("ahead")).drop("part", "upto", "ahead")


def rebuild_conversations(messages: DataFrame, conversations: DataFrame, gap_s: float = 5.0) -> DataFrame:
    """``(conversation_id, turn_no, message_id, role)`` of every whole conversation, one row per kept message."""
    spark = messages.sparkSession
    scratch = Scratch(spark, "conversations")
    rows = scratch.write(normal_messages(messages))
    bad = F.col("message_id").isNull() | F.col("role").isNull() | F.col("at").isNull() | ~F.col("visible")
    sound = rows.groupBy("conversation_id").agg(F.count_if(bad).alias("bad")).filter("bad = 0").select("conversation_id")
    known = conversations.filter("id is not null").select(F.col("id").cast("long").alias("conversation_id")).distinct()
    rows = rows.join(sound.join(known, "conversation_id", "left_semi"), "conversation_id", "left_semi").drop("visible")
    ordered = scratch.write(_in_order(rows, scratch))
    blocks = ordered.groupBy("block").agg(
        F.first("conversation_id").alias("conversation_id"), F.min("at").alias("at"), F.max("at").alias("last"), F.first("role").alias("role"),
        F.min(F.when(F.col("head"), F.col("message_id"))).alias("message_id"),
    )
    blocks = scratch.write(blocks)
    prior = blocks.select((F.col("block") + 1).alias("block"), F.col("conversation_id").alias("prior_conversation"), F.col("message_id").alias("parent"), F.col("role").alias("parent_role"))
    joined = blocks.join(prior, "block", "left")
    inside = F.col("prior_conversation") == F.col("conversation_id")
    linked = scratch.write(joined.select(
        "conversation_id", "message_id", "role", F.when(inside, F.col("parent")).alias("parent"),
        ((F.col("last") - F.col("at") > int(gap_s * 1e6)) | F.coalesce(inside & (F.col("parent_role") == F.col("role")), F.lit(False))).alias("broken"),
    ))
    paths = resolve_pointers(linked.select(F.col("message_id").alias("id"), "parent"), scratch)
    turns = linked.join(paths.withColumnRenamed("id", "message_id"), "message_id")
    whole = (
        turns.groupBy("conversation_id").agg(
            F.count_if((F.col("status") != "ok") | F.col("broken")).alias("bad"), F.min_by("role", "depth").alias("first"), F.max_by("role", "depth").alias("last"), F.countDistinct("root").alias("roots"))
        .filter("bad = 0 and first = 0 and last = 1 and roots = 1").select("conversation_id")
    )
    return turns.join(whole, "conversation_id", "left_semi").select(
        "conversation_id", (F.col("depth") + 1).cast("int").alias("turn_no"), "message_id", F.when(F.col("role") == 0, "user").otherwise("assistant").alias("role")
    )


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, folder, "messages").select("id", "conversation_id", "role", "content", "created_at"), load(spark, folder, "conversations").select("id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message of each whole conversation."""
    return rebuild_conversations(*_tables(spark, folder)).select("conversation_id", "turn_no", "message_id")


def p2_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations by number of turns."""
    return rebuild_conversations(*_tables(spark, folder)).groupBy("conversation_id").agg(F.max("turn_no").alias("n_turns")).groupBy("n_turns").agg(F.count("*").alias("n_conversations"))


_TURNS = r"""
with recursive m as (
  select id, min(conversation_id) as cid, any_value(case lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'ai' then 'assistant' when 'bot' then 'assistant' end) as role,
    any_value(content) as content, any_value(cast(round(case when created_at > 1e11 then created_at / 1000 else created_at end * 1e6) as bigint)) as t
  from messages where conversation_id is not null group by id),
good as (select cid from m where cid in (select id from conversations) group by cid having bool_and(role is not null and t is not null and coalesce(regexp_matches(content, '[^\s\p{Z}\p{Cf}]'), false))),
o as (select m.*, row_number() over (partition by cid order by t, id) as rn from m where cid in (select cid from good)),
walk as (
  select cid, rn, id, role, content, t as kept_at, true as kept from o where rn = 1
  union all
  select o.cid, o.rn, o.id, o.role, o.content, case when o.role = w.role and o.content = w.content and o.t - w.kept_at <= 5000000 then w.kept_at else o.t end,
    not (o.role = w.role and o.content = w.content and o.t - w.kept_at <= 5000000)
  from walk w join o on o.cid = w.cid and o.rn = w.rn + 1),
turns as (select cid, id, role, row_number() over (partition by cid order by rn) as turn_no from walk where kept),
whole as (select cid from turns group by cid having bool_and(role = case when turn_no % 2 = 1 then 'user' else 'assistant' end) and max(turn_no) % 2 = 0)
"""
QUERIES = {"p2_found": p2_found, "p2_lengths": p2_lengths}
SQL = {
    "p2_found": _TURNS + "select cid as conversation_id, cast(turn_no as int) as turn_no, id as message_id from turns where cid in (select cid from whole)",
    "p2_lengths": _TURNS + "select n_turns, count(*) as n_conversations from (select cid, cast(max(turn_no) as int) as n_turns from turns where cid in (select cid from whole) group by cid) group by n_turns",
}
