"""Chat history tables: budgets, sidebar groups, and versioned insert, update and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions.text import term_bag

ROLES = ("user", "assistant")
#: Declared columns of the two tables.
CONVERSATIONS = "id long, title string, model string, created_at double, temperature double, max_tokens int, n_ctx int, n_gpu_layers int"
MESSAGES = "id long, conversation_id long, role string, content string, created_at double, route string, top_cosine double, gate string, used_docs boolean, sources_json string, context_used int"
SETTINGS = ("temperature", "max_tokens", "n_ctx", "n_gpu_layers")


def open_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables below ``path`` with their declared columns; made empty where they don't exist yet."""
    out = []
    for name, schema in (("conversations", CONVERSATIONS), ("messages", MESSAGES)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
        out.append(spark.read.schema(schema).parquet(f"{path}/{name}"))
    return out[0], out[1]


def fit_history(messages: DataFrame, budget: int | Column, cost: Column | None = None, cost_name: str = "cost") -> DataFrame:
    """The newest messages of each conversation whose costs together stay within the budget; a NULL or negative budget keeps none.

    Costs are whole numbers and not negative, so the first message beyond the
    budget ends the history, and it is among the newest ``budget + 1`` that cost
    anything.  Only those are ranked, limited before the shuffle, so a
    conversation with very many messages never meets in one task.
    """
    c = cost if cost is not None else F.size(term_bag("content"))
    newest = [F.desc("created_at"), F.desc("id")]
    w = Window.partitionBy("conversation_id").orderBy(*newest)
    running = F.sum(cost_name).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = messages.withColumn(cost_name, c).withColumn("_budget", F.lit(budget) if isinstance(budget, int) else budget).filter("_budget >= 0")
    most = budget if isinstance(budget, int) else rows.agg(F.max("_budget")).first()[0] or 0
    paid = rows.filter(F.col(cost_name) > 0).select("conversation_id", "created_at", "id", cost_name, "_budget").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= int(most) + 1)
    beyond = paid.withColumn("running", running).filter("running > _budget").groupBy("conversation_id").agg(F.max(F.struct("created_at", "id")).alias("end"))
    kept = rows.join(beyond, "conversation_id", "left").filter(F.col("end").isNull() | (F.struct("created_at", "id") > F.col("end"))).drop("end", "_budget")
    return kept.withColumn("running", running)


def context_budget(n_ctx: Column, reserve: Column, skeleton: Column | int, margin: int = 48) -> Column:
    """Tokens left for the history: the context less the reply's share, the prompt without history, and a margin for markers."""
    return n_ctx - reserve - margin - (F.lit(skeleton) if isinstance(skeleton, int) else skeleton)


def format_history(kept: DataFrame) -> DataFrame:
    """One transcript per conversation, oldest first, between markers."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = kept.select("conversation_id", F.struct("created_at", "id", line.alias("line")).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n")
    return rows.groupBy("conversation_id").agg(F.concat(F.lit("--- Earlier turns ---\n"), text, F.lit("\n--- End of earlier turns ---\n")).alias("transcript"))


def last_context(messages: DataFrame) -> DataFrame:
    """The newest known context size of each conversation's assistant messages."""
    rows = messages.filter("role = 'assistant' and context_used is not null")
    return rows.groupBy("conversation_id").agg(F.max_by("context_used", "id").alias("context_used"))


def recent_models(conversations: DataFrame, limit: int = 20) -> DataFrame:
    """Models by when they were last used."""
    return conversations.filter("model is not null").groupBy("model").agg(F.max("created_at").alias("last_used")).orderBy(F.desc("last_used"), "model").limit(limit)


def day_group(created_at: Column, today: Column) -> Column:
    """today, yesterday or earlier, by whole days between epoch seconds and a date."""
    days = F.datediff(today, F.timestamp_seconds(created_at).cast("date"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise("earlier")


def sidebar(conversations: DataFrame, today: Column, query: str = "") -> DataFrame:
    """Conversations by day group, searched by title without regard to case; an empty query finds all."""
    q = query.strip().lower()
    rows = conversations.filter(F.lower("title").contains(q)) if q else conversations
    return rows.withColumn("day_group", day_group(F.col("created_at"), today)).groupBy("day_group").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


def sidebar_rows(conversations: DataFrame, now: Column, query: str = "", zone: str = "UTC") -> DataFrame:
    """``(group_no, day_group, id, title, created_at)`` in the order of display: groups by whole local days, newest first inside; empty groups have no rows."""
    q = query.strip().lower()
    rows = conversations.filter(F.contains(F.lower("title"), F.lit(q))) if q else conversations
    local = lambda t: F.from_utc_timestamp(F.timestamp_seconds(t), zone).cast("date")
    days = F.datediff(local(now), local(F.col("created_at")))
    rows = rows.withColumn("group_no", F.when(days <= 0, 1).when(days == 1, 2).otherwise(3))
    name = F.element_at(F.array(F.lit("today"), F.lit("yesterday"), F.lit("earlier")), F.col("group_no"))
    return rows.select("group_no", name.alias("day_group"), "id", "title", "created_at").orderBy("group_no", F.desc("created_at"), F.desc("id"))


def newest_first(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("created_at"), F.desc("id"))


def messages_of(messages: DataFrame, conversation_id: int) -> DataFrame:
    return messages.filter(F.col("conversation_id") == conversation_id).orderBy("id")


def insert_conversation(conversations: DataFrame, row: dict, defaults: dict) -> DataFrame:
    """The table with one row more; settings not given take their defaults."""
    given = defaults | {k: v for k, v in row.items() if v is not None}
    new = conversations.sparkSession.createDataFrame([tuple(given.get(f.name) for f in conversations.schema.fields)], conversations.schema)
    return conversations.unionByName(new)


def _with_rules(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds ``_rules``, the rules that a row breaks."""
    known = conversations.select(F.col("id").alias("conversation_id")).filter("conversation_id is not null").distinct().withColumn("_known", F.lit(True))
    broken = F.array(
        F.when(F.col("content").isNull(), "content"), F.when(F.col("_known").isNull(), "conversation"), F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role"))
    return messages.join(known, "conversation_id", "left").withColumn("_rules", F.array_compact(broken)).select(*messages.columns, "_rules")


def violations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(id, conversation_id, rule)``: every rule that a message row breaks (role, content, parent)."""
    return _with_rules(messages, conversations).select("id", "conversation_id", F.explode("_rules").alias("rule"))


def insert_messages(messages: DataFrame, new: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the sound rows of ``new`` appended, columns not given being NULL, and the refused rows with their broken ``rules``."""
    rows = _with_rules(new, conversations)
    sound = rows.filter(F.size("_rules") == 0).drop("_rules")
    return messages.unionByName(sound, allowMissingColumns=True).select(messages.columns), rows.filter(F.size("_rules") > 0).withColumnRenamed("_rules", "rules")


def coded_flag(col: Column) -> Column:
    """A flag as 0 or 1, NULL kept; ``decoded_flag`` is the way back."""
    return col.cast("int")


def decoded_flag(col: Column) -> Column:
    return col.cast("boolean")


def post_messages(conversations: DataFrame, messages: DataFrame, posts: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both turns of every answered post appended to the history, and the posts that left no trace, with the reason.

    ``posts(post_id, conversation_id, content, created_at)`` are numbered from 1;
    ``answers(post_id, reply, ...)`` may carry trace columns of the history.  A
    post whose conversation is unknown is refused; one without a reply (the
    generator failed) is rolled back, so no question stands without its answer.
    """
    known = conversations.select(F.col("id").alias("conversation_id")).filter("conversation_id is not null").distinct().withColumn("_known", F.lit(True))
    trace = [c for c in answers.columns if c not in ("post_id", "reply") and c in messages.columns]
    rows = posts.select("post_id", "conversation_id", "content", "created_at").join(known, "conversation_id", "left").join(answers.select("post_id", "reply", *trace), "post_id", "left")
    reason = F.when(F.col("_known").isNull(), "conversation").when(F.col("reply").isNull(), "generation")
    rows = rows.withColumn("reason", reason).crossJoin(F.broadcast(messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))))  # one row
    fine = rows.filter("reason is null")
    turn = lambda k, role, text, more: fine.select((F.col("_last") + 2 * F.col("post_id") - k).alias("id"), "conversation_id", F.lit(role).alias("role"), F.col(text).alias("content"), "created_at", *more)
    new = turn(1, "user", "content", []).unionByName(turn(0, "assistant", "reply", trace), allowMissingColumns=True)
    return messages.unionByName(new, allowMissingColumns=True).select(messages.columns), rows.filter("reason is not null").select("post_id", "conversation_id", "reason")


def partial_update(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """A new version of the table in which non-NULL fields of ``patch`` replace the old."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    joined = base.join(p, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns])


def cascade_delete(conversations: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``doomed(id)``."""
    return conversations.join(doomed, "id", "left_anti"), messages.join(doomed.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def delete_messages(messages: DataFrame, doomed: DataFrame) -> DataFrame:
    return messages.join(doomed, "id", "left_anti")


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing, with type and default; others stay as they are."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not among the finished ones."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def source_titles(sources_json: Column) -> Column:
    """Sources as (title, url); old rows hold plain strings, which become titles without url."""
    full = F.from_json(sources_json, "array<struct<title:string,url:string>>")
    plain = F.from_json(sources_json, "array<string>")
    as_struct = F.transform(plain, lambda t: F.struct(t.alias("title"), F.lit(None).cast("string").alias("url")))
    old = sources_json.rlike(r'^\s*\[\s*"')
    return F.when(sources_json.isNull(), F.array().cast("array<struct<title:string,url:string>>")).when(old, as_struct).otherwise(full)
