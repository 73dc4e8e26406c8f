"""Conversations: sessions, their last messages, history within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import params
from corpuslake.functions.text import session_title

ROLES = ("user", "assistant", "system")


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """(session_id, title, updated_at, n_messages), newest first; sessions without messages count 0."""
    counts = messages.groupBy(F.col("session_id").alias("sid")).agg(F.count(F.lit(1)).alias("n"))
    joined = sessions.join(counts, F.col("session_id") == F.col("sid"), "left")
    rows = joined.select("session_id", "title", "updated_at", F.coalesce("n", F.lit(0)).alias("n_messages"))
    return rows.orderBy(F.desc("updated_at"), "session_id").offset(offset).limit(limit)


def last_messages(messages: DataFrame, n: int, order: str = "turn") -> DataFrame:
    """Each session's newest n messages with ``pos``, 1 for the oldest of them."""
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(order)))
    kept = messages.withColumn("back", newest).where(F.col("back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(order))).drop("back")


def history_within(messages: DataFrame, max_chars: int = params.HISTORY_CHARS, max_messages: int = params.HISTORY_MESSAGES, order: str = "turn") -> DataFrame:
    """(session_id, n_lines, history): the newest lines ``role: text`` that fit, oldest first; the newest is always kept.

    Lengths are positive, so once the running sum passes the budget it stays past: stopping at the
    first misfit is a prefix of the running sum.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc(order))
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= max_messages).withColumn("line", line)
    before = F.coalesce(F.sum(F.length("line") + 1).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitting = rows.withColumn("used", before + F.length("line")).where((F.col("back") == 1) | (F.col("used") <= max_chars))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "line")))
    return fitting.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("history"))


def append_messages(sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, sessions): messages of a known role and session, the others with a reason, and sessions with updated_at moved on."""
    known = sessions.select(F.col("session_id").alias("sid")).distinct()
    checked = new.join(known, F.col("session_id") == F.col("sid"), "left").withColumn(
        "reason", F.when(F.col("role").isNull() | ~F.col("role").isin(*ROLES), "unknown role").when(F.col("sid").isNull(), "unknown session")
    )
    accepted = checked.where("reason is null").drop("sid", "reason")
    latest = accepted.groupBy(F.col("session_id").alias("sid")).agg(F.max("created_at").alias("latest"))
    moved = sessions.join(latest, F.col("session_id") == F.col("sid"), "left").withColumn("updated_at", F.greatest("updated_at", "latest")).drop("sid", "latest")
    return accepted, checked.where("reason is not null").drop("sid"), moved


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("session_id").distinct()
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))


def new_sessions(messages: DataFrame, max_chars: int = params.TITLE_CHARS, order: str = "turn") -> DataFrame:
    """(session_id, title) from each session's first user message."""
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", order).alias("text"))
    return first.select("session_id", session_title(F.col("text"), max_chars).alias("title"))
