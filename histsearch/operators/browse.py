"""Browsing: sessions, one message, pages of messages, the context of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import contains_ci
from ..sources.model import History
from .filters import has_role, in_scope, titled


def list_sessions(history: History, scope: str = "project", project_id: str | None = None, search: str | None = None, limit: int = 20) -> DataFrame:
    """Session items in list order; project details in global scope only."""
    found = titled(in_scope(history.sessions, scope, project_id), search)
    listed = found.orderBy("session_ord", "session_id").limit(limit)
    own = (scope == "global", F.col("project_name").isNotNull() | F.col("project_worktree").isNotNull())
    project = F.when(F.lit(own[0]) & own[1], F.struct(F.col("project_name").alias("name"), F.col("project_worktree").alias("worktree")))
    return listed.select("session_id", "session_ord", "title", "directory", project.alias("project"), "time_created", "time_updated", F.col("time_archived").isNotNull().alias("archived"))


def _in_session(df: DataFrame, session_id: str, message_id: str | None = None) -> DataFrame:
    kept = df.where(F.col("session_id") == session_id)
    return kept if message_id is None else kept.where(F.col("message_id") == message_id)


def content_matches(query: str) -> Column:
    """Whether a part row has a searchable field with *query*."""
    return F.exists(extract.searchable_fields(), lambda f: contains_ci(f["text"], query))


def session_messages(history: History, session_id: str, role: str = "all", query: str | None = None) -> DataFrame:
    """Messages of a session that pass role and content (without their parts)."""
    messages = _in_session(history.messages, session_id).where(has_role(role))
    if query:
        hits = _in_session(history.rows, session_id).where(content_matches(query)).select("message_id").distinct()
        messages = messages.join(hits, "message_id", "left_semi")
    return messages


def with_parts(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """*messages* with the array of their displayed parts, in order."""
    shown = rows.groupBy("session_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("part_ord", "part_id", extract.display().alias("part")))).alias("p"))
    joined = messages.join(shown, ["session_id", "message_id"], "left")
    none = F.lit(None).cast(shown.schema["p"].dataType)
    return joined.withColumn("parts", F.transform(F.coalesce("p", F.when(F.lit(False), none), F.array().cast(shown.schema["p"].dataType)), lambda x: x["part"])).drop("p")


def messages_page(history: History, session_id: str, offset: int = 0, limit: int = 10, role: str = "all", reverse: bool = False, query: str | None = None) -> DataFrame:
    """Page [offset, offset + limit) of a session's messages with their parts and the total."""
    kept = session_messages(history, session_id, role, query)
    order = F.col("msg_ord").desc() if reverse else F.col("msg_ord").asc()
    numbered = kept.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    part = numbered.where((F.col("place") >= offset) & (F.col("place") < offset + limit))
    rows = _in_session(history.rows, session_id).join(part.select("message_id"), "message_id", "left_semi")
    return with_parts(part, rows).orderBy("place")


def get_message(history: History, session_id: str, message_id: str) -> DataFrame:
    """One message with its parts, by equality filters that reach the scan."""
    return with_parts(_in_session(history.messages, session_id, message_id), _in_session(history.rows, session_id, message_id))


def context_window(history: History, session_id: str, message_id: str, before: int = 3, after: int = 3, parts: bool = True) -> DataFrame:
    """The messages around one, with center, has_more_before and has_more_after."""
    own = _in_session(history.messages, session_id)
    placed = own.withColumn("place", F.row_number().over(Window.orderBy("msg_ord")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    target = placed.where(F.col("message_id") == message_id).select(F.col("place").alias("at")).limit(1)
    around = placed.join(F.broadcast(target), (F.col("place") >= F.col("at") - before) & (F.col("place") <= F.col("at") + after))  # one row
    flagged = around.select(
        *own.columns, "place", (F.col("place") == F.col("at")).alias("center"), (F.col("at") - before > 0).alias("has_more_before"), (F.col("at") + after + 1 < F.col("n")).alias("has_more_after")
    )
    if not parts:
        return flagged.orderBy("place")
    rows = _in_session(history.rows, session_id).join(flagged.select("message_id"), "message_id", "left_semi")
    return with_parts(flagged, rows).orderBy("place")
