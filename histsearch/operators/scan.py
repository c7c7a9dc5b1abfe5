"""Literal and pattern matching over all fields of all eligible parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import REGEX_PATTERN_CHARS, contains_ci, regex_index, regex_snippet, snippet
from ..sources.model import History
from .filters import rows_where, titles_searched
from .options import ArgumentError

HIT_COLUMNS = (
    "session_id", "session_title", "directory", "message_id", "role", "time", "part_id", "part_type", "pruned", "snippet", "tool_name", "score",
    "matched_fields", "matched_terms", "source", "directory_relevance", "title_match", "hit_fields", "session_ord", "is_title", "msg_ord", "part_ord",
)


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise ArgumentError for an empty, overlong or invalid pattern."""
    if not pattern:
        raise ArgumentError("Empty regex pattern.")
    if len(pattern) > REGEX_PATTERN_CHARS:
        raise ArgumentError(f"Regex pattern too long (max {REGEX_PATTERN_CHARS} chars).")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as wrong:  # py4j wraps Java's PatternSyntaxException
        text = str(getattr(wrong, "java_exception", wrong)).splitlines()[0]
        raise ArgumentError(f"Invalid regex: {text}") from None


#: Shapes that show that a pattern is meant.
PATTERN_SHAPES = (r"\\[dwsbDWSB]", r"\[[^\]]+\]", r"[)\]][*+?]", r"[a-zA-Z0-9][*+?][a-zA-Z(\[\\]", r"\{\d+(?:,\d*)?\}", r"\S\|\S", r"^\^", r"\$$")


def looks_like_regex(query: str) -> bool:
    """Whether *query* has a shape of patterns and is one."""
    if not any(re.search(shape, query) for shape in PATTERN_SHAPES):
        return False
    try:
        re.compile(query)
    except re.error:
        return False
    return True


def representatives(messages: DataFrame, role="all", after=None, before=None) -> DataFrame:
    """(session_id, message_id, role, time, msg_ord) of each session's newest message that passes."""
    kept = rows_where(messages, role=role, after=after, before=before, time="time_created")
    newest = F.max_by(F.struct("message_id", "role", F.col("time_created").alias("time"), "msg_ord"), "msg_ord")
    return kept.groupBy("session_id").agg(newest.alias("m")).select("session_id", "m.*")


def field_matches(fields: Column, hit) -> Column:
    return F.filter(fields, lambda f: hit(f["text"]))


def scan(history: History, targets: DataFrame, hit, show, kind="all", role="all", tool_name=None, after=None, before=None, now_ms: int = 0) -> DataFrame:
    """One row for each part (and title) of *targets* in which a field matches.

    *hit* maps a text column to a condition, *show* to a snippet. The first matching
    field gives the snippet; hit_fields counts the matching ones. Parts are filtered
    before sessions are joined, so only hits are shuffled.
    """
    rows = rows_where(history.rows, role, kind, tool_name, after, before)
    found = rows.withColumn("_hits", field_matches(extract.searchable_fields(), hit)).where(F.size("_hits") > 0)
    first = F.element_at("_hits", 1)
    parts = found.select(
        "session_id",
        "message_id",
        "role",
        "time",
        "part_id",
        "part_type",
        extract.pruned().alias("pruned"),
        show(first["text"]).alias("snippet"),
        F.when(F.col("part_type") == "tool", F.col("tool")).alias("tool_name"),
        F.array(first["field"]).alias("matched_fields"),
        F.size("_hits").alias("hit_fields"),
        "msg_ord",
        "part_ord",
        F.lit(False).alias("is_title"),
    )
    about = targets.select("session_id", F.col("title").alias("session_title"), "directory", "session_ord", "directory_relevance")
    hits = parts.join(about, "session_id")
    if titles_searched(kind, tool_name):
        named = about.where(hit(F.col("session_title")))
        newest = representatives(history.messages, role, after, before)
        titles = named.join(newest, "session_id").select(
            *about.columns,
            "message_id",
            "role",
            "time",
            F.concat("session_id", F.lit(":title")).alias("part_id"),
            F.lit("title").alias("part_type"),
            F.lit(False).alias("pruned"),
            show(F.col("session_title")).alias("snippet"),
            F.lit(None).cast("string").alias("tool_name"),
            F.array(F.lit("title")).alias("matched_fields"),
            F.lit(1).alias("hit_fields"),
            "msg_ord",
            F.lit(0).alias("part_ord"),
            F.lit(True).alias("is_title"),
        )
        hits = hits.unionByName(titles)
    hits = hits.withColumns(
        {
            "score": F.lit(None).cast("double"),
            "matched_terms": F.lit(None).cast("array<string>"),
            "source": extract.source_of(F.col("part_type")),
            "title_match": F.when(F.col("is_title"), F.col("session_title")),
        }
    )
    return hits.select(*HIT_COLUMNS)


def literal_scan(history: History, targets: DataFrame, query: str, width: int = 200, **filters) -> DataFrame:
    return scan(history, targets, lambda t: contains_ci(t, query), lambda t: snippet(t, query, width), **filters)


def regex_scan(history: History, targets: DataFrame, pattern: str, width: int = 200, **filters) -> DataFrame:
    check_pattern(targets.sparkSession, pattern)
    return scan(history, targets, lambda t: regex_index(t, pattern) > 0, lambda t: regex_snippet(t, pattern, width), **filters)


def in_scan_order() -> list[Column]:
    """Sessions in list order, a session's parts oldest first, its title last."""
    return [F.col("session_ord"), F.col("session_id"), F.col("is_title"), F.col("msg_ord"), F.col("part_ord"), F.col("part_id")]
