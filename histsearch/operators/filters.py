"""Filters on sessions, messages and parts, as predicates that reach the scan where they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci, normalize_path, normalize_path_py


def in_time(time: Column, after: int | None, before: int | None) -> Column:
    """after < time < before, both ends exclusive."""
    kept = F.lit(True)
    if after is not None:
        kept = kept & (time > after)
    if before is not None:
        kept = kept & (time < before)
    return kept


def has_role(role: str) -> Column:
    return F.lit(True) if role == "all" else F.col("role") == role


def part_eligible(kind: str, tool_name: str | None) -> Column:
    if tool_name:
        return (F.col("part_type") == "tool") & (F.col("tool") == tool_name)
    return F.lit(True) if kind == "all" else F.col("part_type") == kind


def rows_where(rows: DataFrame, role="all", kind="all", tool_name=None, after=None, before=None, time="time") -> DataFrame:
    return rows.where(in_time(F.col(time), after, before) & has_role(role) & part_eligible(kind, tool_name))


def titles_searched(kind: str, tool_name: str | None) -> bool:
    return kind == "all" and not tool_name


def directory_matches(directory: Column, target: str) -> Column:
    """The directory *target* or one inside it; ``/`` fits all absolute ones."""
    at, wanted = normalize_path(directory), normalize_path_py(target)
    if wanted == "/":
        return at.startswith("/")
    return (at == wanted) | at.startswith(wanted + "/")


def same_project(worktree: str | None) -> Column:
    """Sessions whose project's worktree is *worktree*, or that lie inside it."""
    if not worktree or not worktree.strip():
        return F.lit(False)
    root = normalize_path_py(worktree)
    own, at = normalize_path(F.col("project_worktree")), normalize_path(F.col("directory"))
    return F.coalesce(own == root, F.lit(False)) | F.coalesce((at == root) | at.startswith(root + "/"), F.lit(False))


def directory_relevance(directory: str | None, worktree: str | None) -> Column:
    if not directory:
        return F.lit("unknown")
    return F.when(directory_matches(F.col("directory"), directory), "exact").when(same_project(worktree), "project").otherwise("global")


def in_scope(sessions: DataFrame, scope: str, project_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """Sessions of a scope; an explicit session wins over it."""
    if session_id:
        return sessions.where(F.col("session_id") == session_id)
    if scope == "project":
        return sessions.where(F.col("project_id") == project_id)
    return sessions


def titled(sessions: DataFrame, title: str | None) -> DataFrame:
    return sessions.where(contains_ci(F.col("title"), title)) if title else sessions


def dedupe_sessions(sessions: DataFrame) -> DataFrame:
    """The first of each id in list order."""
    first = sessions.groupBy("session_id").agg(F.min_by(F.struct(*[F.col(c) for c in sessions.columns]), "session_ord").alias("s"))
    return first.select("s.*")


#: Order of directory buckets: in a fallback, wider ones come later.
BUCKETS = ("exact", "project", "global")


def bucket_rank(relevance: Column) -> Column:
    out = F.when(relevance == BUCKETS[0], 0)
    for k, name in enumerate(BUCKETS[1:], 1):
        out = out.when(relevance == name, k)
    return out.otherwise(len(BUCKETS))


def with_buckets(sessions: DataFrame, directory: str | None, worktree: str | None, fallback: bool) -> DataFrame:
    """directory_relevance of each session; without fallback only exact ones stay."""
    marked = sessions.withColumn("directory_relevance", directory_relevance(directory, worktree))
    return marked.where("directory_relevance = 'exact'") if directory and not fallback else marked


def first_sessions(sessions: DataFrame, n: int | None) -> DataFrame:
    """The first *n* sessions, by bucket and list order (TakeOrderedAndProject)."""
    if n is None:
        return sessions
    return sessions.orderBy(bucket_rank(F.col("directory_relevance")), "session_ord", "session_id").limit(n)
