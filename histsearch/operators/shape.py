"""Grouping by session, diversity, directory order, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import bucket_rank

#: Hits of a session that come before the hits held back.
PER_SESSION = 2


def struct_order(order: list[Column]) -> Column:
    """A comparable column that sorts as the ascending *order* does."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])


def group_by_session(hits: DataFrame, order: Column) -> DataFrame:
    """A row for each session: its best hit, hit_count, and its first hit's place.

    Content beats titles, then the higher score, without scores the later time, then the
    first in *order*. One aggregation with a partial step; no sort.
    """
    ranked = hits.withColumn("_order", order)
    better = F.struct(
        F.col("is_title"),
        -F.coalesce(F.col("score"), F.lit(0.0)),
        F.when(F.col("score").isNull(), -F.coalesce("time", F.lit(0))).otherwise(F.lit(0)),
        F.col("_order"),
    )
    best = F.min_by(F.struct(*[F.col(c) for c in hits.columns]), better)
    grouped = ranked.groupBy("session_id").agg(
        best.alias("best"), F.count(F.lit(1)).alias("hit_count"), F.min("_order").alias("first_place"), F.min_by("title_match", F.struct(F.col("title_match").isNull(), "_order")).alias("any_title")
    )
    out = grouped.select(*[F.col(f"best.{c}").alias(c) for c in hits.columns], "hit_count", "first_place", "any_title")
    return out.withColumn("title_match", F.coalesce("title_match", "any_title")).drop("any_title")


def diversify(hits: DataFrame, order: list[Column], limit: int, total: int | None = None, per_session: int = PER_SESSION) -> DataFrame:
    """*hits* with the column held: whether a hit waits behind the first *per_session*
    ones of every session. Nothing is held if the limit takes all hits anyway."""
    if per_session <= 0 or per_session >= limit or (total is not None and total <= limit):
        return hits.withColumn("held", F.lit(False))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return hits.withColumn("held", place > per_session)


def top_diverse(hits: DataFrame, order: list[Column], limit: int, by_directory: bool = False, per_session: int = PER_SESSION, total: int | None = None) -> DataFrame:
    """The first *limit* hits, at most *per_session* of a session while others wait; nothing is held
    where *total*, the number of hits if it is known, is within the limit. By directory, those are then
    put in the order of buckets (which takes a count of what isn't held, if any is)."""
    marked = diversify(hits, order, limit, total, per_session)
    if not by_directory:
        return marked.orderBy("held", *order).limit(limit).drop("held")
    if 0 < per_session < limit and (total is None or total > limit):
        first = marked.where(~F.col("held"))
        marked = first if first.limit(limit).count() >= limit else marked
    return marked.orderBy(*directory_order([F.col("held"), *order])).limit(limit).drop("held")


def directory_order(order: list[Column]) -> list[Column]:
    """Bucket, score, time, then the order before."""
    return [bucket_rank(F.col("directory_relevance")), F.coalesce(F.col("score"), F.lit(0.0)).desc(), F.col("time").desc(), *order]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) in *order*."""
    return df.orderBy(*order).offset(offset).limit(limit)
