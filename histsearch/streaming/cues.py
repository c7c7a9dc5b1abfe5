"""The cue gate over a stream of messages: stateless, so late rows need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.auto import cue_query


def gate(messages: DataFrame) -> DataFrame:
    """*messages* (batch or stream; columns role, text) that ask for history, with their query."""
    return messages.where(F.col("role") == "user").withColumn("query", cue_query(F.col("text"))).where(F.col("query").isNotNull())
