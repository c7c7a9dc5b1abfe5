"""The data model: sessions, messages and typed parts, with loaders and adapters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, I = T.LongType(), T.StringType(), T.IntegerType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SESSIONS = _struct(
    session_id=S, session_ord=I, project_id=S, project_name=S, project_worktree=S, directory=S, title=S, time_created=L, time_updated=L, time_archived=L
)
MESSAGES = _struct(session_id=S, message_id=S, msg_ord=I, role=S, time_created=L, agent=S, model_id=S)
PARTS = _struct(
    session_id=S, message_id=S, part_id=S, part_ord=I, part_type=S, text=S, description=S, prompt=S, tool=S, tool_status=S, tool_input=S, tool_output=S,
    tool_title=S, tool_error=S, compacted=L, attrs=S,
)

#: Milliseconds of 2024-01-01T00:00:00Z, from which the adapters count.
BASE_MS = 1_704_067_200_000
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
#: The adapters' fixed "now".
NOW_MS = BASE_MS + 45 * DAY_MS


@dataclass
class History:
    """Conversation history. *rows* are parts with their message's columns (one row
    for each part); sources that hold both in one table pass them ready-made, so that
    text is never shuffled for the join."""

    sessions: DataFrame
    messages: DataFrame
    parts: DataFrame
    ready: DataFrame | None = field(default=None, repr=False)

    @property
    def rows(self) -> DataFrame:
        if self.ready is not None:
            return self.ready
        message = self.messages.select("session_id", "message_id", "msg_ord", "role", F.col("time_created").alias("time"), "agent", "model_id")
        return self.parts.join(message, ["session_id", "message_id"])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """*df* with exactly the columns of *schema*: missing ones null, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def history_of(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> History:
    """A history from raw tables. Orders that are missing are filled in: sessions by
    latest update, messages by time, parts by id."""
    sessions, messages, parts = conform(sessions, SESSIONS), conform(messages, MESSAGES), conform(parts, PARTS)
    return History(sessions, messages, parts)


def with_orders(history: History) -> History:
    """Fill session_ord, msg_ord and part_ord where a source has no list order. Orders within
    a session are windows over that session's light rows; the session order alone is global."""
    by_update = Window.orderBy(F.col("time_updated").desc(), "session_id")
    by_time = Window.partitionBy("session_id").orderBy("time_created", "message_id")
    by_id = Window.partitionBy("session_id", "message_id").orderBy("part_id")
    number = lambda w: (F.row_number().over(w) - 1).cast("int")
    return History(
        history.sessions.withColumn("session_ord", number(by_update)),
        history.messages.withColumn("msg_ord", number(by_time)),
        history.parts.withColumn("part_ord", number(by_id)),
    )


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> History:
    """Read ``<path>/{sessions,messages,parts}.<fmt>`` (Parquet, or JSON lines) with fixed schemas."""
    if fmt not in ("parquet", "json", "jsonl"):
        raise ValueError(f"unknown format {fmt!r}")
    kind = "parquet" if fmt == "parquet" else "json"
    tables = {}
    for name, schema in (("sessions", SESSIONS), ("messages", MESSAGES), ("parts", PARTS)):
        tables[name] = spark.read.format(kind).schema(schema).load(f"{path}/{name}.{fmt}")
    return History(**tables)


def save(history: History, path: str, fmt: str = "parquet") -> None:
    """Write the three tables under *path*; parts are dealt by session, so that a
    session's parts lie together and filters on session_id skip row groups."""
    kind = "parquet" if fmt == "parquet" else "json"
    parts = history.parts.repartition("session_id").sortWithinPartitions("session_id", "message_id", "part_ord")
    for name, df in (("sessions", history.sessions), ("messages", history.messages), ("parts", parts)):
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}.{fmt}")


# Adapters: the test tables as histories. Their schemas are fixed, so no job infers them.

TABLES = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ready(df: DataFrame, **columns) -> DataFrame:
    kinds = {f.name: f.dataType for f in PARTS} | {"msg_ord": I, "role": S, "time": L, "agent": S, "model_id": S}
    return df.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _split(ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    messages = ready.select("session_id", "message_id", "msg_ord", "role", F.col("time").alias("time_created"), "agent", "model_id")
    return messages, ready.select(*[f.name for f in PARTS])


def conversations(spark: SparkSession, sf_dir: str) -> History:
    """One session for each conversation, one message with one part for each turn."""
    raw = _table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    sid = F.concat(F.lit("c"), conv.cast("string"))
    mid = F.concat(sid, F.lit("-"), turn.cast("string"))
    time = F.lit(BASE_MS) + conv * HOUR_MS + turn * 60_000
    kind = F.when((F.col("role") == "assistant") & (turn % 4 == 3), "reasoning").otherwise("text")
    ready = _ready(
        raw, session_id=sid, message_id=mid, part_id=F.concat(mid, F.lit("p")), part_ord=F.lit(0), part_type=kind, text=F.col("text"), msg_ord=turn, role=F.col("role"), time=time,
        agent=F.lit("build"), model_id=F.lit("model"),
    )
    heads = raw.where("turn = 0").select("conv_id", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"))
    spans = raw.groupBy("conv_id").agg(F.max("turn").alias("last"))
    sessions = conform(
        spans.join(heads, "conv_id", "left").select(
            sid.alias("session_id"),
            conv.alias("session_ord"),
            F.concat(F.lit("p"), (conv % 3).cast("string")).alias("project_id"),
            F.concat(F.lit("/workspace/p"), (conv % 5).cast("string")).alias("directory"),
            F.coalesce("title", F.lit("")).alias("title"),
            (F.lit(BASE_MS) + conv * HOUR_MS).alias("time_created"),
            (F.lit(BASE_MS) + conv * HOUR_MS + F.col("last") * 60_000).alias("time_updated"),
            F.when(conv % 7 == 0, F.lit(NOW_MS)).alias("time_archived"),
            F.concat(F.lit("/workspace/p"), (conv % 5).cast("string")).alias("project_worktree"),
            F.concat(F.lit("project "), (conv % 3).cast("string")).alias("project_name"),
        ),
        SESSIONS,
    )
    messages, parts = _split(ready)
    return History(sessions, messages, parts, ready)


def events(spark: SparkSession, sf_dir: str) -> History:
    """One session for each user, one tool part for each event."""
    raw = _table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    sid, mid = F.concat(F.lit("u"), user.cast("string")), F.concat(F.lit("e"), event.cast("string"))
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "pending").otherwise("completed")
    done = status == "completed"
    ready = _ready(
        raw,
        session_id=sid, message_id=mid, part_id=F.concat(mid, F.lit("p")), part_ord=F.lit(0), part_type=F.lit("tool"), msg_ord=event, role=F.lit("assistant"), time=ms, agent=F.lit("build"),
        tool=kind, tool_status=status, tool_input=F.col("props"), tool_output=F.when(done, F.concat(F.lit("event "), kind)), tool_title=F.when(done, kind),
        tool_error=F.when(status == "error", F.concat(F.lit("event failed: "), kind)), compacted=F.when(done & (event % 10 == 0), ms),
    )
    spans = raw.groupBy("user_id").agg(F.min(ms).alias("first"), F.max(ms).alias("last"))
    sessions = conform(
        spans.select(sid.alias("session_id"), user.alias("session_ord"), F.concat(F.lit("user "), user.cast("string")).alias("title"), F.lit("/workspace/events").alias("directory"), F.col("first").alias("time_created"), F.col("last").alias("time_updated")),
        SESSIONS,
    )
    messages, parts = _split(ready)
    return History(sessions, messages, parts, ready)


def documents(spark: SparkSession, sf_dir: str) -> History:
    """One session for each source, one message with a text part for each document."""
    raw = _table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    mid = F.concat(F.lit("d"), doc.cast("string"))
    source = F.coalesce("source", F.lit("none"))
    ready = _ready(
        raw, session_id=source, message_id=mid, part_id=F.concat(mid, F.lit("p")), part_ord=F.lit(0), part_type=F.lit("text"), text=F.col("text"), msg_ord=doc, role=F.lit("user"), time=F.lit(BASE_MS) + doc * 1000
    )
    spans = raw.groupBy(source.alias("source")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    sessions = conform(
        spans.select(F.col("source").alias("session_id"), F.col("first").alias("session_ord"), F.col("source").alias("title"), F.concat(F.lit("/docs/"), "source").alias("directory"), (F.lit(BASE_MS) + F.col("last") * 1000).alias("time_updated")),
        SESSIONS,
    )
    messages, parts = _split(ready)
    return History(sessions, messages, parts, ready)
