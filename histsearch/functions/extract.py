"""What of a part is searchable, and how parts are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The engine's own tools, whose output is never searched.
OWN_TOOLS = ("recall", "recall_get", "recall_sessions", "recall_context", "recall_messages")
INPUT_CHARS = 10_000
RAW_CHARS = 20_000


#: White space at the ends of a text, line ends and wide blanks included.
SPACE_ENDS = r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$"


def trimmed(text: Column) -> Column:
    """*text* without white space of any kind at its ends."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def trim_py(text: str) -> str:
    return text.strip().strip("\ufeff").strip()


def is_own_tool(tool: Column) -> Column:
    """One of the own tools, bare or behind a separator."""
    return F.coalesce(tool.rlike("(^|[._/-])(" + "|".join(OWN_TOOLS) + ")$"), F.lit(False))


def _entry(field: str, text: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), text.alias("text")))


def _string_member(name: str) -> Column:
    """Member *name* of the input if it is a string that isn't blank."""
    value = F.get_json_object("tool_input", f"$.{name}")
    # The member's JSON text tells a string from a number.
    kind = F.expr(f"schema_of_variant(try_variant_get(try_parse_json(tool_input), '$.{name}', 'variant'))")
    return F.when((kind == "STRING") & (trimmed(value) != ""), value)


def searchable_fields() -> Column:
    """Ordered array of (field, text) of a part row; empty if nothing is searchable."""
    kind, status = F.col("part_type"), F.col("tool_status")
    tool = (kind == "tool") & ~is_own_tool(F.col("tool"))
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    known = tool & status.isin("completed", "error", "running", "pending") & F.col("tool_input").isNotNull()
    has_member = F.instr("tool_input", '"c') > 0  # spares parsing inputs that hold neither key
    command, cwd = (F.when(known & has_member, _string_member(n)) for n in ("command", "cwd"))
    entries = [
        _entry("text", F.col("text"), (kind == "text") & full("text")),
        _entry("reasoning", F.col("text"), (kind == "reasoning") & full("text")),
        _entry("stdout", F.col("tool_output"), tool & (status == "completed") & full("tool_output")),
        _entry("toolName", F.col("tool_title"), tool & (status == "completed") & full("tool_title")),
        _entry("stderr", F.col("tool_error"), tool & (status == "error") & full("tool_error")),
        _entry("command", command, command.isNotNull()),
        _entry("cwd", cwd, cwd.isNotNull()),
        _entry("command", F.substring("tool_input", 1, INPUT_CHARS), known),
        _entry("text", F.coalesce("description", F.lit("")), kind == "subtask"),
        _entry("text", F.coalesce("prompt", F.lit("")), kind == "subtask"),
    ]
    return F.array_compact(F.array(*entries))


def raw_text(fields: Column) -> Column:
    return F.substring(F.array_join(F.transform(fields, lambda f: f["text"]), "\n\n"), 1, RAW_CHARS)


def pruned() -> Column:
    return F.coalesce((F.col("part_type") == "tool") & (F.col("tool_status") == "completed") & F.col("compacted").isNotNull(), F.lit(False))


def display() -> Column:
    """The part as shown: (id, type, pruned, content, tool_name, title, input, output, error)."""
    kind, status = F.col("part_type"), F.col("tool_status")
    attr = lambda name: F.get_json_object("attrs", f"$.{name}")
    tool = kind == "tool"
    files = F.array_join(F.from_json(attr("files"), "array<string>"), ", ")
    content = (
        F.when(kind.isin("text", "reasoning"), F.col("text"))
        .when(tool, None)
        .when(kind == "subtask", F.concat(F.lit("[subtask] "), F.col("description")))
        .when(kind == "compaction", F.when(attr("auto") == "true", "[compaction boundary (auto)]").otherwise("[compaction boundary]"))
        .when(kind == "file", F.concat(F.lit("[file] "), F.coalesce(attr("filename"), attr("url"), F.lit(""))))
        .when(kind == "snapshot", F.concat(F.lit("[snapshot] "), F.coalesce(attr("snapshot"), F.lit(""))))
        .when(kind == "patch", F.concat(F.lit("[patch] "), F.coalesce(files, F.lit(""))))
        .when(kind == "agent", F.concat(F.lit("[agent] "), F.coalesce(attr("name"), F.lit(""))))
        .when(kind == "retry", F.concat(F.lit("[retry] attempt "), F.coalesce(attr("attempt"), F.lit(""))))
        .when(kind == "step-start", "[step-start]")
        .when(kind == "step-finish", F.concat(F.lit("[step-finish] "), F.coalesce(attr("reason"), F.lit(""))))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )
    return F.struct(
        F.col("part_id").alias("id"),
        kind.alias("type"),
        pruned().alias("pruned"),
        content.alias("content"),
        F.when(tool, F.col("tool")).alias("tool_name"),
        F.when(tool & (status == "completed"), F.col("tool_title")).alias("title"),
        F.when(tool, F.col("tool_input")).alias("input"),
        F.when(tool & (status == "completed"), F.col("tool_output")).alias("output"),
        F.when(tool & (status == "error"), F.col("tool_error")).when(kind == "retry", attr("error")).alias("error"),
    )


def source_of(part_type: Column) -> Column:
    return F.when(part_type.isin("title", "tool", "reasoning"), part_type).otherwise("message")


def recency(time: Column, now_ms: int) -> Column:
    return F.when(time.isNull() | (time <= 0), "unknown").when(F.lit(now_ms) - time <= 7 * 24 * 3_600_000, "recent").otherwise("older")
