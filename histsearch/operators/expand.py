"""Full messages or context windows around the first hits, under shared budgets.

Windows are settled on the driver for at most three hits; the messages in them (at
most thirty, with fields cut by the scan) are then read in one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import OWN_TOOLS
from ..sources.model import History
from .browse import with_parts

FIELD_CHARS = 4_000
#: What stands at a cut, and for an own tool's output.
MARK = "\n[truncated by recall expansion]"
REDACTED = "[recall output omitted]"


def shared_window(at: int, n: int, window: int, left: int) -> tuple[int, int, bool]:
    """(start, end, capped) of the messages around *at* of *n*. With fewer than they are *left* to
    spend, that stretch of them is taken in whose middle *at* lies, as far as the ends allow."""
    low, high = max(0, at - window), min(n, at + window + 1)
    size = min(left, high - low)
    start = min(max(low, at - (size - 1) // 2), high - size)
    return start, start + size, size < high - low


class TextBudget:
    """Characters that the fields of an expansion share, each of which gets FIELD_CHARS at most."""

    def __init__(self, chars: int):
        self.left, self.cut = chars, False

    def take(self, value: str | None) -> str | None:
        """*value* as it is shown: whole, cut and marked, or not at all where not even the mark fits."""
        if value is None:
            return None
        room = min(self.left, FIELD_CHARS)
        whole = 0 < room >= len(value)
        head = room - len(MARK)
        shown = value if whole else value[:head] + MARK if head > 0 else None
        self.cut |= not whole
        self.left -= len(shown or "")
        return shown


def is_own_tool_py(name: str | None) -> bool:
    if not name:
        return False
    return any(name == own or (name.endswith(own) and name[-len(own) - 1] in "._/-") for own in OWN_TOOLS)


def _bounded_part(part: dict, budget: TextBudget) -> dict:
    if part["type"] == "tool" and is_own_tool_py(part["tool_name"]):
        return part | {"content": REDACTED, "output": None, "error": None}
    return part | {name: budget.take(part[name]) for name in ("content", "output", "error")}


def _placed(history: History, sessions: list[str]) -> DataFrame:
    own = history.messages.where(F.col("session_id").isin(sessions))
    by_session = Window.partitionBy("session_id")
    return own.withColumn("place", F.row_number().over(by_session.orderBy("msg_ord")) - 1).withColumn("n", F.count(F.lit(1)).over(by_session))


def expand(history: History, results: list[dict], mode: str, count: int, window: int, budget_messages: int, budget_chars: int) -> tuple[list[dict], list[str]]:
    """(expansions, warnings) for the first *count* results that are no titles."""
    warnings: list[str] = []
    if mode == "none":
        return [], warnings
    chosen = [(i, r) for i, r in enumerate(results) if r["source"] != "title"][:count]
    if not chosen:
        if results:
            warnings.append("Hits on titles have no message to expand.")
        return [], warnings
    placed = _placed(history, sorted({r["session_id"] for _, r in chosen}))
    wanted = F.struct("session_id", "message_id").isin([F.struct(F.lit(r["session_id"]), F.lit(r["message_id"])) for _, r in chosen])
    spots = {(s["session_id"], s["message_id"]): (s["place"], s["n"]) for s in placed.where(wanted).select("session_id", "message_id", "place", "n").collect()}

    spans, left, capped = [], budget_messages, False
    for index, result in chosen:
        key = (result["session_id"], result["message_id"])
        if key not in spots:
            continue
        at, n = spots[key]
        if mode == "message":
            spans.append((index, result, at, at + 1, n))
            continue
        if left <= 0:
            capped = True
            break
        start, end, short = shared_window(at, n, window, left)
        capped |= short
        left -= end - start
        spans.append((index, result, start, end, n))
    if not spans:
        return [], warnings
    inside = F.lit(False)
    for _, result, start, end, _ in spans:
        inside = inside | ((F.col("session_id") == result["session_id"]) & (F.col("place") >= start) & (F.col("place") < end))
    messages = placed.where(inside)
    rows = history.rows.where(F.col("session_id").isin(sorted({r["session_id"] for _, r, *_ in spans}))).join(messages.select("session_id", "message_id"), ["session_id", "message_id"], "left_semi")
    for name in ("text", "description", "tool_output", "tool_error"):
        rows = rows.withColumn(name, F.substring(name, 1, FIELD_CHARS + 1))
    read = {(m["session_id"], m["place"]): m.asDict(recursive=True) for m in with_parts(messages, rows).collect()}

    budget, out = TextBudget(budget_chars), []
    for index, result, start, end, n in spans:
        items = []
        for place in range(start, end):
            m = read[result["session_id"], place]
            items.append({"message": {k: m[k] for k in ("message_id", "role", "time_created", "agent", "model_id")}, "parts": [_bounded_part(p, budget) for p in m["parts"]]})
        entry = {"result_index": index, "session_id": result["session_id"], "message_id": result["message_id"], "mode": mode}
        if mode == "message":
            out.append(entry | {"message": items[0]})
        else:
            items = [item | {"center": item["message"]["message_id"] == result["message_id"]} for item in items]
            out.append(entry | {"messages": items, "has_more_before": start > 0, "has_more_after": end < n})
    if capped:
        warnings.append(f"{budget_messages} messages were expanded at most, for {len(out)} of {len(chosen)} hits; a smaller window or fewer expandResults leave room for more.")
    if budget.cut:
        warnings.append(f"The expanded texts share {budget_chars} characters; some were cut or left out.")
    return out, warnings
