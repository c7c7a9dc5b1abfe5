"""Text functions as Spark columns, and the driver-side query parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."


def contains_ci(text: Column, query: str) -> Column:
    """Case-insensitive substring."""
    return F.instr(F.lower(text), query.lower()) > 0


def split_camel(text: Column) -> Column:
    """A space between a lower-case and an upper-case ASCII letter."""
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def _separated(text: Column) -> Column:
    return F.lower(split_camel(F.regexp_replace(text, "[_\\-/.]", " ")))


def tokenize_all(text: Column) -> Column:
    """Lower-case tokens in order, duplicates included (null: empty)."""
    return F.filter(F.split(_separated(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def tokenize(text: Column) -> Column:
    return F.array_distinct(tokenize_all(text))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(_separated(F.coalesce(text, F.lit(""))), r"\s+", " "))


def normalize_path(path: Column) -> Column:
    """Forward slashes, none doubled, none at the end."""
    slashed = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when(F.length(slashed) > 1, F.regexp_replace(slashed, "/+$", "")).otherwise(slashed)


def normalize_path_py(path: str) -> str:
    slashed = re.sub("/+", "/", path.strip().replace("\\", "/"))
    return slashed.rstrip("/") if len(slashed) > 1 else slashed


def _window(text: Column, at: Column, width: int) -> Column:
    """*width* characters around the 1-based position *at* (0: the head), with marks."""
    n = F.length(text)
    half = width // 2
    first = F.greatest(F.lit(0), at - 1 - half)
    end = F.least(n, first + width)
    start = F.when((end - first < width) & (first > 0), F.greatest(F.lit(0), end - width)).otherwise(first)
    inside = F.substring(text, start + 1, end - start)
    around = F.concat(F.when(start > 0, ELLIPSIS).otherwise(""), inside, F.when(end < n, ELLIPSIS).otherwise(""))
    head = F.concat(F.substring(text, F.lit(1), F.lit(width)), F.when(n > width, ELLIPSIS).otherwise(""))
    return F.when(at > 0, around).otherwise(head)


def snippet(text: Column, query: str, width: int = 200) -> Column:
    """The text around the first case-insensitive occurrence of *query*."""
    return _window(text, F.instr(F.lower(text), query.lower()), width)


#: Only so many characters of a field are searched by patterns, and patterns are so long at most.
REGEX_FIELD_CHARS = 50_000
REGEX_PATTERN_CHARS = 1_000


def regex_index(text: Column, pattern: str) -> Column:
    """1-based place of the first match without regard to case, 0 for none."""
    return F.regexp_instr(F.substring(text, 1, REGEX_FIELD_CHARS), F.lit("(?iu)" + pattern))


def regex_snippet(text: Column, pattern: str, width: int = 200) -> Column:
    return _window(text, regex_index(text, pattern), width)


@dataclass(frozen=True)
class Query:
    raw: str
    lower: str
    tokens: tuple[str, ...]
    phrases: tuple[str, ...]


def tokens_py(text: str) -> list[str]:
    spaced = re.sub("([a-z])([A-Z])", r"\1 \2", re.sub(r"[_\-/.]", " ", text)).lower()
    return list(dict.fromkeys(spaced.split()))


def parse_query(raw: str) -> Query:
    """Quoted phrases, and distinct tokens of the phrases, then of the rest."""
    phrases = [p for m in re.findall(r'"([^"]*)"', raw) if (p := m.lower().strip())]
    rest = re.sub(r'"[^"]*"', " ", raw)
    tokens = dict.fromkeys([t for p in phrases for t in tokens_py(p)] + tokens_py(rest))
    return Query(raw, raw.lower(), tuple(tokens), tuple(phrases))


def smart_snippet(text: str, query: Query, width: int = 200) -> str:
    """The window that holds most distinct tokens and phrases; for result pages of at most 50 rows."""
    if len(text) <= width:
        return text
    lower = text.lower()
    spots = sorted((m.start(), k, needle) for k, needle in enumerate((*query.tokens, *query.phrases)) if needle for m in re.finditer(f"(?={re.escape(needle)})", lower))
    if not spots:
        return text[:width] + ELLIPSIS
    places = [p for p, _, _ in spots]

    best = None
    upto = 0
    for i, start in enumerate(places):
        upto = max(upto, i)
        while upto < len(places) and places[upto] <= start + width:
            upto += 1
        first = i
        while first and places[first - 1] == start:
            first -= 1
        found = {needle for _, _, needle in spots[first:upto]}
        rank = (-len(found), places[upto - 1] - start)
        if best is None or rank < best[0]:
            best = (rank, start, places[upto - 1])
    middle = (best[1] + best[2]) // 2
    start = max(0, min(middle - width // 2, len(text) - width))
    end = min(len(text), start + width)
    return (ELLIPSIS if start else "") + text[start:end] + (ELLIPSIS if end < len(text) else "")
