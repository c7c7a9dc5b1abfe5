"""Ranked search: BM25+ over four fields with prefix and typo matching.

Each candidate is tokenised once, in place (array functions over the row). What leaves the
scan is a narrow written table of the candidates that answer the query: the tokens that do,
with their counts, and what the score needs to know of the text, but not the text. The corpus
averages are taken on the way of that same pass. Document frequencies and weights are worked out on the
distinct answering words; texts are read again for the few hits that are shown.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import Query, tokenize, tokenize_all
from ..sources.model import History
from ..sources.written import materialize
from .filters import rows_where, titles_searched
from .scan import HIT_COLUMNS, representatives

#: Weights of the fields, and of what a hit has besides its score.
FIELD_BOOST = {"primary": 2.0, "secondary": 0.6, "title": 0.3, "hint": 0.15}
PHRASE, ALL_TOKENS, REASONING, ERROR_TEXT, USER, RECENT, WEAK, POOR = 1.15, 1.1, 1.05, 1.05, 1.03, 1.05, 0.9, 0.92
WEAK_BELOW = 0.7
FLOOR = 0.1
ERROR_WORDS = ("error", "failed", "exception")
RECENT_MS = 7 * 24 * 3_600_000
FUZZINESS = {"smart": 0.2, "fuzzy": 0.3}
MAX_EDITS = 6
PREFIX_FROM = 4
FUZZY_FROM = 4
#: BM25+ constants from the literature.
K1, B, DELTA = 1.2, 0.75, 1.0
DIGITS = 6

#: Candidate budgets, applied on request.
SESSION_MESSAGES, SESSION_PARTS, SESSION_CANDIDATES, CANDIDATES, CHARS = 1000, 5000, 500, 3000, 2_000_000


def max_edits(token: str, mode: str) -> int:
    if len(token) < FUZZY_FROM:
        return 0
    return min(MAX_EDITS, math.floor(len(token) * FUZZINESS[mode] + 0.5))


def term_weight(term: Column, token: str, mode: str) -> Column:
    """How well *term* answers the query *token*: 1 if equal, the shared part for a prefix,
    less for each edit; null if it doesn't. Lengths are looked at before edits."""
    weight = F.when(term == token, 1.0)
    if len(token) >= PREFIX_FROM:
        weight = weight.when(term.startswith(token), F.lit(float(len(token))) / F.length(term))
    edits = max_edits(token, mode)
    if edits:
        near = F.abs(F.length(term) - len(token)) <= edits
        distance = F.levenshtein(term, F.lit(token), edits)
        weight = weight.when(near & (distance >= 0), F.lit(1.0) - distance / F.greatest(F.length(term), F.lit(len(token))))
    return weight


def answers_some(term: Column, query: Query, mode: str) -> Column:
    return reduce(lambda a, b: a | b, [term_weight(term, q, mode).isNotNull() for q in query.tokens], F.lit(False))


def matched_terms(terms: Column, query: Query, mode: str) -> Column:
    """Query tokens that some of *terms* (words that answer the query) answers, in query order."""
    tests = [F.when(F.exists(terms, lambda t: term_weight(t, q, mode).isNotNull()), F.lit(q)) for q in query.tokens]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def matched_fields(fields: Column, query: Query, mode: str, whole: Column) -> Column:
    """Names of the *fields* that hold a phrase or an answering word. *whole* tells so of the words of
    a candidate with one field, which aren't looked at again."""

    def answers(f: Column) -> Column:
        lower = F.lower(f["text"])
        tests = [F.instr(lower, p) > 0 for p in query.phrases]
        again = F.exists(tokenize(f["text"]), lambda t: answers_some(t, query, mode))
        one = (F.size(fields) == 1) & (F.length(f["text"]) <= extract.RAW_CHARS)
        return reduce(lambda a, b: a | b, [*tests, F.when(one, whole).otherwise(again)])

    return F.array_distinct(F.transform(F.filter(fields, answers), lambda f: f["field"]))


def candidates(history: History, targets: DataFrame, kind="all", role="all", tool_name=None, after=None, before=None, budget: bool = False) -> DataFrame:
    """A row for each part with searchable text, and for each titled session that has a message."""
    rows = rows_where(history.rows, role, kind, tool_name, after, before)
    if budget:
        rows = newest_rows(rows, rows_where(history.messages, role=role, after=after, before=before, time="time_created"))
    about = targets.select("session_id", F.col("title").alias("session_title"), "directory", "session_ord", "directory_relevance")
    parts = rows.withColumn("fields", extract.searchable_fields()).where(F.size("fields") > 0)
    parts = parts.select(
        "session_id", "message_id", "role", "time", "part_id", "part_type", extract.pruned().alias("pruned"), F.when(F.col("part_type") == "tool", F.col("tool")).alias("tool_name"), "fields",
        extract.raw_text(F.col("fields")).alias("raw"), "msg_ord", "part_ord", F.lit(False).alias("is_title"),
    ).join(about, "session_id")
    if titles_searched(kind, tool_name):
        title = extract.trimmed(F.coalesce("session_title", F.lit("")))
        named = about.where(title != "")
        titles = named.join(representatives(history.messages, role, after, before), "session_id").select(
            *about.columns, "message_id", "role", "time", F.concat("session_id", F.lit(":title")).alias("part_id"), F.lit("title").alias("part_type"), F.lit(False).alias("pruned"),
            F.lit(None).cast("string").alias("tool_name"), F.array(F.struct(F.lit("title").alias("field"), title.alias("text"))).alias("fields"), title.alias("raw"), "msg_ord",
            F.lit(0).alias("part_ord"), F.lit(True).alias("is_title"),
        )
        parts = parts.unionByName(titles)
    return within_budget(parts) if budget else parts


def newest_rows(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """The parts of each session's newest SESSION_MESSAGES messages, SESSION_PARTS of them at most."""
    latest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("msg_ord").desc()))
    few = messages.select("session_id", "message_id", latest.alias("k")).where(F.col("k") <= SESSION_MESSAGES)
    newest = Window.partitionBy("session_id").orderBy(F.col("msg_ord").desc(), "part_ord")
    own = rows.join(few.drop("k"), ["session_id", "message_id"], "left_semi")
    return own.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= SESSION_PARTS).drop("_n")


def within_budget(parts: DataFrame) -> DataFrame:
    """The newest SESSION_CANDIDATES parts of each session, behind its title, and of all sessions in
    list order the first CANDIDATES, up to CHARS characters of parts. The character budget ends at the
    first part beyond it."""
    listed = ["session_ord", "session_id", F.col("is_title").desc(), F.col("msg_ord").desc(), "part_ord"]
    newest = Window.partitionBy("session_id", "is_title").orderBy(F.col("msg_ord").desc(), "part_ord")
    own = parts.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= SESSION_CANDIDATES)
    # The first CANDIDATES rows alone can pass, so the global running sum sees no more.
    top = own.orderBy(*listed).limit(CANDIDATES)
    size = F.when(F.col("is_title"), 0).otherwise(F.length("raw"))
    upto = F.sum(size).over(Window.orderBy(*listed).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("_chars", upto).where(F.col("_chars") <= CHARS).drop("_n", "_chars")


#: What a hit needs besides its answers; the text stays behind.
KEPT = (
    "session_id", "session_title", "directory", "message_id", "role", "time", "part_id", "part_type", "pruned", "tool_name", "directory_relevance", "session_ord", "is_title", "msg_ord", "part_ord",
)
KEY = ("session_id", "message_id", "part_id")


def counted(tokens: Column, field: str, query: Query, mode: str) -> Column:
    """(field, len, terms): the field's length, and the distinct words that answer with their counts."""
    found = F.filter(tokens, lambda t: answers_some(t, query, mode))
    counts = F.transform(F.array(found), lambda all_: F.transform(F.array_distinct(all_), lambda t: F.struct(t.alias("term"), F.size(F.filter(all_, lambda x: x == t)).alias("tf"))))
    return F.struct(F.lit(field).alias("field"), F.size(tokens).alias("len"), F.element_at(counts, 1).alias("terms"))


def answering(found: DataFrame, query: Query, mode: str) -> tuple[DataFrame, dict]:
    """The candidates that answer some query token, as a written narrow table; and the number
    of candidates with the mean length of each field, observed while it was written."""
    tokens = {
        "primary": F.when(F.col("is_title"), F.array().cast("array<string>")).otherwise(tokenize_all(F.col("raw"))),
        "secondary": tokenize_all(F.col("directory")),
        "title": tokenize_all(F.col("session_title")),
        "hint": tokenize_all(F.col("tool_name")),
    }
    lower = F.lower("raw")
    some = lambda words: reduce(lambda a, b: a | b, [F.instr(lower, w) > 0 for w in words], F.lit(False))
    each = found.withColumns({f"t_{name}": t for name, t in tokens.items()})
    each = each.select(*KEPT, "fields", some(query.phrases).alias("has_phrase"), some(ERROR_WORDS).alias("has_error"), F.array(*[counted(F.col(f"t_{f}"), f, query, mode) for f in FIELD_BOOST]).alias("answers"))
    seen = Observation()
    lengths = [F.avg(F.get("answers", F.lit(k))["len"]).alias(f) for k, f in enumerate(FIELD_BOOST)]
    hits = each.observe(seen, F.count(F.lit(1)).alias("n"), *lengths).where(F.exists("answers", lambda a: F.size(a["terms"]) > 0))
    terms = F.array_distinct(F.flatten(F.transform("answers", lambda a: F.transform(a["terms"], lambda t: t["term"]))))
    own = F.exists("answers", lambda a: (a["field"] == F.when(F.col("is_title"), "title").otherwise("primary")) & (F.size(a["terms"]) > 0))
    table = hits.select(*KEPT, "has_phrase", "has_error", "answers", matched_terms(terms, query, mode).alias("matched_terms"), matched_fields(F.col("fields"), query, mode, own).alias("matched_fields"))
    return materialize(table, "ranked"), seen.get


#: So many distinct answering words are broadcast at most, after they are counted.
BROADCAST_WORDS = 100_000


def bm25_scores(table: DataFrame, means: dict, query: Query, mode: str) -> DataFrame:
    """(*KEY, raw_score) of the answering candidates; written."""
    flat = table.select(*KEY, F.explode("answers").alias("a")).select(*KEY, "a.field", "a.len", F.explode("a.terms").alias("t")).select(*KEY, "field", "len", "t.term", "t.tf")
    boost, mean = F.lit(None), F.lit(None)
    for f, weight in FIELD_BOOST.items():
        boost = F.when(F.col("field") == f, weight).otherwise(boost)
        mean = F.when(F.col("field") == f, F.lit(means[f])).otherwise(mean)
    weight = sum((F.coalesce(term_weight(F.col("term"), q, mode), F.lit(0.0)) for q in query.tokens), F.lit(0.0))
    words = flat.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    words = materialize(words.select("field", "term", boost.alias("boost"), weight.alias("weight"), F.log((F.lit(means["n"]) + 1) / F.col("df")).alias("idf")), "ranked-words")
    words = F.broadcast(words) if words.count() <= BROADCAST_WORDS else words
    shape = F.lit(DELTA) + (K1 + 1) * F.col("tf") / (F.lit(K1) * (F.lit(1 - B) + B * F.col("len") / mean) + F.col("tf"))
    scored = flat.join(words, ["field", "term"]).groupBy(*KEY)
    return materialize(scored.agg(F.round(F.sum(F.col("boost") * F.col("weight") * F.col("idf") * shape), DIGITS).alias("raw_score")), "ranked-scores")


def multipliers(query: Query, now_ms: int) -> list[tuple[str, Column]]:
    """(reason, factor) of what a hit has besides its relative score, 1 where it doesn't apply."""
    n = len(query.tokens)
    terms = F.size("matched_terms")
    age = F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(now_ms) - F.col("time")) / F.lit(float(RECENT_MS)))
    return [
        ("Exact phrase", F.when(F.col("has_phrase"), PHRASE).otherwise(1.0)),
        ("All tokens matched", F.when((F.lit(n) > 0) & (terms == n), ALL_TOKENS).otherwise(1.0)),
        ("Reasoning part", F.when(F.col("part_type") == "reasoning", REASONING).otherwise(1.0)),
        ("Error text", F.when((F.col("part_type") == "tool") & F.col("has_error"), ERROR_TEXT).otherwise(1.0)),
        ("User text", F.when(F.col("role") == "user", USER).otherwise(1.0)),
        ("Recency", F.lit(1.0) + age * (RECENT - 1)),
        ("Weak single-token fuzzy", F.when((F.lit(n) == 1) & (terms == 1) & (F.col("base") < WEAK_BELOW), WEAK).otherwise(1.0)),
        ("Poor coverage", F.when((F.lit(n) > 1) & (terms < n / 2), POOR).otherwise(1.0)),
    ]


def rank(history: History, targets: DataFrame, query: Query, mode: str = "smart", now_ms: int = 0, budget: bool = False, explain: bool = False, **filters) -> DataFrame:
    """Hits with score, matched terms and fields, above the noise floor."""
    if not query.tokens:
        none = [F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched_terms"), F.array().cast("array<string>").alias("matched_fields"), F.array().cast("array<string>").alias("match_reasons")]
        return _as_hits(candidates(history, targets, budget=budget, **filters).where(F.lit(False)).select(*KEPT, *none))
    table, means = answering(candidates(history, targets, budget=budget, **filters), query, mode)
    scores = bm25_scores(table, means, query, mode)
    top, hits = scores.agg(F.max("raw_score"), F.count(F.lit(1))).first()
    judged = table.drop("answers").join(scores, list(KEY))
    judged = judged.withColumn("base", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_score") / F.lit(top))), DIGITS))
    factors = multipliers(query, now_ms)
    product = reduce(lambda a, b: a * b, [f for _, f in factors])
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("base") * product)), DIGITS)
    reasons = [F.concat(F.lit("BM25 relative score: "), F.format_number("base", 2))]
    reasons += [F.when(f != 1.0, F.concat(F.lit(f"{name}: ×"), F.round(f, 3).cast("string"))) for name, f in factors]
    why = F.array_compact(F.array(*reasons)) if explain else F.array().cast("array<string>")
    judged = judged.withColumn("score", score).withColumn("match_reasons", why)
    return _as_hits(judged.where((F.col("score") >= FLOOR) | F.lit(hits <= 1)))


def _as_hits(df: DataFrame) -> DataFrame:
    whole = df.withColumns(
        {
            "snippet": F.lit(None).cast("string"),
            "source": extract.source_of(F.col("part_type")),
            "title_match": F.when(F.col("is_title"), F.col("session_title")),
            "hit_fields": F.lit(1),
        }
    )
    return whole.select(*HIT_COLUMNS, "match_reasons")


def texts_of(history: History, hits: list[dict]) -> dict[tuple, str]:
    """The texts of the few *hits* of a page, by (session_id, part_id); titles are their own text."""
    parts = [r for r in hits if r["source"] != "title"]
    out = {(r["session_id"], r["part_id"]): extract.trim_py(r["session_title"] or "") for r in hits if r["source"] == "title"}
    if parts:
        rows = history.rows
        for c in KEY:
            rows = rows.where(F.col(c).isin(sorted({r[c] for r in parts})))
        shown = rows.select("session_id", "part_id", extract.raw_text(extract.searchable_fields()).alias("raw"))
        out |= {(r["session_id"], r["part_id"]): r["raw"] for r in shown.collect()}
    return out


def in_rank_order() -> list[Column]:
    """Best score first, then newest, then by id; all ascending, so that it also serves as a key."""
    return [-F.col("score"), -F.col("time"), F.col("part_id")]
