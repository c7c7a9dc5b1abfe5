"""Registered queries: each operator on a whole test table, with its oracle SQL."""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import normalize, parse_query, snippet, tokenize_all
from ..operators import auto, browse, diagnose, filters, scan, shape
from ..operators import rank as ranking
from ..operators.recall import Engine
from ..sources.model import BASE_MS, DAY_MS, NOW_MS, conversations, documents, events, load, save
from ..sources.written import run_folder
from . import oracle as o

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

WORD = "that"
AFTER, BEFORE = BASE_MS + 2 * DAY_MS, BASE_MS + 5 * DAY_MS
SID, MID = "c3", "c3-1"
HITS = ["session_id", "message_id", "role", "time", "part_id", "part_type", "snippet"]


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = inspect.cleandoc(sql)
        return f

    return put


def everywhere(history) -> DataFrame:
    return history.sessions.withColumn("directory_relevance", F.lit("unknown"))


def literal_sql(tail: str, word: str = WORD, **where) -> str:
    return f"WITH {o.CONV},{o.conv_hits(lambda t: o.contains(t, word), lambda t: o.snippet(t, word), **where)} {tail}"


def regex_sql(tail: str, pattern: str) -> str:
    found = lambda t: f"regexp_matches(substr({t}, 1, 50000), {o.q('(?i)' + pattern)})"
    before = lambda t: f"regexp_extract(substr({t}, 1, 50000), {o.q('(?is)^(.*?)(?:' + pattern + ')')}, 1)"
    at = lambda t: f"(CASE WHEN {found(t)} THEN length({before(t)}) + 1 ELSE 0 END)"
    hits = o.conv_hits(found, lambda t: o.window(t, at(t), 200))
    return f"WITH {o.CONV},{hits} {tail}"


# Literal and pattern search


@query(literal_sql(f"SELECT {o.RESULT} FROM h"))
def literal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, everywhere(h), WORD).select(*HITS)


@query(
    """SELECT 'event' AS kind, count(*) AS parts, sum(n)::BIGINT AS fields FROM (
         SELECT (CASE WHEN event_type NOT IN ('error', 'signup') AND instr('event ' || event_type, 'e') > 0 THEN 1 ELSE 0 END) + (CASE WHEN event_type NOT IN ('error', 'signup') AND instr(event_type, 'e') > 0 THEN 1 ELSE 0 END)
              + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) + (CASE WHEN instr(lower(props), 'e') > 0 THEN 1 ELSE 0 END) AS n FROM events) WHERE n > 0"""
)
def literal_field_total(spark, sf_dir):
    h = events(spark, sf_dir)
    hits = scan.literal_scan(h, everywhere(h), "e").where("part_type = 'tool'")
    return hits.agg(F.count(F.lit(1)).alias("parts"), F.sum("hit_fields").alias("fields")).select(F.lit("event").alias("kind"), "parts", "fields")


@query(literal_sql("SELECT session_id, message_id, part_id, snippet, time FROM h WHERE is_title"))
def literal_title_hits(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, everywhere(h), WORD).where("is_title").select("session_id", "message_id", "part_id", "snippet", "time")


GROUPED = f"""SELECT session_id, hit_count, part_id, snippet, title_match, place FROM (
  SELECT session_id, part_id, snippet, count(*) OVER w AS hit_count, max(CASE WHEN is_title THEN title END) OVER w AS title_match,
         dense_rank() OVER (ORDER BY session_ord, session_id) AS place, row_number() OVER (PARTITION BY session_id ORDER BY is_title, time DESC, {o.ORDER}) AS k
  FROM h WINDOW w AS (PARTITION BY session_id)) WHERE k = 1"""


def _grouped(hits: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    grouped = shape.group_by_session(hits, shape.struct_order(scan.in_scan_order()))
    place = F.dense_rank().over(Window.orderBy("first_place.k0", "first_place.k1"))
    return grouped.select("session_id", "hit_count", "part_id", "snippet", "title_match", place.cast("long").alias("place"))


@query(literal_sql(GROUPED))
def literal_group_session(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return _grouped(scan.literal_scan(h, everywhere(h), WORD))


@query(literal_sql(f"SELECT session_id, part_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {o.ORDER}) > 2 AS held FROM h) ORDER BY held, {o.ORDER} LIMIT 25"))
def literal_diversify(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return shape.top_diverse(scan.literal_scan(h, everywhere(h), WORD), scan.in_scan_order(), 25).select("session_id", "part_id")


PATTERN = r"\bth[aeiou]+t?(ing|er)\b"


@query(regex_sql(f"SELECT {o.RESULT} FROM h", PATTERN))
def regex_scan(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.regex_scan(h, everywhere(h), PATTERN).select(*HITS)


@query(regex_sql(GROUPED, PATTERN))
def regex_group_session(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return _grouped(scan.regex_scan(h, everywhere(h), PATTERN))


@query("SELECT doc_id, " + o.snippet("text", "reth", 120) + " AS snippet FROM documents WHERE " + o.contains("text", "reth"))
def snippet_literal(spark, sf_dir):
    rows = documents(spark, sf_dir).rows
    return rows.where(F.instr(F.lower("text"), "reth") > 0).select(F.expr("cast(substring(message_id, 2) as bigint)").alias("doc_id"), snippet(F.col("text"), "reth", 120).alias("snippet"))


# Filters


@query(literal_sql(f"SELECT {o.RESULT} FROM h", where="p.role = 'user'", message_where="role = 'user'"))
def filter_role(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, everywhere(h), WORD, role="user").select(*HITS)


@query(literal_sql(f"SELECT {o.RESULT} FROM h", where="p.part_type = 'reasoning'", titles=False))
def filter_part_type(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, everywhere(h), WORD, kind="reasoning").select(*HITS)


@query(literal_sql(f"SELECT {o.RESULT} FROM h", where=f"p.time > {AFTER} AND p.time < {BEFORE}", message_where=f"time > {AFTER} AND time < {BEFORE}"))
def filter_time_window(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, everywhere(h), WORD, after=AFTER, before=BEFORE).select(*HITS)


@query("SELECT 'u' || user_id AS session_id, 'e' || event_id AS message_id, 'purchase' AS tool_name, 'stdout' AS field FROM events WHERE event_type = 'purchase'")
def filter_tool_name(spark, sf_dir):
    h = events(spark, sf_dir)
    hits = scan.literal_scan(h, everywhere(h), "purchase", tool_name="purchase")
    return hits.select("session_id", "message_id", "tool_name", F.col("matched_fields")[0].alias("field"))


TOOL_HEADS = ("", "mcp__server__", "provider.", "x/", "a-", "my", "x_")
TOOL_TAILS = (*extract.OWN_TOOLS, "recaller", "recall_", "bash")
TOOL_SQL = f"list_extract([{', '.join(o.q(t) for t in TOOL_HEADS)}], (event_id % {len(TOOL_HEADS)} + 1)::INT) || list_extract([{', '.join(o.q(t) for t in TOOL_TAILS)}], (user_id % {len(TOOL_TAILS)} + 1)::INT)"


def _pick(values, number) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _numbers(rows: DataFrame) -> DataFrame:
    """The events' part rows with their event's and user's number."""
    return rows.withColumns({"event_id": F.expr("cast(substring(message_id, 2) as bigint)"), "user_id": F.expr("cast(substring(session_id, 2) as bigint)")})


@query(f"SELECT event_id, name, regexp_matches(name, '(^|[._/-])(recall|recall_get|recall_sessions|recall_context|recall_messages)$') AS own FROM (SELECT event_id, {TOOL_SQL} AS name FROM events)")
def filter_self_tool(spark, sf_dir):
    """Whether a tool is one of the engine's own, over made-up names, one for each event."""
    rows = _numbers(events(spark, sf_dir).rows)
    named = rows.select("event_id", F.concat(_pick(TOOL_HEADS, F.col("event_id")), _pick(TOOL_TAILS, F.col("user_id"))).alias("name"))
    return named.select("event_id", "name", extract.is_own_tool(F.col("name")).alias("own"))


@query(literal_sql(f"SELECT {o.RESULT} FROM h", sessions="s.directory = '/workspace/p1'"))
def directory_exact(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return scan.literal_scan(h, filters.with_buckets(h.sessions, "/workspace//p1/", None, False), WORD).select(*HITS)


BUCKET = "CASE WHEN s.directory = '/workspace/p1' THEN 'exact' WHEN s.directory = '/workspace/p2' THEN 'project' ELSE 'global' END"


@query(
    literal_sql(
        f"""SELECT session_id, part_id, bucket, row_number() OVER (ORDER BY b, time DESC, {o.ORDER}) AS place FROM (
          SELECT h.*, {BUCKET} AS bucket, CASE {BUCKET} WHEN 'exact' THEN 0 WHEN 'project' THEN 1 ELSE 2 END AS b FROM h JOIN s USING (session_id, session_ord, title, directory))
          ORDER BY place LIMIT 40"""
    )
)
def directory_fallback_order(spark, sf_dir):
    from pyspark.sql import Window

    h = conversations(spark, sf_dir)
    hits = scan.literal_scan(h, filters.with_buckets(h.sessions, "/workspace/p1", "/workspace/p2", True), WORD)
    order = shape.directory_order(scan.in_scan_order())
    top = hits.orderBy(*order).limit(40)
    return top.select("session_id", "part_id", F.col("directory_relevance").alias("bucket"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"WITH {o.CONV} SELECT CASE WHEN directory = '/workspace/p1' THEN 'exact' WHEN directory = '/workspace/p2' THEN 'project' ELSE 'global' END AS directory_relevance, count(*) AS n FROM s GROUP BY 1")
def directory_buckets(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return diagnose.bucket_counts(filters.with_buckets(h.sessions, "/workspace/p1", "/workspace/p2", True))


@query(f"WITH {o.CONV} SELECT session_id, session_ord::INT AS session_ord FROM s WHERE directory = '/workspace/p1' ORDER BY session_ord, session_id LIMIT 7")
def sessions_cap(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return filters.first_sessions(filters.with_buckets(h.sessions, "/workspace/p1", None, False), 7).select("session_id", "session_ord")


@query(f"WITH {o.CONV} SELECT session_id, project_id, directory, title, time_updated FROM s")
def dedupe_sessions(spark, sf_dir):
    s = conversations(spark, sf_dir).sessions
    return filters.dedupe_sessions(s.unionByName(s.where("project_id = 'p1'"))).select("session_id", "project_id", "directory", "title", "time_updated")


# Browsing


@query(f"WITH {o.CONV} SELECT session_id, title, directory, time_created, time_updated, archived FROM s WHERE project_id = 'p1' ORDER BY session_ord, session_id LIMIT 20")
def list_sessions(spark, sf_dir):
    return browse.list_sessions(conversations(spark, sf_dir), "project", "p1").select("session_id", "title", "directory", "time_created", "time_updated", "archived")


@query(f"WITH {o.CONV} SELECT session_id, title, 'project ' || (session_ord % 3) AS project, archived FROM s WHERE instr(lower(title), 'the') > 0 ORDER BY session_ord, session_id LIMIT 20")
def list_sessions_title(spark, sf_dir):
    listed = browse.list_sessions(conversations(spark, sf_dir), "global", None, "The")
    return listed.select("session_id", "title", F.col("project.name").alias("project"), "archived")


@query(f"WITH {o.CONV} SELECT message_id, role, time AS time_created, part_id, text AS content, count(*) OVER () AS total FROM p WHERE session_id = '{SID}' ORDER BY msg_ord LIMIT 2 OFFSET 1")
def messages_page(spark, sf_dir):
    page = browse.messages_page(conversations(spark, sf_dir), SID, offset=1, limit=2)
    part = F.col("parts")[0]
    return page.select("message_id", "role", "time_created", part["id"].alias("part_id"), part["content"].alias("content"), "total")


@query(f"WITH {o.CONV} SELECT message_id, msg_ord::INT AS msg_ord FROM p WHERE session_id = '{SID}' AND role = 'user' AND instr(lower(text), 'th') > 0 ORDER BY msg_ord DESC LIMIT 2")
def messages_reverse_query(spark, sf_dir):
    return browse.messages_page(conversations(spark, sf_dir), SID, limit=2, role="user", reverse=True, query="TH").select("message_id", "msg_ord")


@query(f"WITH {o.CONV} SELECT message_id, role, time AS time_created, 'build' AS agent, 'model' AS model_id, part_type AS type, text AS content, false AS pruned FROM p WHERE message_id = '{MID}'")
def get_message(spark, sf_dir):
    part = F.col("parts")[0]
    found = browse.get_message(conversations(spark, sf_dir), SID, MID)
    return found.select("message_id", "role", "time_created", "agent", "model_id", part["type"].alias("type"), part["content"].alias("content"), part["pruned"].alias("pruned"))


@query(f"WITH {o.CONV} SELECT message_id, role, text AS content FROM p WHERE session_id = '{SID}' AND msg_ord BETWEEN 0 AND 2")
def context_window(spark, sf_dir):
    around = browse.context_window(conversations(spark, sf_dir), SID, MID, before=1, after=1)
    return around.select("message_id", "role", F.col("parts")[0]["content"].alias("content"))


@query(f"WITH {o.CONV} SELECT message_id, message_id = '{MID}' AS center, false AS has_more_before, n > 2 AS has_more_after FROM (SELECT *, count(*) OVER () AS n FROM p WHERE session_id = '{SID}') WHERE msg_ord BETWEEN 0 AND 1")
def context_flags(spark, sf_dir):
    around = browse.context_window(conversations(spark, sf_dir), SID, MID, before=1, after=0, parts=False)
    return around.select("message_id", "center", "has_more_before", "has_more_after")


# Extraction and text


@query(
    """SELECT 'e' || event_id AS message_id, k::INT AS k, f.field AS field, f.text AS text FROM (SELECT event_id, unnest(range(len(fs))) AS k, unnest(fs) AS f FROM (
      SELECT event_id, list_filter([
        CASE WHEN event_type NOT IN ('error', 'signup') THEN {'field': 'stdout', 'text': 'event ' || event_type} END,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN {'field': 'toolName', 'text': event_type} END,
        CASE WHEN event_type = 'error' THEN {'field': 'stderr', 'text': 'event failed: ' || event_type} END,
        CASE WHEN props IS NOT NULL THEN {'field': 'command', 'text': props} END], lambda x: x IS NOT NULL) AS fs FROM events))"""
)
def extract_fields(spark, sf_dir):
    rows = events(spark, sf_dir).rows
    return rows.select("message_id", F.posexplode(extract.searchable_fields()).alias("k", "f")).select("message_id", "k", "f.field", "f.text")


INPUT_HEADS = ('{"command":"npm test",', '{"command":5,"cwd":"/tmp",', '{"command":" \\t ","cwd":"/a b",', '{"path":"cache",', '{"cwd":"/x","command":"ls -l",', '{"cwd":null,"command":["ls"],')
INPUT_SQL = f"list_extract([{', '.join(o.q(t) for t in INPUT_HEADS)}], (event_id % {len(INPUT_HEADS)} + 1)::INT) || substr(props, 2)"
_MEMBER = "CASE WHEN json_type(x, '$.{0}') = 'VARCHAR' AND trim(x ->> '$.{0}', chr(9) || chr(10) || ' ') <> '' THEN {{'field': '{0}', 'text': x ->> '$.{0}'}} END"


@query(
    f"SELECT event_id, i::INT AS i, f.field AS field, f.text AS text FROM (SELECT event_id, unnest(range(len(fs))) AS i, unnest(fs) AS f FROM (SELECT event_id, list_filter([{_MEMBER.format('command')}, {_MEMBER.format('cwd')},"
    f"{{'field': 'command', 'text': x}}], lambda v: v IS NOT NULL) AS fs FROM (SELECT event_id, {INPUT_SQL} AS x FROM events)))"
)
def tool_input_fields(spark, sf_dir):
    """The fields of a running tool's input, over the events' properties with members put before them."""
    rows = _numbers(events(spark, sf_dir).rows)
    given = F.concat(_pick(INPUT_HEADS, F.col("event_id")), F.expr("substring(tool_input, 2)"))
    running = rows.withColumns({"tool_status": F.lit("running"), "tool": F.lit("bash"), "tool_input": given})
    return running.select("event_id", F.posexplode(extract.searchable_fields()).alias("i", "f")).select("event_id", "i", "f.field", "f.text")


@query("SELECT event_type AS tool, count(*) AS parts, sum(CASE WHEN event_type NOT IN ('error', 'signup') AND event_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS pruned FROM events GROUP BY 1")
def pruned_flag(spark, sf_dir):
    return events(spark, sf_dir).rows.groupBy("tool").agg(F.count(F.lit(1)).alias("parts"), F.sum(extract.pruned().cast("long")).alias("pruned"))


#: Kinds of parts, dealt to the events by number.
KINDS = ("text", "reasoning", "tool", "subtask", "compaction", "file", "snapshot", "patch", "agent", "retry", "step-start", "step-finish", "other")


@query(
    f"""SELECT event_id, CASE kind WHEN 'text' THEN props WHEN 'reasoning' THEN props WHEN 'subtask' THEN '[subtask] ' || event_type
          WHEN 'compaction' THEN CASE WHEN user_id % 2 = 0 THEN '[compaction boundary (auto)]' ELSE '[compaction boundary]' END
          WHEN 'file' THEN '[file] ' || CASE WHEN user_id % 2 = 0 THEN 'f' || user_id ELSE 'file://' || user_id END WHEN 'snapshot' THEN '[snapshot] s' || user_id
          WHEN 'patch' THEN '[patch] a' || user_id || ', ' || event_type WHEN 'agent' THEN '[agent] ' || event_type WHEN 'retry' THEN '[retry] attempt ' || user_id
          WHEN 'step-start' THEN '[step-start]' WHEN 'step-finish' THEN '[step-finish] ' || event_type WHEN 'other' THEN '[other]' END AS content,
        CASE WHEN kind = 'tool' THEN event_type END AS tool_name, CASE WHEN kind = 'tool' AND event_type NOT IN ('error', 'signup') THEN event_type END AS title,
        CASE WHEN kind = 'tool' THEN props END AS input, CASE WHEN kind = 'tool' AND event_type NOT IN ('error', 'signup') THEN 'event ' || event_type END AS output,
        CASE WHEN kind = 'tool' AND event_type = 'error' THEN 'event failed: error' WHEN kind = 'retry' THEN 'busy ' || user_id END AS error
        FROM (SELECT *, list_extract([{', '.join(o.q(k) for k in KINDS)}], (event_id % {len(KINDS)} + 1)::INT) AS kind FROM events)"""
)
def format_parts(spark, sf_dir):
    """Every kind of part as it is shown, tools in each state and subtasks included."""
    rows = _numbers(events(spark, sf_dir).rows)
    even, user = F.col("user_id") % 2 == 0, F.col("user_id").cast("string")
    attrs = F.to_json(
        F.struct(
            F.when(even, True).alias("auto"), F.when(even, F.concat(F.lit("f"), user)).alias("filename"), F.concat(F.lit("file://"), user).alias("url"), F.concat(F.lit("s"), user).alias("snapshot"),
            F.array(F.concat(F.lit("a"), user), F.col("tool")).alias("files"), F.col("tool").alias("name"), F.col("user_id").alias("attempt"), F.concat(F.lit("busy "), user).alias("error"), F.col("tool").alias("reason"),
        )
    )
    full = rows.withColumns({"part_type": _pick(KINDS, F.col("event_id")), "text": F.col("tool_input"), "description": F.col("tool"), "attrs": attrs})
    return full.select("event_id", extract.display().alias("d")).select("event_id", "d.content", "d.tool_name", "d.title", "d.input", "d.output", "d.error")


@query(f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({o.tokens('text')}) AS t FROM conversations) GROUP BY 1")
def tokenize_counts(spark, sf_dir):
    rows = conversations(spark, sf_dir).rows
    return rows.select(F.explode(tokenize_all(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT 'c' || conv_id || '-' || turn AS message_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[_\-/.]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')), '\s+', ' ', 'g')) AS normalized FROM conversations")
def normalize_text(spark, sf_dir):
    return conversations(spark, sf_dir).rows.select("message_id", normalize(F.col("text")).alias("normalized"))


# Ranking

EXACT, PREFIX, TYPO, PHRASE = parse_query("the of and"), parse_query("anti thed"), parse_query("thatni onthe"), parse_query('"of the" ondthe')
SCORED = "session_id, part_id, part_type, score, array_to_string(matched_terms, ' ') AS matched_terms"


def rank_sql(query_, mode: str, tail: str = f"SELECT {SCORED} FROM r", **where) -> str:
    return f"WITH {o.CONV},{o.ranked(query_, mode, **where)} {tail}"


def _ranked(spark, sf_dir, query_, mode="smart", **where):
    h = conversations(spark, sf_dir)
    return ranking.rank(h, everywhere(h), query_, mode, NOW_MS, **where)


def _scored(hits):
    return hits.select("session_id", "part_id", "part_type", "score", F.array_join("matched_terms", " ").alias("matched_terms"))


@query(rank_sql(EXACT, "smart"))
def bm25_exact(spark, sf_dir):
    return _scored(_ranked(spark, sf_dir, EXACT))


@query(rank_sql(PREFIX, "smart"))
def bm25_prefix(spark, sf_dir):
    return _scored(_ranked(spark, sf_dir, PREFIX))


@query(rank_sql(TYPO, "fuzzy"))
def bm25_fuzzy_ascii(spark, sf_dir):
    return _scored(_ranked(spark, sf_dir, TYPO, "fuzzy"))


@query(rank_sql(PHRASE, "smart", where=f"time > {AFTER}"))
def bm25_multipliers(spark, sf_dir):
    return _scored(_ranked(spark, sf_dir, PHRASE, after=AFTER))


@query(
    rank_sql(
        EXACT,
        "smart",
        f"""SELECT session_id, part_id, score, hit_count FROM (SELECT session_id, part_id, score, count(*) OVER (PARTITION BY session_id) AS hit_count,
            row_number() OVER (PARTITION BY session_id ORDER BY is_title, {o.RANK_ORDER}) AS k FROM r) WHERE k = 1""",
    )
)
def bm25_grouped(spark, sf_dir):
    hits = _ranked(spark, sf_dir, EXACT)
    return shape.group_by_session(hits, shape.struct_order(ranking.in_rank_order())).select("session_id", "part_id", "score", "hit_count")


@query(rank_sql(EXACT, "smart", f"SELECT session_id, part_id, score FROM r ORDER BY {o.RANK_ORDER} LIMIT 10"))
def bm25_top(spark, sf_dir):
    return _ranked(spark, sf_dir, EXACT).orderBy(*ranking.in_rank_order()).limit(10).select("session_id", "part_id", "score")


@query(rank_sql(PREFIX, "smart", f"SELECT (SELECT count(*) FROM fs) AS scored, count(*) AS kept, count(*) FILTER (score < {ranking.FLOOR}) AS below FROM r"))
def noise_floor(spark, sf_dir):
    h = conversations(spark, sf_dir)
    table, _ = ranking.answering(ranking.candidates(h, everywhere(h)), PREFIX, "smart")
    scored = table.agg(F.count(F.lit(1)).alias("scored"))
    kept = ranking.rank(h, everywhere(h), PREFIX, "smart", NOW_MS).agg(F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("score") < ranking.FLOOR, 1)).alias("below"))
    return scored.join(F.broadcast(kept), how="cross")  # one row each


@query(rank_sql(PREFIX, "smart", "SELECT unnest(matched_terms) AS term, count(*) AS n FROM r GROUP BY 1"))
def matched_terms(spark, sf_dir):
    return _ranked(spark, sf_dir, PREFIX).select(F.explode("matched_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


#: Part of words, and the start or the misspelling of none.
INNER = "rtione"


@query(
    f"WITH {o.CONV}, k AS (WITH {o.ranked(parse_query(INNER), 'smart').strip()} SELECT session_id, part_id, 'none' AS degrade FROM r), "
    f"{o.conv_hits(lambda t: o.contains(t, INNER), lambda t: o.snippet(t, INNER)).strip()} "
    "SELECT * FROM k UNION ALL SELECT session_id, part_id, 'fallback' FROM h WHERE (SELECT count(*) FROM k) = 0"
)
def smart_fallback_literal(spark, sf_dir):
    """Where nothing ranks, the literal scan answers."""
    h = conversations(spark, sf_dir)
    ranked = ranking.rank(h, everywhere(h), parse_query(INNER), "smart", NOW_MS).select("session_id", "part_id", F.lit("none").alias("degrade"))
    if ranked.isEmpty():
        return scan.literal_scan(h, everywhere(h), INNER).select("session_id", "part_id", F.lit("fallback").alias("degrade"))
    return ranked


@query(
    f"""WITH {o.CONV}, c AS (
          SELECT s.session_ord, p.session_id, part_id, msg_ord, 1 AS after_title, length(substr(text, 1, 20000)) AS n,
                 row_number() OVER (PARTITION BY p.session_id ORDER BY msg_ord DESC) AS own FROM p JOIN s USING (session_id) WHERE text <> ''
          UNION ALL SELECT session_ord, session_id, session_id || ':title', 0, 0, 0, 1 FROM s WHERE trim(title) <> '')
        SELECT session_id, part_id FROM (
          SELECT *, sum(n) OVER w AS chars, row_number() OVER w AS k FROM c WHERE own <= {ranking.SESSION_CANDIDATES}
          WINDOW w AS (ORDER BY session_ord, session_id, after_title, msg_ord DESC ROWS UNBOUNDED PRECEDING)) WHERE k <= {ranking.CANDIDATES} AND chars <= {ranking.CHARS}"""
)
def budget_cut(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return ranking.candidates(h, everywhere(h), budget=True).select("session_id", "part_id")


# Diagnostics, hooks, metrics


@query(f"WITH {o.CONV} SELECT count(*) AS messages_searched, count(*) FILTER (part_type = 'reasoning') AS parts_searched FROM p WHERE role = 'assistant' AND time > {AFTER}")
def coverage_counts(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return diagnose.coverage_counts(h, everywhere(h), kind="reasoning", role="assistant", after=AFTER)


@query(f"WITH {o.CONV} SELECT count(*) AS discovered, count(*) FILTER (directory = '/workspace/p1') AS eligible, least(5, count(*) FILTER (directory = '/workspace/p1')) AS searched, count(*) FILTER (directory <> '/workspace/p1') AS skipped_directory FROM s")
def limit_accounting(spark, sf_dir):
    h = conversations(spark, sf_dir)
    exact = filters.with_buckets(h.sessions, "/workspace/p1", None, False)
    counts = h.sessions.agg(F.count(F.lit(1)).alias("discovered"))
    counts = counts.join(F.broadcast(exact.agg(F.count(F.lit(1)).alias("eligible"))), how="cross")
    counts = counts.join(F.broadcast(filters.first_sessions(exact, 5).agg(F.count(F.lit(1)).alias("searched"))), how="cross")
    return counts.select("discovered", "eligible", "searched", (F.col("discovered") - F.col("eligible")).alias("skipped_directory"))


@query(f"WITH {o.CONV} SELECT session_id FROM s WHERE session_ord % 4 = 1")
def load_errors(spark, sf_dir):
    h = conversations(spark, sf_dir)
    h.messages = h.messages.join(h.sessions.where("session_ord % 4 = 1"), "session_id", "left_anti")
    return diagnose.load_errors(h, everywhere(h)).select("session_id")


@query(f"WITH {o.CONV} SELECT session_id, title, directory FROM s ORDER BY session_ord LIMIT 3")
def near_misses(spark, sf_dir):
    return diagnose.near_misses(everywhere(conversations(spark, sf_dir))).select("session_id", "title", "directory")


ASKED = (
    "what did we decide about the token bucket last time? ", "Remember the rate-limit fix from before, please: ", "clean up before committing this ", "\n/recall last time stuff ", "recall(query) as before ",
    "last time", "like before: ", "did we ever try redis? did we ever? ", "the approach we used for OAuth redirects ", "\t/x as before ", "previously 'quoted' text in another session: ",
)
ASKED_SQL = f"list_extract([{', '.join(o.q(t) for t in ASKED)}], (conv_id % {len(ASKED)} + 1)::INT) || text"


@query(o.cue_gate(f"(SELECT conv_id || '-' || turn AS k, {ASKED_SQL} AS text FROM conversations)"))
def auto_gate(spark, sf_dir):
    """Which turns ask for history, and for what, with wordings that do or don't put before every turn."""
    rows = conversations(spark, sf_dir).rows
    asked = F.concat(_pick(ASKED, F.expr("cast(substring(session_id, 2) as bigint)")), F.col("text"))
    return rows.select(F.expr("substring(message_id, 2)").alias("k"), auto.cue_query(asked).alias("query")).where("query is not null")


CASES = ("the of and", "anti thed", "erer edin", "that with")


@query(
    "WITH "
    + o.CONV
    + ", "
    + ", ".join(
        f"k{i} AS (WITH {o.ranked(parse_query(c), 'smart').strip()} SELECT session_id, row_number() OVER (ORDER BY s0 DESC, t0 DESC, p0) AS rank FROM (SELECT session_id, max(score) AS s0, arg_min(time, place) AS t0, arg_min(part_id, place) AS p0 "
        f"FROM (SELECT *, row_number() OVER (ORDER BY {o.RANK_ORDER}) AS place FROM r) GROUP BY session_id))"
        for i, c in enumerate(CASES)
    )
    + ", f AS ("
    + " UNION ALL ".join(f"SELECT {i} AS case_id, min(rank) AS first FROM k{i} WHERE session_id = 'c{i}'" for i in range(len(CASES)))
    + ") SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_5, count(*) AS cases FROM f"
)
def eval_metrics(spark, sf_dir):
    from pyspark.sql import Window

    h = conversations(spark, sf_dir)
    ranked = None
    for i, text in enumerate(CASES):
        grouped = shape.group_by_session(ranking.rank(h, everywhere(h), parse_query(text), "smart", NOW_MS), shape.struct_order(ranking.in_rank_order()))
        placed = grouped.select(F.lit(i).alias("case_id"), "session_id", F.row_number().over(Window.orderBy("first_place")).alias("rank"))
        ranked = placed if ranked is None else ranked.unionByName(placed)
    cases = spark.createDataFrame([(i, f"c{i}") for i in range(len(CASES))], "case_id int, relevant string")
    m = diagnose.relevance_metrics(ranked, cases)
    return m.select(F.round("mrr", 9).alias("mrr"), F.round("recall_at_5", 9).alias("recall_at_5"), "cases")


@query(rank_sql(parse_query(auto.DURABLE_QUERY), "smart", f"SELECT part_id, score FROM r WHERE score >= {auto.KEEP_SCORE} ORDER BY {o.RANK_ORDER} LIMIT {auto.KEEP_HITS}"))
def durable_findings(spark, sf_dir):
    hits = _ranked(spark, sf_dir, parse_query(auto.DURABLE_QUERY))
    return hits.where(F.col("score") >= auto.KEEP_SCORE).orderBy(*ranking.in_rank_order()).limit(auto.KEEP_HITS).select("part_id", "score")


# The whole call: pages of results, accounts, expansions


def _engine(spark, sf_dir, **place) -> Engine:
    return Engine(conversations(spark, sf_dir), NOW_MS, **place)


#: Columns of a page, as (schema, value of a result).
PAGE = "place int, session_id string, message_id string, part_id string, snippet string, source string, confidence string, recency string, fields string, directory_relevance string, match_mode string, hit_count long"


def _page_rows(spark, out: dict) -> DataFrame:
    """A page of results as rows, in order; for at most 50 rows."""
    rows = [
        (k, r["session_id"], r["message_id"], r["part_id"], r["snippet"], r["source"], r["why"]["confidence"], r["why"]["recency"], " ".join(r["why"]["matched_fields"]), r["directory_relevance"], r.get("match_mode", "literal"), r.get("hit_count", 0))
        for k, r in enumerate(out["results"])
    ]
    full = spark.createDataFrame(rows, PAGE)
    return full.withColumns({"total": F.lit(out["total"]).cast("long"), "truncated": F.lit(out["truncated"]), "scanned": F.lit(out["scanned"]).cast("long")})


#: What the page shows of a hit, in SQL.
SHOWN = f"""session_id, message_id, part_id, snippet, CASE WHEN part_type IN ('title', 'reasoning') THEN part_type ELSE 'message' END AS source,
  CASE WHEN is_title THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN {NOW_MS} - time <= 7 * 86400000 THEN 'recent' ELSE 'older' END AS recency"""

def page_sql(order: str, limit: int, fields: str = "CASE WHEN is_title THEN 'title' WHEN part_type = 'reasoning' THEN 'reasoning' ELSE 'text' END", relevance: str = "'unknown'", mode: str = "'literal'", scanned: str = "(SELECT count(*) FROM s)") -> str:
    """The first *limit* hits of h in *order*, with at most two of a session while others wait."""
    return f"""SELECT (row_number() OVER (ORDER BY held, {order}) - 1)::INT AS place, {SHOWN}, {fields} AS fields, {relevance} AS directory_relevance, {mode} AS match_mode, 0::BIGINT AS hit_count,
      (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > {limit} AS truncated, {scanned} AS scanned
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) > 2 AND (SELECT count(*) FROM h) > {limit} AS held FROM h) ORDER BY place LIMIT {limit}"""


@query(literal_sql(page_sql(o.ORDER, 10)))
def recall_page(spark, sf_dir):
    return _page_rows(spark, _engine(spark, sf_dir).recall(query=WORD))


@query(regex_sql(page_sql(o.ORDER, 25, mode="'regex'"), PATTERN))
def recall_regex_page(spark, sf_dir):
    return _page_rows(spark, _engine(spark, sf_dir).recall(query=PATTERN, match="regex", results=25))


@query(literal_sql(page_sql(o.ORDER, 50, scanned="(SELECT count(*) FROM s WHERE project_id = 'p1')"), sessions="s.project_id = 'p1'"))
def recall_scope_and_clamp(spark, sf_dir):
    """The project's sessions only; 1,000 results are clamped to 50."""
    return _page_rows(spark, _engine(spark, sf_dir, project_id="p1").recall(query=WORD, scope="project", results=1000))


@query(
    literal_sql(
        f"""SELECT (row_number() OVER (ORDER BY session_ord, session_id) - 1)::INT AS place, {SHOWN}, CASE WHEN is_title THEN 'title' WHEN part_type = 'reasoning' THEN 'reasoning' ELSE 'text' END AS fields,
        'unknown' AS directory_relevance, 'literal' AS match_mode, hit_count, (SELECT count(DISTINCT session_id) FROM h) AS total, (SELECT count(DISTINCT session_id) FROM h) > 7 AS truncated, (SELECT count(*) FROM s) AS scanned
        FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS hit_count, row_number() OVER (PARTITION BY session_id ORDER BY is_title, time DESC, {o.ORDER}) AS k FROM h) WHERE k = 1 ORDER BY place LIMIT 7"""
    )
)
def recall_grouped(spark, sf_dir):
    return _page_rows(spark, _engine(spark, sf_dir).recall(query=WORD, group="session", results=7))


DAY_FROM, DAY_TO = "2024-01-03", "Jan 6, 2024 12:00"


@query(
    literal_sql(
        page_sql(o.ORDER, 10),
        where=f"p.time > epoch_ms(TIMESTAMP '{DAY_FROM}') AND p.time < epoch_ms(TIMESTAMP '2024-01-06 12:00:00')",
        message_where=f"time > epoch_ms(TIMESTAMP '{DAY_FROM}') AND time < epoch_ms(TIMESTAMP '2024-01-06 12:00:00')",
    )
)
def recall_dates(spark, sf_dir):
    """Dates in two forms; of the lower bounds the narrower one holds."""
    return _page_rows(spark, _engine(spark, sf_dir).recall(query=WORD, after=DAY_FROM, since="40w", to=DAY_TO))


@query(
    literal_sql(
        page_sql(o.ORDER, 10),
        where=f"p.time > {NOW_MS} - 44 * 86400000::BIGINT AND p.time < {NOW_MS} - 6 * 604800000::BIGINT",
        message_where=f"time > {NOW_MS} - 44 * 86400000::BIGINT AND time < {NOW_MS} - 6 * 604800000::BIGINT",
    )
)
def recall_durations(spark, sf_dir):
    """Spans back from now; spans of no width or in minutes are left out."""
    return _page_rows(spark, _engine(spark, sf_dir).recall(query=WORD, last="44d", since="0d", until="6w ago", before="90m"))


@query(
    literal_sql(
        f"""SELECT (row_number() OVER (ORDER BY b, time DESC, held, {o.ORDER}) - 1)::INT AS place, {SHOWN}, CASE WHEN is_title THEN 'title' WHEN part_type = 'reasoning' THEN 'reasoning' ELSE 'text' END AS fields,
        bucket AS directory_relevance, 'literal' AS match_mode, 0::BIGINT AS hit_count, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 30 AS truncated, (SELECT count(*) FROM s) AS scanned
        FROM (SELECT *, sum((NOT held)::INT) OVER () AS free FROM (
          SELECT h.*, {BUCKET} AS bucket, CASE {BUCKET} WHEN 'exact' THEN 0 WHEN 'project' THEN 1 ELSE 2 END AS b, row_number() OVER (PARTITION BY session_id ORDER BY {o.ORDER}) > 2 AND (SELECT count(*) FROM h) > 30 AS held
          FROM h JOIN s USING (session_id, session_ord, title, directory))) WHERE NOT held OR free < 30 ORDER BY place LIMIT 30"""
    )
)
def recall_fallback(spark, sf_dir):
    """A directory, then its project, then all the rest."""
    out = _engine(spark, sf_dir, worktree="/workspace/p2", project_id="p0").recall(query=WORD, directory="/workspace/p1", fallback=True, scope="project", results=30)
    return _page_rows(spark, out)


@query(
    f"""WITH {o.CONV}, c AS (SELECT count(*) AS n, count(*) FILTER (directory = '/workspace/p1') AS e FROM s)
    SELECT n AS discovered, e AS eligible, least(e, 5) AS searched, n - least(e, 5) AS skipped, n - e AS by_directory, greatest(e - 5, 0) AS by_sessions, 'exact' AS buckets,
           'time directory ' || (CASE WHEN e > 5 THEN 'sessionsLimit ' ELSE '' END) || 'title' AS limited_by, m.n_messages AS messages, m.n_parts AS parts
    FROM (SELECT count(*) AS n, count(*) FILTER (directory = '/workspace/p1') AS e FROM s WHERE instr(lower(title), 'e') > 0) c,
         (SELECT count(*) AS n_messages, count(*) FILTER (part_type = 'reasoning') AS n_parts FROM p WHERE time > {AFTER} AND role = 'assistant' AND session_id IN (
            SELECT session_id FROM s WHERE directory = '/workspace/p1' AND instr(lower(title), 'e') > 0 ORDER BY session_ord, session_id LIMIT 5)) m"""
)
def recall_account(spark, sf_dir):
    """What a search says it covered, and what limited it."""
    out = _engine(spark, sf_dir).recall(query=WORD, directory="/workspace/p1", title="E", sessions=5, after=AFTER, role="assistant", type="reasoning")["coverage"]
    skipped = out.get("skipped_by_reason", {})
    row = (
        out["sessions_discovered"], out["sessions_eligible"], out["sessions_searched"], out["sessions_skipped"], skipped.get("directory", 0), skipped.get("sessionsLimit", 0),
        " ".join(out["directory_buckets_searched"]), " ".join(out["limited_by"]), out["messages_searched"], out["parts_searched"],
    )
    return spark.createDataFrame([row], "discovered long, eligible long, searched long, skipped long, by_directory long, by_sessions long, buckets string, limited_by string, messages long, parts long")


@query(
    f"""WITH {o.CONV}
    SELECT 'searched' AS kind, session_id AS name FROM (SELECT session_id FROM s ORDER BY session_ord LIMIT 3)
    UNION ALL SELECT 'hint', hint FROM (VALUES ('match:smart'), ('type:all')) v(hint)"""
)
def recall_nothing_found(spark, sf_dir):
    """Near misses and the suggested changes of a search that finds nothing."""
    out = _engine(spark, sf_dir).recall(query="zz none at all zz", type="text")
    rows = [("searched", m["session_id"]) for m in out["near_misses"]]
    rows += [("hint", ":".join(next(iter(h["example"].items())))) for h in out["suggestions"] if "example" in h]
    return spark.createDataFrame(rows, "kind string, name string")


@query(rank_sql(EXACT, "smart", page_sql(o.RANK_ORDER, 20, fields=o.ranked_fields(EXACT), mode="'smart'").replace("FROM h", "FROM r").replace("snippet,", o.smart_snippet("raw", EXACT, 200) + " AS snippet,", 1)))
def smart_snippets(spark, sf_dir):
    """The page of a ranked search, with snippets made for its few rows."""
    return _page_rows(spark, _engine(spark, sf_dir).recall(query="the of and", match="smart", results=20))


REASONS = (
    ("Exact phrase", "(instr(lower(raw), 'of the') > 0)"), ("All tokens matched", "len(matched_terms) = 3"), ("Reasoning part", "part_type = 'reasoning'"), ("User text", "role = 'user'"),
    ("Recency", f"({NOW_MS} - time) < {float(ranking.RECENT_MS)}::DOUBLE"), ("Poor coverage", "len(matched_terms) < 1.5"),
)


@query(
    rank_sql(
        PHRASE,
        "smart",
        "SELECT session_id, part_id, score, " + o.ranked_fields(PHRASE) + " AS fields, array_to_string(list_filter(['BM25 relative score'," + ",".join(f"CASE WHEN {c} THEN {o.q(n)} END" for n, c in REASONS) + "], lambda x: x IS NOT NULL), '; ') AS reasons FROM r",
    )
)
def bm25_reasons(spark, sf_dir):
    """Why a hit has its score, and in which fields it was found."""
    hits = _ranked(spark, sf_dir, PHRASE, explain=True)
    reasons = F.array_join(F.transform("match_reasons", lambda r: F.split(r, ":")[0]), "; ")
    return hits.select("session_id", "part_id", "score", F.array_join("matched_fields", " ").alias("fields"), reasons.alias("reasons"))


def _expanded(spark, out: dict) -> DataFrame:
    rows = [(e["result_index"], e["session_id"], m["message"]["message_id"], m["center"], e["has_more_before"], e["has_more_after"]) for e in out["expanded"] for m in e["messages"]]
    return spark.createDataFrame(rows, "result_index int, session_id string, message_id string, center boolean, has_more_before boolean, has_more_after boolean")


def expand_sql(count: int, window: int) -> str:
    """The messages around the first *count* results that are no titles, under a budget that takes them all."""
    return literal_sql(
        f"""SELECT result_index, session_id, m.message_id, m.message_id = t.message_id AS center, t.at - {window} > 0 AS has_more_before, t.at + {window} + 1 < t.n AS has_more_after
        FROM (SELECT result_index, g.session_id, g.message_id, q.at, q.n FROM (
                SELECT (row_number() OVER (ORDER BY held, {o.ORDER}) - 1)::INT AS result_index, * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {o.ORDER}) > 2 AND (SELECT count(*) FROM h) > 10 AS held FROM h)
                ORDER BY result_index LIMIT 10) g JOIN q USING (session_id, message_id) WHERE NOT is_title ORDER BY result_index LIMIT {count}) t
        JOIN q m USING (session_id) WHERE m.at BETWEEN t.at - {window} AND t.at + {window}"""
    ).replace("WITH ", "WITH q AS (SELECT 'c' || conv_id AS session_id, 'c' || conv_id || '-' || turn AS message_id, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),", 1)


@query(expand_sql(3, 1))
def expand_context(spark, sf_dir):
    return _expanded(spark, _engine(spark, sf_dir).recall(query=WORD, expand="context", expandResults=3, window=1))


@query(expand_sql(2, 2))
def expand_auto_window(spark, sf_dir):
    """Ten messages for two hits leave a window of two on either side."""
    return _expanded(spark, _engine(spark, sf_dir).recall(query=WORD, expand="context", expandResults=2, window="auto", expandBudgetMessages=10))


BUDGET, MARK = 700, "\n[truncated by recall expansion]"


@query(
    literal_sql(
        f"""SELECT result_index, message_id, content FROM (
          SELECT result_index, message_id, CASE WHEN left_ >= length(text) AND left_ > 0 THEN text WHEN least(4000, left_) > {len(MARK)} THEN substr(text, 1, least(4000, left_) - {len(MARK)}) || {o.q(MARK).replace(chr(10), "' || chr(10) || '")} END AS content
          FROM e)"""
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        " SELECT result_index, message_id, content FROM (",
        f""", g AS (SELECT row_number() OVER (ORDER BY result_index) AS k, * FROM (
              SELECT (row_number() OVER (ORDER BY held, {o.ORDER}) - 1)::INT AS result_index, * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {o.ORDER}) > 2 AND (SELECT count(*) FROM h) > 10 AS held FROM h)
              ORDER BY result_index LIMIT 10) JOIN (SELECT part_id, text FROM p) USING (part_id) WHERE NOT is_title ORDER BY result_index LIMIT 3),
        e AS (SELECT k, result_index, message_id, text, {BUDGET}::BIGINT AS left_ FROM g WHERE k = 1
              UNION ALL SELECT g.k, g.result_index, g.message_id, g.text, e.left_ - CASE WHEN e.left_ >= length(e.text) AND e.left_ > 0 THEN length(e.text) WHEN e.left_ > {len(MARK)} THEN e.left_ ELSE 0 END
              FROM e JOIN g ON g.k = e.k + 1) SELECT result_index, message_id, content FROM (""",
        1,
    )
)
def expand_text_budget(spark, sf_dir):
    """Whole messages of the first hits, which share a few characters."""
    out = _engine(spark, sf_dir).recall(query=WORD, expand="message", expandResults=3, expandBudgetChars=BUDGET)
    rows = [(e["result_index"], e["message_id"], p["content"]) for e in out["expanded"] for p in e["message"]["parts"]]
    return spark.createDataFrame(rows, "result_index int, message_id string, content string")


@query(
    """SELECT 'e' || event_id AS message_id, CASE WHEN own THEN '[recall output omitted]' END AS content, CASE WHEN NOT own THEN 'event purchase' END AS output FROM (
      SELECT event_id, user_id, false AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase')
    WHERE k <= 2 ORDER BY user_id, event_id LIMIT 3"""
)
def expand_tool_output(spark, sf_dir):
    """Tool parts in an expansion; the next query has the engine's own tools."""
    out = Engine(events(spark, sf_dir), NOW_MS).recall(query="purchase", toolName="purchase", expand="message", expandResults=3)
    rows = [(e["message_id"], p["content"], p["output"]) for e in out["expanded"] for p in e["message"]["parts"]]
    return spark.createDataFrame(rows, "message_id string, content string, output string")


@query(
    """SELECT 'e' || event_id AS message_id, CASE WHEN event_type = 'click' THEN '[recall output omitted]' END AS content,
        CASE WHEN event_type IN ('view', 'purchase') THEN 'event ' || event_type END AS output, CASE WHEN event_type = 'error' THEN 'event failed: error' END AS error FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS spot FROM events) m
    JOIN (SELECT user_id, spot AS mid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS spot FROM events) WHERE event_type = 'purchase' ORDER BY user_id, event_id LIMIT 1) USING (user_id)
    WHERE spot BETWEEN mid - 5 AND mid + 5"""
)
def expand_redaction(spark, sf_dir):
    """Around a hit, output of the engine's own tools (here of clicks) is left out."""
    h = events(spark, sf_dir)
    h.ready = h.rows.withColumn("tool", F.when(F.col("tool") == "click", "mcp__x.recall_get").otherwise(F.col("tool")))
    out = Engine(h, NOW_MS).recall(query="purchase", toolName="purchase", expand="context", expandResults=1, window=5)
    rows = [(p["id"][:-1], p["content"], p["output"], p["error"]) for e in out["expanded"] for m in e["messages"] for p in m["parts"]]
    return spark.createDataFrame(rows, "message_id string, content string, output string, error string")


def _saved(spark, sf_dir, fmt: str):
    """The conversations, written and read again as a history of three tables."""
    path = f"{run_folder(spark)}/history-{fmt}-{uuid.uuid4().hex}"
    save(conversations(spark, sf_dir), path, fmt)
    return load(spark, path, fmt)


@query(literal_sql(f"SELECT {o.RESULT} FROM h", where=f"p.time > {AFTER} AND p.role = 'assistant'", message_where=f"time > {AFTER} AND role = 'assistant'"))
def saved_parquet_scan(spark, sf_dir):
    """A scan of a saved history: parts meet their messages, filters reach the files."""
    h = _saved(spark, sf_dir, "parquet")
    return scan.literal_scan(h, everywhere(h), WORD, role="assistant", after=AFTER).select(*HITS)


@query(f"WITH {o.CONV} SELECT message_id, role, text AS content FROM p WHERE session_id = '{SID}' AND msg_ord BETWEEN 0 AND 2")
def saved_json_context(spark, sf_dir):
    around = browse.context_window(_saved(spark, sf_dir, "jsonl"), SID, MID, before=1, after=1)
    return around.select("message_id", "role", F.col("parts")[0]["content"].alias("content"))
