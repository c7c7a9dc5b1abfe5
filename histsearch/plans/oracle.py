"""DuckDB SQL that states the same results as the registered queries, for checking them."""

from __future__ import annotations

from ..operators import auto
from ..operators import rank as R
from ..sources.model import BASE_MS, NOW_MS

#: The conversations as sessions (s) and part rows (p).
CONV = f"""
p AS (
  SELECT 'c' || conv_id AS session_id, conv_id AS session_ord, 'c' || conv_id || '-' || turn AS message_id, 'c' || conv_id || '-' || turn || 'p' AS part_id, turn AS msg_ord, role,
         {BASE_MS} + conv_id * 3600000 + turn * 60000 AS time, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'reasoning' ELSE 'text' END AS part_type, text
  FROM conversations),
s AS (
  SELECT 'c' || a.conv_id AS session_id, a.conv_id AS session_ord, 'p' || (a.conv_id % 3) AS project_id, '/workspace/p' || (a.conv_id % 5) AS directory,
         coalesce(substr(h.text, 1, 40), '') AS title, {BASE_MS} + a.conv_id * 3600000 AS time_created, {BASE_MS} + a.conv_id * 3600000 + a.n * 60000 AS time_updated, a.conv_id % 7 = 0 AS archived
  FROM (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id) a LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) h ON a.conv_id = h.conv_id)"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains(text: str, query: str) -> str:
    return f"instr(lower({text}), {q(query.lower())}) > 0"


def window(text: str, at: str, width: int) -> str:
    """The text around the 1-based place *at* (0: the head)."""
    n = f"length({text})"
    first = f"greatest(0, {at} - 1 - {width // 2})"
    end = f"least({n}, {first} + {width})"
    start = f"(CASE WHEN {end} - {first} < {width} AND {first} > 0 THEN greatest(0, {end} - {width}) ELSE {first} END)"
    around = f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END) || substr({text}, ({start} + 1)::BIGINT, ({end} - {start})::BIGINT) || (CASE WHEN {end} < {n} THEN '...' ELSE '' END)"
    return f"CASE WHEN {at} > 0 THEN {around} ELSE substr({text}, 1, {width}) || (CASE WHEN {n} > {width} THEN '...' ELSE '' END) END"


def snippet(text: str, query: str, width: int = 200) -> str:
    return window(text, f"instr(lower({text}), {q(query.lower())})", width)


def conv_hits(hit, show, where: str = "true", sessions: str = "true", titles: bool = True, message_where: str = "true") -> str:
    """CTE h: literal or pattern hits in parts and titles."""
    out = f"""
h AS (
  SELECT p.session_id, s.session_ord, p.message_id, p.role, p.time, p.part_id, p.part_type, {show('p.text')} AS snippet, p.msg_ord, false AS is_title, s.title, s.directory
  FROM p JOIN s USING (session_id) WHERE p.text <> '' AND {hit('p.text')} AND ({where}) AND ({sessions})"""
    if titles:
        out += f"""
  UNION ALL
  SELECT s.session_id, s.session_ord, m.message_id, m.role, m.time, s.session_id || ':title', 'title', {show('s.title')}, m.msg_ord, true, s.title, s.directory
  FROM s JOIN (SELECT session_id, unnest(max_by({{'message_id': message_id, 'role': role, 'time': time, 'msg_ord': msg_ord}}, msg_ord)) FROM p WHERE {message_where} GROUP BY session_id) m USING (session_id)
  WHERE {hit('s.title')} AND ({sessions})"""
    return out + ")"


ORDER = "session_ord, session_id, is_title, msg_ord"
RESULT = "session_id, message_id, role, time, part_id, part_type, snippet"


def tokens(text: str) -> str:
    spaced = f"regexp_replace(regexp_replace({text}, '[_\\-/.]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({spaced}), '\\s+'), lambda t: t <> '')"


def weight(term: str, token: str, mode: str) -> str:
    cases = f"WHEN {term} = {q(token)} THEN 1.0::DOUBLE"
    if len(token) >= R.PREFIX_FROM:
        cases += f" WHEN starts_with({term}, {q(token)}) THEN {float(len(token))}::DOUBLE / length({term})"
    edits = R.max_edits(token, mode)
    if edits:
        # DuckDB counts bytes: one ASCII mark stands for each other character.
        plain = f"regexp_replace({term}, '[^\\x00-\\x7F]', '#', 'g')"
        cases += f" WHEN abs(length({term}) - {len(token)}) <= {edits} AND levenshtein({plain}, {q(token)}) <= {edits} THEN 1.0::DOUBLE - levenshtein({plain}, {q(token)})::DOUBLE / greatest(length({term}), {len(token)})"
    return f"CASE {cases} END"


def ranked(query, mode: str, where: str = "true", sessions: str = "true", titles: bool = True) -> str:
    """CTEs that end in r: ranked hits with score, matched_terms and raw."""
    any_weight = " OR ".join(f"({weight('t', k, mode)}) IS NOT NULL" for k in query.tokens)
    total = " + ".join(f"coalesce({weight('term', k, mode)}, 0)" for k in query.tokens)
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, b in R.FIELD_BOOST.items()) + " END"
    fields = list(R.FIELD_BOOST)
    lens = ", ".join(f"avg(len(t_{f})) AS {f}" for f in fields)
    flat = " UNION ALL ".join(f"SELECT part_id, '{f}' AS field, len(t_{f}) AS ln, unnest(list_filter(t_{f}, lambda t: {any_weight})) AS term FROM ix" for f in fields)
    mean = "CASE field " + " ".join(f"WHEN '{f}' THEN st.{f}" for f in fields) + " END"
    terms = ", ".join(f"CASE WHEN len(list_filter(pool, lambda t: ({weight('t', k, mode)}) IS NOT NULL)) > 0 THEN {q(k)} END" for k in query.tokens)
    n = len(query.tokens)
    phrase = " OR ".join(f"instr(lower(raw), {q(x)}) > 0" for x in query.phrases) or "false"
    title_part = ""
    if titles:
        title_part = f"""
  UNION ALL
  SELECT s.session_id, s.session_ord, m.message_id, m.role, m.time, s.session_id || ':title', 'title', trim(s.title), m.msg_ord, true, s.title, s.directory
  FROM s JOIN (SELECT session_id, unnest(max_by({{'message_id': message_id, 'role': role, 'time': time, 'msg_ord': msg_ord}}, msg_ord)) FROM p WHERE {where} GROUP BY session_id) m USING (session_id)
  WHERE trim(s.title) <> '' AND ({sessions})"""
    return f"""
c AS (
  SELECT p.session_id, s.session_ord, p.message_id, p.role, p.time, p.part_id, p.part_type, substr(p.text, 1, 20000) AS raw, p.msg_ord, false AS is_title, s.title, s.directory
  FROM p JOIN s USING (session_id) WHERE p.text <> '' AND ({where}) AND ({sessions}){title_part}),
ix AS (SELECT *, CASE WHEN is_title THEN [] ELSE {tokens('raw')} END AS t_primary, {tokens('directory')} AS t_secondary, {tokens('title')} AS t_title, []::VARCHAR[] AS t_hint FROM c),
st AS (SELECT count(*) AS n, {lens} FROM ix),
fl AS ({flat}),
tf AS (SELECT part_id, field, ln, term, count(*) AS tf FROM fl GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (
  SELECT part_id, round(sum({boost} * ({total}) * ln((st.n + 1)::DOUBLE / df.df) * ({R.DELTA} + ({R.K1} + 1) * tf.tf / ({R.K1}::DOUBLE * ({1 - R.B}::DOUBLE + {R.B}::DOUBLE * ln / ({mean})) + tf.tf))), {R.DIGITS}) AS raw_score
  FROM tf JOIN df USING (field, term), st GROUP BY part_id),
jn AS (
  SELECT ix.*, round(least(1.0, greatest(0.0, raw_score / (SELECT max(raw_score) FROM sc))), {R.DIGITS}) AS base,
         list_distinct(list_concat(CASE WHEN is_title THEN {tokens('raw')} ELSE t_primary END, t_secondary, t_title)) AS pool
  FROM ix JOIN sc USING (part_id)),
mt AS (SELECT *, list_filter([{terms}], lambda t: t IS NOT NULL) AS matched_terms FROM jn),
fs AS (
  SELECT *, round(least(1.0, greatest(0.0, base
    * (CASE WHEN {phrase} THEN {R.PHRASE}::DOUBLE ELSE 1.0 END) * (CASE WHEN len(matched_terms) = {n} THEN {R.ALL_TOKENS}::DOUBLE ELSE 1.0 END)
    * (CASE WHEN part_type = 'reasoning' THEN {R.REASONING}::DOUBLE ELSE 1.0 END) * (CASE WHEN role = 'user' THEN {R.USER}::DOUBLE ELSE 1.0 END)
    * (1.0::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - ({NOW_MS} - time) / {float(R.RECENT_MS)}::DOUBLE) * {R.RECENT - 1}::DOUBLE)
    * (CASE WHEN {n} = 1 AND len(matched_terms) = 1 AND base < {R.WEAK_BELOW} THEN {R.WEAK}::DOUBLE ELSE 1.0 END)
    * (CASE WHEN {n} > 1 AND len(matched_terms) < {n / 2} THEN {R.POOR}::DOUBLE ELSE 1.0 END))), {R.DIGITS}) AS score
  FROM mt),
r AS (SELECT * FROM fs WHERE score >= {R.FLOOR} OR (SELECT count(*) FROM fs) <= 1)"""


RANK_ORDER = "score DESC, time DESC, part_id"


def ranked_fields(query) -> str:
    """Names of the fields in which a ranked hit of the conversations was found (they have one each)."""
    some = " OR ".join(f"list_contains(matched_terms, {q(k)}) AND len(list_filter(own, lambda t: ({weight('t', k, 'smart')}) IS NOT NULL)) > 0" for k in query.tokens)
    phrase = "".join(f" OR instr(lower(raw), {q(x)}) > 0" for x in query.phrases)
    some = some.replace("list_filter(own,", f"list_filter({tokens('raw')},")
    return f"CASE WHEN {some}{phrase} THEN CASE WHEN is_title THEN 'title' WHEN part_type = 'reasoning' THEN 'reasoning' ELSE 'text' END ELSE '' END"


def smart_snippet(text: str, query, width: int) -> str:
    """The window with most distinct needles (then the least spread, then the first), around its middle."""
    needles = list(dict.fromkeys((*query.tokens, *query.phrases)))
    listed = ", ".join(q(k) for k in needles)
    n = f"length({text})"
    at = f"list_filter(range(1, {n} + 1), lambda i: len(list_filter([{listed}], lambda w: substr(lower({text}), i, length(w)) = w)) > 0)"
    held = f"list_filter([{listed}], lambda w: len(list_filter(ps, lambda x: x >= i AND x <= i + {width} AND substr(lower({text}), x, length(w)) = w)) > 0)"
    last = f"list_max(list_filter(ps, lambda x: x >= i AND x <= i + {width}))"
    best = f"(SELECT {{'a': i, 'b': b}} FROM (SELECT i, {last} AS b, len({held}) AS c FROM (SELECT ps, unnest(ps) AS i FROM (SELECT {at} AS ps))) ORDER BY c DESC, b - i, i LIMIT 1)"
    start = f"greatest(0, least((w.a - 1 + w.b - 1) // 2 - {width // 2}, {n} - {width}))"
    shown = f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END) || substr({text}, ({start} + 1)::BIGINT, {width}) || (CASE WHEN {start} + {width} < {n} THEN '...' ELSE '' END)"
    return f"CASE WHEN {n} <= {width} THEN {text} ELSE (SELECT CASE WHEN w IS NULL THEN substr({text}, 1, {width}) || '...' ELSE {shown} END FROM (SELECT {best} AS w)) END"


def cue_gate(table: str) -> str:
    """(k, query) of the texts in *table* (k, text) that ask for history."""
    blank = "' ' || chr(9) || chr(10) || chr(13)"
    strip = f"trim(text, {blank})"
    for cue in auto.CUES:
        strip = f"regexp_replace({strip}, {q('(?is)^(.*?)' + cue)}, '\\1 ')"
    cleaned = f"trim(regexp_replace(regexp_replace(regexp_replace({strip}, '[\"''`]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s_.-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    asks = q("(?i)(?:" + "|".join(auto.CUES) + ")")
    explicit = "'(?i)\\brecall(?:_\\w+)?\\s*\\('"
    return f"""SELECT k, trim(substr(c, 1, {auto.QUERY_CHARS})) AS query FROM (
  SELECT k, {cleaned} AS c FROM {table}
  WHERE length(trim(text, {blank})) >= {auto.MIN_CHARS} AND NOT starts_with(trim(text, {blank}), '/') AND NOT regexp_matches(text, {explicit}) AND regexp_matches(text, {asks}))
WHERE regexp_matches(c, '[\\p{{L}}\\p{{N}}]{{3,}}')"""
