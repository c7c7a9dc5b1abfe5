"""Quality rules judged by host (native).

Rules are checked on every whole text, each at two levels: clear failures and mild ones
(which include the clear). Both are summed by host, here the document's source, and each host's
rates of failure are shrunk towards beta priors that are fitted to all hosts by moments. A
host whose shrunk rate of clear failures of a rule reaches BLOCKED loses all its documents. A
clear failure counts against its document whatever its host is like; a mild one counts
only at hosts that are suspect: whose shrunk rate of mild failures is SUSPECT times
that of all documents. So a host's record tightens the rules and never excuses a failure. The
verdicts are joined back to the documents' numbers, which were written once, so that texts are read
once and never shuffled.

Defined results: null and empty texts have no words and fail the word count; a null
host is a host of its own; ties and rows that repeat count each; very long texts are
read whole; an empty table gives no rows; columns other than doc_id, text and the host
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_by_key, let, materialize, read_table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BLOCKED = 0.5
SUSPECT = 1.5
#: Fewer lines that equal an earlier one are no failure of that rule, in texts of any length; 1 counts every one.
DUP_LINES_FROM = 3
#: The prior weighs as much as this many documents, at least and at most.
PRIOR_WEIGHT = (2.0, 1000.0)
WINDOW = 3


def repeated_words(w: Column) -> Column:
    """Words of the array *w* in windows of three that occur twice or more."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    # Words hold no blank, so a window's blanks keep it apart from its place, and
    # sorting brings equal windows together in the order of their places.
    keyed = F.array_sort(F.transform(starts, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.lpad(i.cast("string"), 9, "0"))))

    def window(x: Column) -> Column:
        return F.substring(x, F.lit(1), F.length(x) - 10)

    def places(s: Column) -> Column:
        cut = F.transform(s, window)
        return let(
            cut,
            lambda c: F.array_sort(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: (F.get(c, k) == F.get(c, k - 1)) | (F.get(c, k) == F.get(c, k + 1))),
                    lambda k: F.right(F.get(s, k), F.lit(9)).cast("int"),
                )
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    exact = let(let(keyed, places), covered)
    # Windows with distinct hashes are distinct; only other texts are sorted.
    return F.when(n < WINDOW, 0).when(F.size(F.array_distinct(hashes)) == n - WINDOW + 1, 0).otherwise(exact)


def text_numbers(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and what the rules need to know of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    bare = F.regexp_replace(text, SPACES, "")
    return docs.select(
        F.col("doc_id"),
        F.col(host).alias("host"),
        counted.alias("c"),
        lined.alias("l"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "host", "c.*", "l.*", "word_chars", "n_symbols")


def rules(dup_lines_from: int = DUP_LINES_FROM) -> dict[str, tuple[Column, Column]]:
    """(clear, mild) failure of each rule."""
    n, symbols, chars, dup, lines = (F.col(c) for c in ("n_words", "n_symbols", "word_chars", "n_dup_lines", "n_lines"))
    few, repeats = n < MIN_WORDS, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n
    again = dup >= dup_lines_from
    return {
        "few_words": (few, few),
        "repeats": (repeats, repeats),
        "symbols": (10 * symbols > n, 50 * symbols > n),
        "word_length": ((chars < 2 * n) | (chars > 15 * n), (chars < 3 * n) | (chars > 12 * n)),
        "dup_lines": (again & (2 * dup > lines), again & (10 * dup > 3 * lines)),
    }


def beta_prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior by the moments of the hosts' rates; one row
    of sums reaches the driver."""
    sums = [F.sum("n").alias("n")]
    sums += [F.sum(name).alias(name) for name in names]
    total = hosts.agg(*sums).first()
    if not total["n"]:
        return {name: (1.0, 1.0) for name in names}
    mean = {name: total[name] / total["n"] for name in names}
    spread = hosts.agg(*[(F.sum(F.col("n") * (F.col(name) / F.col("n") - F.lit(mean[name])) * (F.col(name) / F.col("n") - F.lit(mean[name]))) / F.sum("n")).alias(name) for name in names]).first()
    out = {}
    for name in names:
        m, v = mean[name], spread[name]
        weight = m * (1 - m) / v - 1 if v > 0 else PRIOR_WEIGHT[1]
        weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        out[name] = (m * weight, (1 - m) * weight)
    return out


def host_verdicts(numbers: DataFrame, dup_lines_from: int = DUP_LINES_FROM) -> DataFrame:
    """(host, n, blocked, suspect, rates): verdicts and shrunk failure rates by rule."""
    checks = rules(dup_lines_from)
    sums = {f"{kind}_{r}": check.cast("long") for r, both in checks.items() for kind, check in zip(("clear", "mild"), both)}
    hosts = materialize(numbers.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]), "hosts")
    prior = beta_prior(hosts, list(sums))
    shrunk = {name: (F.col(name) + a) / (F.col("n") + (a + b)) for name, (a, b) in prior.items()}
    mean = {name: a / (a + b) for name, (a, b) in prior.items()}
    return hosts.select(
        "host",
        "n",
        F.greatest(*[shrunk[f"clear_{r}"] for r in checks]).__ge__(BLOCKED).alias("blocked"),
        F.struct(*[(shrunk[f"mild_{r}"] > SUSPECT * mean[f"mild_{r}"]).alias(r) for r in checks]).alias("suspect"),
        F.struct(*[rate.alias(name) for name, rate in shrunk.items()]).alias("rates"),
    )


def judge(docs: DataFrame, host: str = "source", dup_lines_from: int = DUP_LINES_FROM) -> DataFrame:
    """Every document with its numbers, base_failed, host_blocked and kept."""
    numbers = materialize(text_numbers(docs, host), "host-numbers")
    verdicts = materialize(host_verdicts(numbers, dup_lines_from).select("host", "n", "blocked", "suspect"), "host-verdicts")
    checks = rules(dup_lines_from)
    base = checks["few_words"][0] | checks["repeats"][0]
    bad = F.col("blocked")
    for r, (clear, mild) in checks.items():
        bad = bad | clear | (mild & F.col("suspect")[r])
    return join_by_key(numbers, verdicts, "host", "n").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~bad).alias("kept"),
        F.col("blocked").alias("host_blocked"),
    )


def op1_host_rules(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, sum(least(3, coalesce(nxt - i, 3))) AS n FROM rep GROUP BY k),
m AS (
  SELECT d.k, doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_own,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON d.k = cov.k),
r AS (
  SELECT *, n_lines - n_own AS n_dup_lines, n_words < {MIN_WORDS} AS few_words, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeats
  FROM m),
l AS (
  SELECT k, host, 'few_words' AS rule, few_words::INT AS clear, few_words::INT AS mild FROM r
  UNION ALL SELECT k, host, 'repeats', repeats::INT, repeats::INT FROM r
  UNION ALL SELECT k, host, 'symbols', (10 * n_symbols > n_words)::INT, (50 * n_symbols > n_words)::INT FROM r
  UNION ALL SELECT k, host, 'word_length', (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT, (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT FROM r
  UNION ALL SELECT k, host, 'dup_lines', (n_dup_lines >= {DUP_LINES_FROM} AND 2 * n_dup_lines > n_lines)::INT, (n_dup_lines >= {DUP_LINES_FROM} AND 10 * n_dup_lines > 3 * n_lines)::INT FROM r),
h AS (SELECT host, rule, kind, count(*) AS n, sum(fail) AS f FROM (
        SELECT host, rule, 'clear' AS kind, clear AS fail FROM l UNION ALL SELECT host, rule, 'mild', mild FROM l) GROUP BY host, rule, kind),
g AS (SELECT rule, kind, sum(f) / sum(n) AS mu FROM h GROUP BY rule, kind),
v AS (SELECT rule, kind, mu, sum(n * (f / n - mu) * (f / n - mu)) / sum(n) AS va FROM h JOIN g USING (rule, kind) GROUP BY rule, kind, mu),
p AS (SELECT rule, kind, mu, least(greatest(CASE WHEN va > 0 THEN mu * (1 - mu) / va - 1 ELSE {PRIOR_WEIGHT[1]} END, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) AS wt FROM v),
s AS (SELECT host, rule, max(CASE WHEN kind = 'clear' THEN (f + mu * wt) / (n + wt) END) AS clear_rate,
             bool_or(kind = 'mild' AND (f + mu * wt) / (n + wt) > {SUSPECT} * mu) AS suspect FROM h JOIN p USING (rule, kind) GROUP BY host, rule),
b AS (SELECT l.k, max(clear_rate) >= {BLOCKED} AS blocked, bool_or(clear = 1 OR mild = 1 AND suspect) AS bad
      FROM l JOIN s ON l.host IS NOT DISTINCT FROM s.host AND l.rule = s.rule GROUP BY l.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few_words OR repeats AS base_failed, NOT (few_words OR repeats) AND NOT blocked AND NOT bad AS kept,
       blocked AS host_blocked
FROM r JOIN b ON r.k = b.k
"""
