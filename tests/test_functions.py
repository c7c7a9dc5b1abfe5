"""Text functions, extraction, options."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from histsearch.functions import extract
from histsearch.functions.text import normalize, normalize_path, parse_query, smart_snippet, snippet, split_camel, tokenize, tokenize_all
from histsearch.operators import options as op
from histsearch.operators.auto import relative_date
from histsearch.operators.expand import shared_window
from histsearch.operators.scan import check_pattern, looks_like_regex
from histsearch.sources.model import PARTS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert value(spark, split_camel(F.lit("rateLimit getHTTPResponse XMLParser"))) == "rate Limit get HTTPResponse XMLParser"
    assert value(spark, tokenize_all(F.lit("foo-bar_baz/qux.ts fooBar  Foo?"))) == ["foo", "bar", "baz", "qux", "ts", "foo", "bar", "foo?"]
    assert value(spark, tokenize(F.lit("a b A"))) == ["a", "b"] and value(spark, tokenize_all(F.lit(None).cast("string"))) == []
    assert value(spark, normalize(F.lit("  Foo-barBaz\n x "))) == "foo bar baz x"
    assert value(spark, normalize_path(F.lit("\\a\\\\b//c/"))) == "/a/b/c"


@pytest.mark.parametrize("text,query,width,shown", [("needle at start of text", "needle", 12, "needle at st..."), ("long text with needle", "needle", 12, "... with needle"), ("abcdef", "zz", 3, "abc...")])
def test_snippet(spark, text, query, width, shown):
    assert value(spark, snippet(F.lit(text), query, width)) == shown


def test_smart_snippet():
    text = "alpha " * 60 + "token bucket limiter" + " omega" * 60
    assert "token bucket" in smart_snippet(text, parse_query("token bucket"), 60)
    assert smart_snippet(text, parse_query("zzz"), 20) == text[:20] + "..." and smart_snippet("", parse_query("a"), 20) == ""


def fields(spark, part):
    row = fx.table(spark, PARTS, [part])
    return [(f["field"], f["text"]) for f in row.select(extract.searchable_fields().alias("f")).first()["f"]]


def test_fields(spark):
    assert fields(spark, fx.text("hi")) == [("text", "hi")] and fields(spark, fx.text("")) == [] and fields(spark, fx.text(None)) == []
    assert fields(spark, fx.tool(given={"command": "npm test"}, output="out", title="T")) == [("stdout", "out"), ("toolName", "T"), ("command", "npm test"), ("command", '{"command":"npm test"}')]
    assert fields(spark, fx.tool(status="error", given={"cwd": "/x", "command": 5}, error="bad")) == [("stderr", "bad"), ("cwd", "/x"), ("command", '{"cwd":"/x","command":5}')]
    assert fields(spark, fx.tool(status="pending", given={"long": "x" * 10_100}))[0][1].startswith('{"long":"xx') and len(fields(spark, fx.tool(status="pending", given={"long": "x" * 10_100}))[0][1]) == 10_000
    assert fields(spark, fx.tool("mcp__x__recall_get", output="o")) == [] and fields(spark, fx.tool("myrecall", output="o")) != []
    assert fields(spark, {"part_type": "subtask", "description": "d", "prompt": ""}) == [("text", "d"), ("text", "")]
    assert fields(spark, {"part_type": "file"}) == []
    joined = fx.table(spark, PARTS, [fx.tool(given={}, output="tool text")]).select(extract.raw_text(extract.searchable_fields()).alias("r")).first()["r"]
    assert joined == "tool text\n\nbash\n\n{}"


def test_durations_and_dates():
    assert [op.duration_ms(x) for x in ("7d", "2w ago", "3H", "30m", "d")] == [604_800_000, 1_209_600_000, 10_800_000, None, None]
    assert op.date_ms("2025-01-01") == 1_735_689_600_000 and op.date_ms("nope") is None
    for spoken in ("Jan 1 2025", "2025/01/01", "January 1, 2025", "Wed, 01 Jan 2025 00:00:00 GMT", "1 Jan 2025 02:00 GMT+0200", "1/1/2025", "2025", "2025-01"):
        assert op.date_ms(spoken) == 1_735_689_600_000
    warnings = []
    assert op.time_window({"last": "7d", "after": fx.NOW - 3_600_000}, fx.NOW, warnings) == (fx.NOW - 3_600_000, None)
    assert warnings == ["after is the lower bound of time; wider ones were dropped: last."]
    for args, word in (({"after": "7d"}, 'after "7d" was left out'), ({"last": "30m"}, 'last "30m" was left out'), ({"last": "0d"}, "leaves no time"), ({"until": "0d"}, "means now"), ({"before": "3w"}, 'before "3w" was left out')):
        warnings = []
        op.time_window(args, fx.NOW, warnings)
        assert word in warnings[0]
    with pytest.raises(op.ArgumentError):
        op.time_window({"from": "now", "to": "now"}, fx.NOW, [])


def test_coercion():
    assert op.coerce_int("7", 3, 1, 9) == 3 and op.coerce_int(99.7, 3, 1, 9) == 9 and op.coerce_int(float("nan"), 3, 1, 9) == 3
    assert op.coerce_enum(5, ("a",), "a") == "a" and op.coerce_bool("x", True) is True and op.optional_string("  ") is None
    o = op.search_options({"query": "q", "window": "auto", "expandResults": 3, "expandBudgetMessages": 30}, op.Limits(), fx.NOW)
    assert (o.window, o.expand_results) == (4, 3)
    o = op.search_options({"query": "q", "expandResults": 9, "window": 99}, op.Limits(), fx.NOW)
    assert (o.expand_results, o.window) == (3, 10) and len(o.warnings) == 2


@pytest.mark.parametrize("query", [r"\d+", "[a-z]+", "(limit)?x", "a+b", "x{3}", "a|b", "^foo", "foo$"])
def test_patterns_are_seen(query):
    assert looks_like_regex(query)


@pytest.mark.parametrize("query", ["rate limit (middleware)", "src/foo.ts", "is it safe?", "C++", "5+3", "costs $5", "[unclosed"])
def test_prose_is_no_pattern(query):
    assert not looks_like_regex(query)


def test_pattern_errors(spark):
    for bad in ("", "(", "x" * 1001):
        with pytest.raises(op.ArgumentError):
            check_pattern(spark, bad)


def test_windows_under_a_budget():
    assert shared_window(5, 10, 2, 30) == (3, 8, False)
    assert shared_window(5, 10, 2, 3) == (4, 7, True)
    assert shared_window(0, 10, 3, 2) == (0, 2, True)
    assert shared_window(9, 10, 3, 1) == (9, 10, True)


def test_relative_dates():
    day = 86_400_000
    assert [relative_date(fx.NOW - n * day, fx.NOW) for n in (0, 1, 5, 31, 90)] == ["today", "1 day ago", "5 days ago", "1 month ago", "3 months ago"] and relative_date(0, fx.NOW) == "unknown"
