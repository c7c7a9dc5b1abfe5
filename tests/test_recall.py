"""Searches and browsing on the base fixture."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from histsearch.operators.options import Limits


@pytest.fixture(scope="module")
def engine(spark):
    return fx.base().engine(spark)


def ids(out):
    return [r["message_id"] for r in out["results"]]


def test_literal_global(engine):
    out = engine.recall(query="walkthrough")
    assert {r["session_id"] for r in out["results"]} == {"s-other"} and out["total"] == 3 and out["scanned"] == 3
    assert sum(r["source"] == "title" for r in out["results"]) == 1
    assert [r["why"]["confidence"] for r in out["results"]] == ["high", "high", "medium"]


def test_grouped(engine):
    out = engine.recall(query="rate", scope="project", group="session", results=1)
    assert (out["total"], out["truncated"], out["results"][0]["session_id"], out["results"][0]["hit_count"]) == (2, True, "s-current", 3)


def test_type_and_role(engine):
    out = engine.recall(query="unauthorized", type="tool", role="assistant", scope="project")
    (hit,) = out["results"]
    assert hit["tool_name"] == "bash" and hit["pruned"] and hit["why"]["matched_fields"] == ["stdout"]
    assert ids(engine.recall(query="C++", scope="project")) == ["m-current-1"]


def test_own_tool_is_not_found(engine):
    out = engine.recall(query="unique-self-recall-result")
    assert out["results"] == [] and len(out["near_misses"]) == 3
    assert any("letter by letter" in s["reason"] for s in out["suggestions"])


def test_subtask_only_under_all(engine):
    assert ids(engine.recall(query="database migration")) == ["m-current-5"]
    assert engine.recall(query="database migration", type="text")["results"] == []


def test_time_bounds_are_exclusive(engine):
    at = fx.NOW - 90000
    assert "m-current-1" not in ids(engine.recall(query="rate", after=at))
    assert "m-current-1" in ids(engine.recall(query="rate", after=at - 1, before=at + 1))
    out = engine.recall(query="rate", after=at, before=at)
    assert not out["ok"] and "No time is left" in out["error"]


def test_expansion(engine):
    out = engine.recall(query="unauthorized", scope="project", expand="context", window=1)
    (one,) = out["expanded"]
    assert [m["message"]["message_id"] for m in one["messages"]] == ["m-current-2", "m-current-3", "m-current-4"]
    assert [m["center"] for m in one["messages"]] == [False, True, False] and one["has_more_before"] and one["has_more_after"]
    assert one["messages"][2]["parts"][0]["content"] == "[recall output omitted]" and one["messages"][2]["parts"][0]["output"] is None
    out = engine.recall(query="harborview walkthrough", expand="message")
    assert out["expanded"][0]["message"]["parts"][0]["content"].startswith("Use website")


def test_title_only_hit_is_not_expanded(spark):
    b = fx.Builder()
    b.session("s-1", "Minecraft Server Notes")
    b.message("s-1", "m-1", "user", 5000, fx.text("unrelated body"))
    out = b.engine(spark).recall(query="minecraft", expand="context")
    (hit,) = out["results"]
    assert (hit["part_id"], hit["part_type"], hit["title_match"]) == ("s-1:title", "title", "Minecraft Server Notes")
    assert "expanded" not in out and any("Hits on titles" in w for w in out["warnings"])


def test_smart_tool_filter(engine):
    out = engine.recall(query="permission", match="smart", toolName="bash", scope="project")
    assert out["results"][0]["why"]["matched_fields"] == ["stderr"] and out["match_mode"] == "smart" and out["degrade_kind"] == "none"
    assert not engine.recall(query="x", toolName="bash", type="text")["ok"]


def test_smart_falls_back_to_literal(engine):
    out = engine.recall(query="mmy", match="smart")
    assert out["results"] == [] and out["match_mode"] == "smart"
    out = engine.recall(query="walkth", match="smart", type="text", role="user")
    assert out["degrade_kind"] == "none"
    out = engine.recall(query="alkthrou", match="smart")
    assert (out["match_mode"], out["degrade_kind"]) == ("literal", "fallback") and out["total"] == 3


def test_regex(engine):
    out = engine.recall(query=r"rate.?limit\b", match="regex")
    assert out["match_mode"] == "regex" and set(ids(out)) == {"m-current-1", "m-project-1"}
    assert not engine.recall(query="(", match="regex")["ok"]
    assert engine.recall(query=r"a\d+", match="literal")["suggestions"][0]["example"] == {"match": "regex"}


def test_directories(spark):
    b = fx.base()
    b.session("s-archive", "Archive", "/workspace/project-archive", 3000)
    b.session("s-nested", "Nested", "/workspace/project/nested", 4000)
    for sid in ("s-archive", "s-nested"):
        b.message(sid, f"m-{sid}", "user", 9000, fx.text("checkout walkthrough"))
    e = b.engine(spark)
    out = e.recall(query="checkout", directory="/workspace\\project/", results=50)
    assert {r["session_id"] for r in out["results"]} == {"s-current", "s-project-2", "s-nested"}
    assert out["coverage"]["skipped_by_reason"] == {"directory": 2} and out["coverage"]["directory_buckets_searched"] == ["exact"]
    out = e.recall(query="checkout", directory="/workspace/project", sessions=1)
    assert out["coverage"]["skipped_by_reason"] == {"directory": 2, "sessionsLimit": 2} and out["scanned"] == 1
    out = e.recall(query="walkthrough", directory="/workspace/project/nested", fallback=True, results=50)
    assert [r["directory_relevance"] for r in out["results"]] == sorted((r["directory_relevance"] for r in out["results"]), key=["exact", "project", "global"].index)
    assert any("outside the directory" in w for w in out["warnings"])


def test_coverage_and_load_errors(spark):
    b = fx.base()
    b.session("s-broken", "Broken")
    out = b.engine(spark).recall(query="checkout", role="assistant", type="tool")
    assert out["load_error_count"] == 1 and out["load_errors"][0].startswith("s-broken") and "loadError" in out["coverage"]["limited_by"]
    assert (out["coverage"]["messages_searched"], out["coverage"]["parts_searched"]) == (8, 5)


def test_diversity(spark):
    b = fx.Builder()
    for s in range(3):
        b.session(f"s-{s}", f"S{s}", ago=1000 + s)
        for k in range(6):
            b.message(f"s-{s}", f"m-{s}-{k}", "user", 9000 - k, fx.text("needle here"))
    out = b.engine(spark).recall(query="needle", results=6)
    assert [r["session_id"] for r in out["results"]] == ["s-0", "s-0", "s-1", "s-1", "s-2", "s-2"] and out["total"] == 18
    out = b.engine(spark).recall(query="needle", results=8)
    assert [r["message_id"] for r in out["results"]][6:] == ["m-0-2", "m-0-3"]


def test_shared_text_budget(spark):
    b = fx.Builder()
    b.session("s-1", "Long")
    b.message("s-1", "m-1", "assistant", 5000, fx.tool(output="large-expand-token " + "x" * 50_000), *[fx.tool(output="y" * 5000) for _ in range(9)])
    out = b.engine(spark).recall(query="large-expand-token", expand="message")
    parts = out["expanded"][0]["message"]["parts"]
    assert parts[0]["output"].endswith("[truncated by recall expansion]") and len(parts[0]["output"]) == 4000
    assert sum(len(p["output"] or "") for p in parts) <= 30_000 and parts[-1]["output"] is None
    assert any("expanded texts share" in w for w in out["warnings"])


def test_defence_and_clamps(engine):
    out = engine.recall(query="rate", match="nope", results=1000, width=5, type=7)
    assert any('match "nope" is unknown' in w for w in out["warnings"]) and any("results 1000 is out of bounds; 50" in w for w in out["warnings"])
    assert not fx.Engine(engine.history, fx.NOW, global_allowed=False).recall(query="x")["ok"]
    assert Limits.of(max_results=0, default_width=3).max_results == 1 and Limits.of(default_width=3).default_width == 50


def test_browse(engine):
    page = engine.messages("s-current", limit=2)
    assert [m["message"]["message_id"] for m in page["messages"]] == ["m-current-1", "m-current-2"]
    assert page["pagination"] == {"offset": 0, "returned": 2, "total": 6, "has_more": True} and page["context"]["session_title"] == "Current Debugging Session"
    assert [m["message"]["message_id"] for m in engine.messages("s-current", offset=1, limit=1, reverse=True)["messages"]] == ["m-current-5"]
    assert engine.messages("s-current", query="MIGRATE")["pagination"]["total"] == 1
    assert not engine.messages("s-none")["ok"]
    around = engine.context("s-current", "m-current-3", before=0, after=1)
    assert [m["message"]["message_id"] for m in around["messages"]] == ["m-current-3", "m-current-4"] and around["has_more_before"] and around["has_more_after"]
    assert around["messages"][1]["parts"][0]["output"].startswith("unique-self")
    assert not engine.context("s-current", "m-none")["ok"] and not engine.get("s-current", "m-none")["ok"]
    got = engine.get("s-current", "m-current-3")
    assert got["parts"][0]["pruned"] and got["parts"][0]["title"] == "Run test suite"
    listed = engine.sessions()
    assert [s["session_id"] for s in listed["sessions"]] == ["s-current", "s-project-2"] and listed["sessions"][1]["archived"]
    assert engine.sessions("global", "harborview")["sessions"][0]["project"]["worktree"] == fx.OTHER


def test_storage_round_trip(spark, tmp_path):
    from histsearch.sources.model import load, save, with_orders

    history = fx.base().history(spark)
    for fmt in ("parquet", "json"):
        save(history, str(tmp_path / fmt), fmt)
        again = load(spark, str(tmp_path / fmt), fmt)
        for name in ("sessions", "messages", "parts"):
            assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(history, name).collect()))
    ordered = with_orders(history)
    assert [r[0] for r in ordered.messages.where("session_id = 's-current'").orderBy("msg_ord").select("message_id").collect()][:2] == ["m-current-1", "m-current-2"]
    assert ordered.sessions.orderBy("session_ord").select("session_id").first()[0] == "s-other"


def test_cap_of_candidates(spark):
    from histsearch.operators.rank import candidates

    b = fx.Builder()
    b.session("s-1", "Budget")
    for k in range(501):
        b.message("s-1", f"m-{k:03}", "user", 100_000 - k, fx.text("budget token"))
    history = b.history(spark)
    targets = history.sessions.withColumn("directory_relevance", F.lit("unknown"))
    kept = candidates(history, targets, budget=True).where("not is_title")
    assert kept.count() == 500 and kept.where("message_id = 'm-000'").isEmpty()


def test_empty_history(spark):
    out = fx.Builder().engine(spark).recall(query="x", match="smart")
    assert out["ok"] and out["results"] == [] and out["total"] == 0
