"""Ranking behaviour: the labelled cases, and invariants of scores."""

import fixtures as fx
import pytest

from histsearch.functions.text import parse_query
from histsearch.operators import auto
from histsearch.operators.diagnose import relevance_metrics


def test_labelled_cases(spark):
    engine = fx.corpus().engine(spark)
    ranked = []
    for k, (query, mode, _) in enumerate(fx.CASES):
        out = engine.recall(query=query, match=mode, group="session")
        assert all(0 <= r["score"] <= 1 for r in out["results"])
        ranked += [(k, r["session_id"], i) for i, r in enumerate(out["results"], 1)]
    metrics = relevance_metrics(
        spark.createDataFrame(ranked, "case_id int, session_id string, rank int"), spark.createDataFrame([(k, c[2]) for k, c in enumerate(fx.CASES)], "case_id int, relevant string")
    ).first()
    assert (metrics["mrr"], metrics["recall_at_5"], metrics["cases"]) == (1.0, 1.0, 8)


@pytest.fixture(scope="module")
def few(spark):
    b = fx.Builder()
    b.session("s-1", "Notes")
    words = ["common filler words", "common zebra words", "common filler text", "authentication service"]
    for k, w in enumerate(words):
        b.message("s-1", f"m-{k}", "user", 9000 - k * 1000, fx.text(w))
    return b.engine(spark)


def test_rare_terms_win(few):
    assert few.recall(query="common zebra", match="smart")["results"][0]["message_id"] == "m-1"


def test_typos_and_prefixes(few):
    assert few.recall(query="authentcation", match="fuzzy")["results"][0]["message_id"] == "m-3"
    out = few.recall(query="authen", match="smart", explain=True)
    assert out["results"][0]["matched_terms"] == ["authen"] and out["results"][0]["match_reasons"][0].startswith("BM25 relative score")


def test_ties_newest_first(few):
    assert [r["message_id"] for r in few.recall(query="filler", match="smart")["results"]] == ["m-2", "m-0"]


def test_no_match_and_no_substrings(few):
    out = few.recall(query="qqqqqqq", match="smart")
    assert out["results"] == []
    assert few.recall(query="thentic", match="smart")["degrade_kind"] == "fallback"


def test_hooks(spark):
    engine = fx.corpus().engine(spark)
    block = auto.auto_recall(engine, "What did we decide about Postgres and DynamoDB last time?")
    assert block.startswith("<recall-auto>") and "Postgres migration decision" in block and len(block) <= auto.BLOCK_CHARS
    assert auto.auto_recall(engine, "Please add a button to the page") is None
    kept = auto.durable_findings(engine, "e-db")
    assert kept.startswith("Durable findings") and "chose Postgres" in kept and len(kept) <= auto.KEEP_CHARS


def test_stream_gate(spark, tmp_path):
    from histsearch.streaming.cues import gate

    rows = [("user", "what did we decide about sharding last time?"), ("assistant", "as before, sharding by key"), ("user", "tidy up before lunch")]
    spark.createDataFrame(rows, "role string, text string").write.parquet(str(tmp_path / "in"))
    stream = gate(spark.readStream.schema("role string, text string").parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("gated").trigger(availableNow=True).start()
    job.awaitTermination(60)
    (row,) = spark.table("gated").collect()
    assert "sharding" in row["query"] and "last time" not in row["query"]


def test_query_parser():
    q = parse_query('"Token Bucket" rateLimit src/foo.ts')
    assert q.phrases == ("token bucket",) and q.tokens == ("token", "bucket", "rate", "limit", "src", "foo", "ts")
