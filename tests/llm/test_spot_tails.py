"""SpotSigs see the whole text where anchors are missing, and anchors of every language."""

from pyspark.sql import functions as F

from histsearch.llm import spotsigs


def test_tails_count(spark):
    content = [f"content{i}" for i in range(300)]
    bare, other = " ".join(content), " ".join(content[:200] + [f"other{i}" for i in range(100)])
    dense = " ".join(f"the {w}" for w in content[:60])
    rows = [(0, bare), (1, other), (2, dense + " " + bare), (3, dense + " " + other)]
    docs = spark.createDataFrame(rows, "id int, text string").orderBy("id")
    sets = {r[0]: set(r[1]) for r in docs.select("id", spotsigs.signatures(F.col("text"), ["the"])).collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.3 < like(0, 1) < 0.7 and like(2, 3) < 0.8


def test_every_language_has_anchors(spark):
    rows = [(f"l{i:03}", f"q{i:03} content") for i in range(100)]
    assert len(spotsigs.choose_anchors(spark.createDataFrame(rows, "lang string, text string"))) == 100
