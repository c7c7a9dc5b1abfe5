"""The pipeline's stages on a small corpus, and the registered names."""

from collections import Counter

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(11)
    text = lambda n: ". ".join(" ".join("w" + str(rng.integers(5000)) for _ in range(10)) for _ in range(n)) + "."
    good = [(i, text(8), "en", ["a", "b", None][i % 3], 1, "extra") for i in range(45)]
    bad = [(100 + i, " | ".join(text(5).upper().split()) + "!!", "en", "a", 1, "extra") for i in range(15)]
    copies = [(200, good[0][1], "en", "b", 1, "extra"), (0, *good[0][1:]), (201, None, "en", "b", 1, "extra"), (202, good[1][1] + " " + text(6), "en", "b", 1, None)]
    docs = spark.createDataFrame(good + bad + copies, "doc_id long, text string, lang string, source string, n_chars long, size string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "mix_to_weights", "best_fit_packing"]
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert not {i for i, *_ in bad} & set(kept["quality_classifier"]) and len(set(kept["quality_classifier"]) & {i for i, *_ in good}) >= 43
    assert Counter(kept["simhash_near_dedup"])[0] == 1 and 200 not in kept["simhash_near_dedup"]
    assert sorted(kept["substring_dedup"]) == sorted(kept["simhash_near_dedup"])
    assert set(kept["best_fit_packing"]) == set(kept["mix_to_weights"])


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} >= {"pipeline"} and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= names
