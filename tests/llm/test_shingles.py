"""The pipeline's near-duplicate stage against brute force."""

import numpy as np

import corpus_pipeline as cp
from histsearch.llm import shingles, simhash


def make_texts():
    rng = np.random.default_rng(4)
    base = [["w" + str(rng.integers(3000)) for _ in range(120)] for _ in range(8)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for n in (1, 2, 3, 4, 6, 9):
            edited = list(b)
            for at in rng.choice(120, n, replace=False):
                edited[at] = "x" + str(rng.integers(10**6))
            texts.append(" ".join(edited))
    group = " ".join(base[0][:60])
    texts += [group + " tail" + str(i) for i in range(40)]
    return texts + [texts[0], None, "", " \n", "one two", "one two", "one two three four five six"]


def test_every_similar_pair_is_linked(spark):
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                far += (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > simhash.RADIUS
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert far
    got = sorted(r["doc_id"] for r in cp.simhash_near_dedup(spark, docs, "").collect())
    assert got == sorted({find(i) for i in range(len(texts))})
