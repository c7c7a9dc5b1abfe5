"""Names that clash, hot keys, held-out rows, and independent restatements of the operators' rules."""

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from histsearch.llm import common, hosts, lines, mixing, packing, quality, sharding, shingles, simhash, spotsigs, urls

CLASHING = (
    "_id", "_hash", "_score", "_text_hash", "_units", "_clean", "_copy", "score", "_range", "_n", "_start", "row", "id_key", "text_key", "units", "clean", "kept_", "range_", "rank", "h", "s", "fp",
    "root", "label", "pos", "tie", "size", "source_size", "need", "hash", "copies", "own_key", "n_rows", "best", "place", "part", "guest",
)


def prose(rng, n):
    return " ".join("w" + str(rng.integers(4000)) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(12)
    passage = ". ".join(prose(rng, 9).capitalize() for _ in range(4)) + "."
    texts = [prose(rng, 60) + ". " + passage, prose(rng, 60) + "\n" + passage, prose(rng, 70), None, "", prose(rng, 70)]
    texts.append(texts[2])
    rows = [(i, t, "en", "a", *[f"{c} {i}" for c in CLASHING]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("name", ["near", "similar", "lines", "good", "score", "rank", "mix"])
def test_no_column_is_lost(spark, clashing, name):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    apply = {
        "near": simhash.drop_near_duplicates,
        "similar": shingles.drop_similar,
        "lines": lines.drop_repeated_lines,
        "good": lambda d: quality.keep_good(d, labels.where("false")),
        "score": lambda d: quality.with_score(d, quality.train(d, labels.where("false"))),
        "rank": lambda d: common.global_rank(d, [F.col("doc_id")], "number", "t"),
        "mix": lambda d: cp.mix_to_weights(spark, d, ""),
    }
    out = apply[name](clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns and len(out.columns) <= len(clashing.columns) + 1
    got = out.collect()
    assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in CLASHING)


def test_pipeline_runs_whole_and_empty(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(13)
    rows = [(i, prose(rng, 40), "en", "ab"[i % 2], 1) for i in range(30)] + [(100, None, None, None, None), (101, "", "en", "a", 0), (102, prose(rng, 30_000), "en", "b", 1)]
    rows.append((103, rows[0][1], "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for kind, table in (("whole", docs), ("empty", docs.where("false"))):
        at = tmp_path / kind
        table.write.parquet(str(at / "documents.parquet"))
        labels.write.parquet(str(at / "labels.parquet"))
        got = cp.run(spark, str(at)).collect()
        if kind == "empty":
            assert got == []
        else:
            ids = {r["doc_id"] for r in got}
            assert 103 not in ids and {r["doc_id"] for r in got if r["piece"] > 0} == {102}
            held = defaultdict(list)
            for r in got:
                held[r["sequence_id"]].append((r["offset"], r["length"]))
            assert all(sum(n for _, n in v) <= packing.CAPACITY and sorted(v)[0][0] == 0 for v in held.values())


def test_join_by_key(spark, monkeypatch):
    rows = common.materialize(spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 9 + ["b", "c", None, None, "d"])], "key string, i int"), "t")
    table = common.materialize(spark.createDataFrame([("a", 9, "A"), ("b", 1, "B"), (None, 2, "N"), ("c", 1, "C")], "key string, n int, says string"), "t")
    expected = sorted((i, {"a": "A", "b": "B", "c": "C", None: "N"}[k]) for i, k in enumerate(["a"] * 9 + ["b", "c", None, None]))
    for most, hot in ((100, 1000), (1, 1000), (1, 3)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted((r["i"], r["says"]) for r in common.join_by_key(rows, table, "key", "n").collect()) == expected


@pytest.fixture
def few_broadcast(monkeypatch):
    for module in (common, shingles):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 3)


# 1


def test_clear_failures_count_at_every_host(spark, few_broadcast):
    plain = " ".join(f"word{i}" for i in range(80))
    clear, mild = plain + " #" * 20, plain + " #" * 3
    rows = [(i, plain, "fine") for i in range(60)] + [(100, clear, "fine"), (101, mild, "fine")] + [(200 + i, mild, "odd") for i in range(30)] + [(300 + i, plain, "odd") for i in range(40)] + [(400, plain, None)]
    got = {r["doc_id"]: r for r in hosts.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100]["kept"] and got[101]["kept"] and got[400]["kept"] and len(got) == len(rows)
    assert not any(got[200 + i]["kept"] for i in range(30)) and all(got[300 + i]["kept"] for i in range(40))


def test_every_equal_line_can_count(spark):
    text = "\n".join([" ".join(f"w{i}" for i in range(60)), "again and again", "again and again"])
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    verdict = lambda n: hosts.rules(n)["dup_lines"][1]
    numbers = hosts.text_numbers(docs)
    assert [numbers.select(verdict(n)).first()[0] for n in (1, 2, 3)] == [True, False, False]


# 2


def test_few_rows_move(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = lambda docs, n: {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, n).collect()}
    eight, nine, fewer = at(ids, 8), at(ids, 9), at(ids.where("doc_id % 100 <> 7"), 8)
    assert np.mean([eight[i] != nine[i] for i in eight]) < 0.25 and np.mean([eight[i] != nine[i] and nine[i] != 8 for i in eight]) < 0.1
    assert np.mean([eight[i] != s for i, s in fewer.items()]) < 0.05


# 3


def brute_signatures(text, anchors):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    found, chained = set(), []
    for i, word in enumerate(w):
        if word in anchors:
            following = [x for x in w[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(following) == spotsigs.CHAIN:
                found.add((word, *following))
                chained.append(i)
    for i in range(len(w)):
        before = [a for a in chained if a <= i]
        far = not chained or (i - before[-1] >= spotsigs.GAP if before else i >= spotsigs.GAP)
        if far:
            found.add(("", *w[i : i + spotsigs.CHAIN + 1]))
    return found


def test_signatures_by_brute_force(spark):
    rng = np.random.default_rng(14)
    anchors = ["the", "of", "la"]
    word = lambda p: anchors[rng.integers(3)] if rng.random() < p else "w" + str(rng.integers(500))
    texts = [" ".join(word(p) for _ in range(n)) for p in (0.0, 0.02, 0.1, 0.5, 1.0) for n in (0, 1, 2, 15, 16, 17, 40, 200)] + [None, "The, OF; La", "ein Wort"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {r[0]: set(r[1]) for r in docs.select("doc_id", spotsigs.signatures(F.col("text"), anchors)).collect()}
    names = {i: brute_signatures(t, set(anchors)) for i, t in enumerate(texts)}
    assert all(len(got[i]) == len(names[i]) for i in names)
    for a in names:
        for b in range(a):
            assert len(got[a] & got[b]) == len(names[a] & names[b])


def test_next_of_null_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 3)
    texts = [f"t{i}" for i in range(40)]
    for ids in ([None] * 40, [5] * 20 + [None] * 20):
        rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
        got = {r["text"]: r["next_text"] for r in spotsigs.with_next(rows, ["text"]).collect()}
        at, seen = "t0", []
        while at not in seen:
            seen.append(at)
            at = got[at]
        assert at == "t0" and sorted(seen) == sorted(texts)
    ranks = [int(t[1:]) >= 20 for t in seen]
    assert sum(a != b for a, b in zip(ranks, ranks[1:] + ranks[:1])) == 2


# 4


def test_pure_suffixes_are_not_blocked_whole(spark):
    rng = np.random.default_rng(15)
    rules = (("block", "com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/"), ("allow", "net", "/en/"))
    rows = []
    for k in range(900):
        bad = rng.random() < 0.5
        host = ("x-9-" * 3 if bad else "") + f"h{rng.integers(60)}"
        tail = "?a=1&b=2&c=3&id=" + "7" * 20 if bad else "page"
        suffix = ["com", "org", "net"][k % 3]
        path = {"com": ["/de/", "/en/"], "org": ["/fr/", "/en/"], "net": ["/en/", "/de/"]}[suffix]
        pick = path[int(bad)] if suffix == "net" else path[0] if (bad == (suffix == "com")) else path[1]
        rows.append((k, f"http://{host}.{suffix}{pick}{tail}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(pages, rules).collect()
    free = [r for r in got if r["rule"] is None and r["host"].endswith(".com")]
    assert len(free) > 50 and sum(r["verdict"] == "block" for r in free) < 0.1 * len(free)
    held = [r for r in urls.judge_urls(pages, rules, leave_out=1).collect() if r["fold"] == 1 and r["rule"] is not None]
    right = [(r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in held]
    assert len(held) > 20 and np.mean(right) > 0.9


# 5 and the pipeline's form


def test_hubs_and_hot_roots(spark, few_broadcast):
    edges = [(i, 0) for i in range(1, 40)] + [(i + 1, i) for i in range(50, 60)] + [(51, 39)] + [(90, 80)]
    table = common.materialize(spark.createDataFrame(edges, "u long, v long"), "t")
    got = {r["u"]: r["root"] for r in simhash.star_components(table).collect()}
    assert got == {i: 0 for i in [*range(1, 40), *range(50, 61)]} | {90: 80}


# 7


def test_held_out_labels_change_nothing(spark):
    rng = np.random.default_rng(16)
    docs = spark.createDataFrame([(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper() + " !!") for i in range(150)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(150)]
    out = {r[0] for r in docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect()}
    flipped = [(i, 1 - q if i in out else q) for i, q in labels]
    one, two = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert 10 < len(out) < 60 and np.array_equal(one.weights, two.weights) and one.cut == two.cut
    other = quality.train(docs, spark.createDataFrame([(i, 1 - q if i not in out else q) for i, q in labels], "doc_id long, quality int"))
    assert not np.allclose(one.weights, other.weights)


# 8


def test_ids_agree_on_any_text():
    from tokenizers import Tokenizer

    paths = packing.tokenizer_paths()
    whole, fast = Tokenizer.from_file(paths[0]), packing.encoder(*paths)
    rng = np.random.default_rng(17)
    kinds = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "'s", "'LL", "don't", "12", "3.5", "...", "é", "é", "漢字", "ا", "😀", "‍", "<|endoftext|>", "<|endof", "a", "The", "ﬁ", "\x00", "\x1c"]
    for _ in range(1500):
        parts = [kinds[rng.integers(len(kinds))] if rng.random() < 0.6 else chr(c) for c in rng.integers(1, 0x20000, int(rng.integers(1, 25))) if not 0xD800 <= c < 0xE000]
        text = "".join(parts)
        assert fast(text) == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_segments_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(18)
    docs = spark.createDataFrame([(i, prose(rng, int(rng.integers(1, 60)))) for i in range(120)], "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    usual = key(packing.pack(docs, 128))
    monkeypatch.setattr(packing, "SEGMENTS", 1)
    monkeypatch.setattr(packing, "RANK_BLOCK", 4)
    assert key(packing.pack(docs, 128)) == usual


# 9


def spelled_units(text, unit_words):
    """Units as the rule is stated, character by character."""
    out, start = [], 0
    for at in range(1, len(text) + 1):
        last, nxt = text[at - 1], text[at : at + 1]
        ends = last == "\n" or at == len(text)
        if not ends and last in " \t":
            k = at - 1
            while k >= 0 and text[k] in " \t":
                k -= 1
            stop = k >= 0 and text[k] in ".!?…" and not nxt.isspace()
            ends = (stop or unicodedata.category(nxt) == "Lu") and len(text[start:at].split()) >= unit_words
        if ends and at > start:
            out.append((start, at))
            start = at
    return out


def spelled_cut(texts, min_words, unit_words):
    seen, left = set(), {}
    for k, text in texts:
        units = [(a, b, " ".join(text[a:b].split()).lower()) for a, b in spelled_units(text, unit_words) if text[a:b].split()]
        again = []
        for _, _, d in units:
            again.append(d in seen)
            seen.add(d)
        kept, i, gone = [True] * len(text), 0, 0
        while i < len(units):
            j = i
            while j < len(units) and again[j]:
                j += 1
            if j > i and sum(len(units[x][2].split()) for x in range(i, j)) >= min_words:
                for p in range(units[i][0], units[j - 1][1]):
                    kept[p], gone = False, gone + 1
            i = max(j, i + 1)
        left[k] = "".join(c for c, keep in zip(text, kept) if keep)
    return left


@pytest.mark.parametrize("min_words,unit_words", [(lines.MIN_WORDS, lines.UNIT_WORDS), (1, 1)])
def test_lines_by_the_stated_rule(spark, min_words, unit_words):
    rng = np.random.default_rng(19)
    bits = ["One two three four five.", "six seven eight", "Nine", "ten eleven twelve! ", "\n", "\t", " ", "Zwölf Äpfel fallen… ", "a b c d e f\n", "Same Words In Capitals Here", "x.", "\n\n"]
    texts = [(i, " ".join(bits[rng.integers(len(bits))] for _ in range(int(rng.integers(1, 14))))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs, min_words=min_words, unit_words=unit_words).collect()}
    assert got == spelled_cut(texts, min_words, unit_words)


# 10


def test_mix_with_hot_sources(spark, few_broadcast):
    rng = np.random.default_rng(20)
    rows = [(i, prose(rng, int(rng.integers(1, 30))), ["hot", "hot", "b", None, "c"][i % 5]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_sources(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
    assert len(got) == 200 and all(abs(taken[s] - target[s]) <= 30 for s in target) and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
