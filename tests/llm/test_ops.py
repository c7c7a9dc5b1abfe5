"""The operators against brute force, over rows with nulls, blanks, long texts, copies, ties and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from histsearch.llm import hosts, lines, mixing, packing, quality, sharding, simhash, spotsigs, urls
from histsearch.llm.common import global_rank

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, rank int, fp long, score double, unit int, place int, source_size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    common = ["the", "of", "and", "to", "la", "de"]
    return " ".join(common[rng.integers(6)] if rng.random() < 0.3 else "w" + str(rng.integers(4000)) for _ in range(n))


def make_rows():
    rng = np.random.default_rng(3)
    texts = [". ".join(sentence(rng, int(rng.integers(8, 15))).capitalize() for _ in range(int(rng.integers(5, 9)))) + "." for _ in range(26)]
    texts += [texts[0]] * 4 + [texts[1] + " End", texts[2].replace("w1", "w2", 1)]
    texts += [None, "", " \n\t ", "one", "two words", "###$$$ %%% " * 40, "same line\n" * 60, sentence(rng, 60) + "\n" + texts[5], "Ünï çödé 😀 " * 20, "a<|endoftext|>b   c \n  d", (sentence(rng, 3000) + "\n") * 2]
    rows = [(i, t, ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4], len(t or ""), 1, "x", 2, 3, 0.5, 4, 5, 6) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_words_and_ranks(spark, docs):
    from histsearch.llm.common import n_words
    from histsearch.llm.common import words as words_of

    got = docs.select("text", n_words(F.col("text")).alias("n"), words_of(F.col("text")).alias("w")).collect()
    assert all(r["n"] == len(words(r["text"])) and r["w"] == words(r["text"]) for r in got)
    ranked = global_rank(docs.select("doc_id", "text"), [F.col("doc_id"), F.col("text")], "at", "t").collect()
    assert [r["at"] for r in sorted(ranked, key=lambda r: r["at"])] == list(range(len(ROWS)))


# 1: host rules


def numbers_of(text):
    w = words(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if counts[x] > 1 for k in range(3)}
    own = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


def test_host_rules(docs, none):
    got = hosts.judge(docs).collect()
    by_id = {r[0]: r[1] for r in ROWS}
    for r in got:
        n, chars, symbols, dup, repeat = numbers_of(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
    assert len(got) == len(ROWS) and hosts.judge(none).collect() == []


def test_hosts_are_blocked_by_shrunk_rates(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "short", "bad") for i in range(60)] + [(100 + i, good, "bad") for i in range(10)] + [(200 + i, good, "fine") for i in range(60)] + [(300, "short", "new"), (301, good, "new")]
    got = {r["doc_id"]: r for r in hosts.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[100 + i]["kept"] for i in range(10)) and all(got[200 + i]["kept"] for i in range(60))
    assert not got[300]["kept"]


# 2: sharding


def test_bounded_ring(docs, none):
    got = sharding.shard_rows(docs, 8).collect()
    assert len(got) == len(ROWS)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    assert sharding.shard_rows(none).collect() == []


def test_overflow_goes_clockwise():
    nodes = [(10, 0), (20, 1), (30, 0), (40, 2)]
    segments = sharding.assign(nodes, [9, 0, 0, 0], 3)
    assert [(a, s, n, shard) for a, s, n, shard, _ in segments] == [(0, 0, 3, 0), (0, 3, 3, 1), (0, 6, 3, 2)]
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 200).tolist()
    nodes = [(i, int(rng.integers(5))) for i in range(200)]
    segments = sharding.assign(nodes, counts, 5)
    held = Counter()
    for arc, start, n, shard, slot in segments:
        assert slot == held[shard]
        held[shard] += n
    assert sum(held.values()) == sum(counts) and max(held.values()) - min(held.values()) <= 1
    full = {s for s in range(5) if sum(c for c, (_, t) in zip(counts, nodes) if t == s) > sum(counts) // 5}
    assert all(nodes[arc][1] == shard or nodes[arc][1] in full for arc, _, _, shard, _ in segments)


# 3: SpotSigs


def test_spotsigs(docs, none):
    got = spotsigs.likeness(docs).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r[0] is None, -(r[0] or 0), tuple(-ord(c) for c in (r[1] or "")))
    ordered = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert key(ordered[0])[0] is False
    nexts = {}
    for i, r in enumerate(ordered):
        nexts.setdefault(r[0], set()).add(ordered[(i + 1) % len(ordered)][1] or "")
    texts = {r[0]: r[1] or "" for r in ROWS}
    prints = {}
    for r in got:
        text = texts[r["doc_id"]]
        cut = len(text) // 3
        edits = {hashlib.sha256((text[: len(text) - cut] + n[:cut]).encode()).hexdigest() for n in nexts[r["doc_id"]]}
        assert r["n_chars"] == len(text) and r["edited_sha256"] in edits
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = ({r[c][i : i + 8] for i in range(0, len(r[c]), 8)} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert spotsigs.likeness(none).collect() == []


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    rng = np.random.default_rng(5)
    ids = [int(x) for x in rng.choice(10_000, 120, replace=False) - 5000]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(rows, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


def test_spot_near_duplicates(spark):
    rng = np.random.default_rng(8)
    bases = [sentence(rng, 300) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(bases)] + [(10 + i, t + " and some tail of other words the last w1 w2", "en") for i, t in enumerate(bases[:3])] + [(20, bases[0], "en"), (21, None, "en"), (22, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    anchors = spotsigs.choose_anchors(docs)
    sets = {r[0]: set(r[1]) for r in docs.select("doc_id", spotsigs.signatures(F.col("text"), anchors)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    expected = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and like(sets[a], sets[b]) >= 0.8}
    members, pairs = spotsigs.near_duplicates(docs, 0.8)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    found = {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()}
    assert found == {tuple(sorted((of[a], of[b]))) for a, b in expected} and found
    assert of[20] == of[0] == 0 and of[22] == of[21] == 21


# 4: URLs

URLS = [
    "http://a.net/x", "http://a.example.net/en/1", "https://EXAMPLE.com/de/?q", "http://x.example.com/fr/", "http://w.org/fr/a#b", "http://w.org/en/", "http://a.net", "http://notnet/", "no scheme", None, "",
    "ftp://b.c.net?x=1&y=2", "http://xexample.net/en/", "http://deep.org/a/b/c/d-e?f=g&h=i", "http://a.net/x", "x://" + "y" * 5000,
]


def ruled(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, suffix double")
    for r in urls.judge_urls(pages, trees=2, depth=2).collect():
        host, path, rule, verdict = ruled(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in urls.judge_urls(pages.where("page_id in (8, 9)")).collect()} == {"allow"}
    assert urls.judge_urls(pages.where("false")).collect() == []


def test_entropy(spark):
    import math

    got = {r[0]: r[1] for r in spark.createDataFrame([(u or "",) for u in URLS], "u string").select("u", urls.entropy(F.col("u"))).collect()}
    for u, e in got.items():
        assert e == pytest.approx(-sum(c / len(u) * math.log2(c / len(u)) for c in Counter(u).values()) if u else 0.0)


# 5: SimHash


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(prints)):
        least[find(i)].append(ids[i])
    return [min([x for x in least[find(i)] if x is not None], default=None) for i in range(len(prints))]


def brute_print(text):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, none):
    got = simhash.simhash_components(docs).collect()
    prints = [brute_print(r[1]) for r in ROWS]
    expected = Counter(zip((r[0] for r in ROWS), (f"{p:016x}" for p in prints), brute_components(prints, [r[0] for r in ROWS])))
    assert Counter(map(tuple, got)) == expected
    assert simhash.simhash_components(none).collect() == []


def test_no_pair_escapes_the_covering():
    rng = np.random.default_rng(2)
    masks = simhash.covering_masks(list(range(64)))
    finer = simhash.refined_masks(masks)
    assert len(masks) == 15
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
        assert any(not diff & m for m in masks)
        assert all(any(not diff & f for f in more) for m, more in zip(masks, finer) if not diff & m)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_BUCKET", 4)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(20, int(rng.integers(0, 6)), replace=False)) for _ in range(60)}
    prints |= {int(x) for x in rng.integers(1 << 62, size=20)}
    prints = sorted(prints)
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(rows).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components(prints, list(range(len(prints))))


def test_one_of_each_component_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(r[1]) for r in ROWS]
    components = brute_components(prints, [r[0] for r in ROWS])
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(set(components), key=str)


# 7: quality


def test_quality(spark, docs, none):
    rng = np.random.default_rng(6)
    good = [(1000 + i, sentence(rng, 80) + ".") for i in range(120)]
    bad = [(2000 + i, " | ".join(sentence(rng, 40).upper().split()) + "!!") for i in range(80)]
    texts = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, None) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(1000, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.train(texts, labels)
    rows = quality.with_score(texts, ranker).collect()
    right = [(r["score"] >= quality.CUT) == (r["doc_id"] < 2000) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(right) > 20 and np.mean(right) > 0.95
    scored = quality.with_score(docs, ranker).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score_"] <= 1 and r["score"] in (0.5, None) for r in scored)
    kept = quality.keep_good(texts, labels)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in good[:100]} - {r["doc_id"] for r in rows if r["score"] < quality.CUT}
    assert quality.keep_good(none, labels.where("false")).collect() == []
    assert {r["score_"] for r in quality.with_score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}


def test_held_out_rows_are_not_learned():
    x = np.array([[0.0] * quality.FEATURES, [1.0] * quality.FEATURES] * 20)
    ranker = quality.Ranker(x, np.array([0, 1] * 20))
    low, high = ranker.score(x[:2])
    assert low < high and not quality.Ranker(x, np.ones(40)).fitted


# 8: packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_paths()[0])
    expected = Counter()
    for r in ROWS:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        start, end, k = 0, len(ids) % 256 or 256, 0
        while start < len(ids):
            expected[r[0], k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
            start, end, k = end, end + 256, k + 1
    got = packing.pack(docs, 256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        upto = 0
        for offset, n in sorted(own):
            assert offset == upto
            upto += n
        assert upto <= 256
    rooms: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        rooms.append(256 - n) if k is None else rooms.__setitem__(k, rooms[k] - n)
    assert len(by_sequence) <= len(rooms) + 1
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_plans_hold_every_length(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(rng.geometric(0.004, n), 512)
    hist = Counter(lengths.tolist())
    plan = packing.plan_packing(hist, 512, 32)
    used = Counter()
    for items, k in plan:
        assert sum(items) <= 512 and k > 0
        for v in items:
            used[v] += k
    assert used == hist and sum(k for _, k in plan) <= 1.02 * -(-int(lengths.sum()) // 512) + 1


# 9: lines


def test_line_dedup(docs, none):
    got = lines.drop_repeated_lines(docs, details=True).collect()
    assert len(got) == len(ROWS)
    assert lines.drop_repeated_lines(docs).columns == docs.columns
    texts = {r[0]: r[1] for r in ROWS}
    seen: set = set()
    by_id = {r["doc_id"]: r for r in got}
    for doc_id in sorted(texts, key=lambda x: (x is None, x)):
        text, r = texts[doc_id], by_id[doc_id]
        if text is None:
            assert r["text"] is None and r["kept"] == []
            continue
        repeated = []
        for k, (start, end, words_) in enumerate(u for u in lines.units(text) if u[2]):
            d = " ".join(words_).lower()
            if d in seen:
                repeated.append((k, start, end, len(words_)))
            seen.add(d)
        spans = lines.kept_spans(len(text), repeated)
        assert [(s["start"], s["end"]) for s in r["kept"]] == spans and r["text"] == "".join(text[a:b] for a, b in spans) and r["n_repeated"] == len(repeated)
    assert lines.drop_repeated_lines(none).collect() == []


def test_units_and_planted_passage():
    rng = np.random.default_rng(9)
    passage = " ".join(sentence(rng, 9).capitalize() + "." for _ in range(8))
    a, b = sentence(rng, 30) + " " + passage + " " + sentence(rng, 12), sentence(rng, 25) + " " + passage
    for text in (a, b, "x\n\ny", ""):
        assert "".join(text[s:e] for s, e, _ in lines.units(text)) == text
    first = {" ".join(w).lower() for _, _, w in lines.units(a)}
    again = [(k, s, e, len(w)) for k, (s, e, w) in enumerate(lines.units(b)) if " ".join(w).lower() in first]
    left = "".join(b[s:e] for s, e in lines.kept_spans(len(b), again))
    assert len(left.split()) <= 25 + 12


# 10: mixing


def test_mix(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
    source = {r[0]: r[3] for r in ROWS}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
    largest = max(len(words(r[1])) for r in ROWS)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    assert mixing.mix_sources(none).collect() == []


def test_equal_rows_are_parted(spark):
    rows = spark.createDataFrame([(1, "a b c", "hot")] * 40 + [(2, "x " * 500, "cold")], "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(rows, weights=(1.0, 30.0)).collect()
    hot = [r for r in got if r["doc_id"] == 1]
    assert abs(sum(r["copies"] * 3 for r in hot) - hot[0]["target"]) <= 3
