"""SimHash near-duplicates on word shingles at a Jaccard similarity, no pair missed.

The pipeline's form of the covering SimHash. Texts become sets of WIDTH-word shingles
(64-bit hashes); those of a Jaccard similarity of SIMILARITY or more are linked. Candidates come
from the covering masks of :mod:`.simhash` over the sets' fingerprints (every pair within the
radius), and from texts with the same least hash, which are compared with one of them as a hub: first the
one that shares most of its least hashes, in later rounds others of other components, so that
a large group of near copies is one component early, without its pairs. Each candidate is checked on the
whole sets.

At that similarity fingerprints may differ in more bits than masks can cover, so an exact join
does the rest, across the components found so far: in any one order of all shingles, two such
sets share one of the first n - SIMILARITY * n + 1 of each. Only shingles that lie at the head of
texts of several components are joined, and the joined pairs must pass a bound on what their sets
can share (from the places of the shared shingle, and from sketches) before they are checked. The
order puts those shingles last that are common in a sample of texts; the sample decides what the
join costs, not what it finds.

Defined results: equal texts are one vertex; null, empty and other texts without words are like each other and
unlike any other; texts of fewer words than WIDTH are one shingle; very long texts are
cut into shingles whole; rows that repeat count once; an empty table gives no rows; columns other than
doc_id and text play no part and may have any names.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, join_by_key, materialize, only, row_key
from .simhash import SEED, links, star_components

WIDTH = 5
SIMILARITY = 0.8
WORD = re.compile(r"\w+")
#: So many texts are cut into shingles at a time.
SLICE = 256
BITS = 1024
#: Shingles of a text whose bits are counted at a time.
BLOCK = 1 << 16
#: Texts of the sample, and the shingles (the most common in it) that go last.
SAMPLE = 10_000
COMMON = 100_000
#: Orders of the shingles, each of which gives a least hash.
ORDERS = 12
#: Rounds of comparisons with hubs.
ROUNDS = 4
#: Sets of more shingles have a second sketch of WIDE_BITS bits.
LONG, WIDE_BITS = 1000, 4096


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the words of *text*, without regard to
    case and punctuation unless it has nothing else."""
    import xxhash

    lowered = (text or "").lower()
    words = [w.encode("utf-8") for w in WORD.findall(lowered) or lowered.split()]
    if not words:
        return np.zeros(0, np.uint64)
    rows = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64, max(1, len(words) - width + 1)))


def print_of(s: np.ndarray) -> int:
    """The SimHash of a set of shingles: bits that more than half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), BLOCK):
        ones += np.unpackbits(s[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s)).tobytes(), "big")


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prefix_size(n: int, similarity: float) -> int:
    # The margin keeps products such as 0.8 * 5 from being rounded up.
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def slices(batches):
    """So few texts at a time that a worker's memory is bounded."""
    return (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE))


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(h, s) of *texts* (h, text), s being the set of shingles."""

    def of(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([shingles(t.as_py(), width) for t in batch.column(1)])], names=["h", "s"])

    return texts.select("h", "text").mapInArrow(of, "h long, s array<long>")


def common_shingles(docs: DataFrame, width: int) -> dict[int, int]:
    """The most common shingles of a sample of the distinct texts, with their counts."""
    texts = docs.select("text", F.xxhash64("text").alias("h"))
    share = max(1, docs.count() // SAMPLE)
    sample = texts.where(F.pmod("h", F.lit(share)) == 0).groupBy("h").agg(F.first("text").alias("text"))
    counts = sets_of(sample, width).select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return {r[0]: r[1] for r in counts.orderBy(F.desc("n"), "s").limit(COMMON).collect()}


def keyed(docs: DataFrame, common: dict[int, int], width: int, similarity: float) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), prefix (its first shingles in
    the order), least (its least hashes), fp (its SimHash) and sketch (the parities of how
    many shingles fall to each of BITS bits; wide: of WIDE_BITS, for long texts) of every document."""
    names = np.array(list(common), np.int64).view(np.uint64)
    order = np.argsort(names)
    names, counts = names[order], np.array(list(common.values()), np.int64)[order]

    factors = np.random.default_rng(SEED).integers(0, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    nothing = np.zeros(0, np.uint64)

    def of(batches):
        for batch in slices(batches):
            sizes, prefix, least, sketch, wide, prints = [], [], [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), width)
                rank = np.zeros(len(s), np.int64)
                if len(names) and len(s):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    rank = np.where(names[at] == s, counts[at], 0)
                sizes.append(len(s))
                prints.append(print_of(s))
                prefix.append(s[np.lexsort((s, rank))][: prefix_size(len(s), similarity)])
                mixed = [s * f for f in factors]
                least.append(np.array([(m ^ m >> np.uint64(29)).min() if len(s) else 0 for m in mixed], np.uint64))
                sketch.append(parities(s, BITS))
                wide.append(parities(s, WIDE_BITS) if len(s) > LONG else nothing)
            own = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), own, lists(prefix), lists(least), lists(sketch), lists(wide)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "fp", "prefix", "least", "sketch", "wide"])

    kinds = {"doc_id": docs.schema["doc_id"].dataType, "h": T.LongType(), "n": T.IntegerType(), "fp": T.LongType(), "prefix": T.ArrayType(T.LongType()), "least": T.ArrayType(T.LongType()), "sketch": T.ArrayType(T.LongType()), "wide": T.ArrayType(T.LongType())}
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(of, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))


def most_apart(n1: str, n2: str, similarity: float):
    """In so many shingles may two similar sets of *n1* and *n2* differ."""
    return (1 - similarity) / (1 + similarity) * (F.col(n1) + F.col(n2)) + 1e-9


def apart(one: str, two: str, bits: int):
    """Sets differ in as many shingles as their sketches in bits, at least."""
    words = [F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(bits // 64)]
    return sum(words[1:], words[0])


def likely(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The *pairs* (u, v) that the sketches don't rule out."""
    for name, bits in (("sketch", BITS), ("wide", WIDE_BITS)):
        own = [texts.select(F.col("h").alias(k), F.col("n").alias(f"n{k}"), F.col(name).alias(f"{name}{k}")) for k in ("u", "v")]
        met = pairs.join(own[0], "u").join(own[1], "v")
        both = (F.size(f"{name}u") > 0) & (F.size(f"{name}v") > 0)
        pairs = met.where(~both | (apart(f"{name}u", f"{name}v", bits) <= most_apart("nu", "nv", similarity))).select("u", "v")
    return pairs


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The *pairs* (u, v; written already) of texts that are as similar as *similarity*, compared whole."""
    members = pairs.select(F.col("u").alias("h")).unionByName(pairs.select(F.col("v").alias("h"))).distinct()
    members = materialize(members.join(texts.select("h", "n_rows"), "h"), "shingles-members")
    tagged, n = docs.select(F.xxhash64("text").alias("h"), "text"), members.count()
    found = tagged.join(F.broadcast(members), "h") if n <= BROADCAST_ROWS else join_by_key(tagged, members, "h", "n_rows")
    sets = materialize(sets_of(found.groupBy("h").agg(F.first("text").alias("text")), width), "shingles-sets", members)
    one, two = (sets.select(F.col("h").alias(k), F.col("s").alias(g)) for k, g in (("u", "su"), ("v", "sv")))
    both = F.size(F.array_intersect("su", "sv"))
    total = F.size("su") + F.size("sv") - both
    met = pairs.join(one, "u").join(two, "v").where((total == 0) | (both >= similarity * total - 1e-9))
    return materialize(met.select("u", "v"), "shingles-near", sets, pairs)


def covered_pairs(texts: DataFrame) -> DataFrame:
    """Candidates (u > v): the first texts of fingerprints that the covering masks link."""
    prints = materialize(texts.groupBy("fp").agg(F.min("h").alias("h")), "shingles-prints")
    covered = links(prints.select("fp"))
    one, two = (prints.select(F.col("fp").alias(k), F.col("h").alias(h)) for k, h in (("u", "hu"), ("v", "hv")))
    near = covered.join(one, "u").join(two, "v").select(F.greatest("hu", "hv").alias("u"), F.least("hu", "hv").alias("v"))
    return materialize(near, "shingles-covered", prints, covered)


def shared_keys(texts: DataFrame) -> DataFrame:
    """(h, key, score) of the least hashes, and fingerprints, that texts share; score tells how
    many share those of the text."""
    keys = F.concat(F.transform("least", lambda x, i: F.xxhash64(i, x)), F.array(F.xxhash64(F.lit("fp"), "fp")))
    flat = texts.select("h", F.explode(keys).alias("key"))
    counts = materialize(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").withColumn("shared", F.col("n_rows")), "shingles-counts")
    shared = materialize(join_by_key(flat, counts, "key", "n_rows"), "shingles-shared", counts)
    scores = shared.groupBy("h").agg(F.sum("shared").alias("score"))
    return materialize(shared.select("h", "key").join(scores, "h"), "shingles-keys", shared)


def hub_pairs(keys: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Candidates (u > v): texts and a hub of another component with which they share a key."""
    rooted = keys.withColumn("root", F.col("h")) if roots is None else keys.join(roots.withColumnRenamed("u", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rooted = materialize(rooted, "shingles-rooted")
    place = -F.col("score") if turn == 0 else F.xxhash64("h", F.lit(turn))
    hub = F.min_by(F.struct(F.col("h").alias("hub"), F.col("root").alias("hub_root")), F.struct(place.alias("place"), F.col("h"))).alias("hub")
    hubs = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), hub, F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    hubs = materialize(hubs.select("key", "n_rows", "hub.*"), "shingles-hubs")
    met = join_by_key(rooted, hubs, "key", "n_rows").where("root <> hub_root")
    return materialize(met.select(F.greatest("h", "hub").alias("u"), F.least("h", "hub").alias("v")).distinct(), "shingles-pairs", rooted, hubs)


def hub_links(docs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u > v) found by covering masks and hubs, with stars of what they connect."""
    keys = shared_keys(texts)
    covered = covered_pairs(texts)
    pairs = materialize(hub_pairs(keys, None, 0).unionByName(covered).distinct(), "shingles-pairs", covered)
    edges = verified(materialize(likely(pairs, texts, similarity), "shingles-likely", pairs), docs, texts, width, similarity)
    for turn in range(1, ROUNDS):
        stars = star_components(edges)
        pairs = hub_pairs(keys, stars, turn)
        more = verified(materialize(likely(pairs, texts, similarity), "shingles-likely", pairs), docs, texts, width, similarity)
        if more.isEmpty():
            break
        known = edges if stars.written_at == edges.written_at else stars.withColumnRenamed("root", "v")
        edges = materialize(known.unionByName(more), "shingles-edges", edges, more, stars)
    discard(keys)
    return edges


def across_pairs(texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Candidates (u > v) of different components (*roots*; a text without one is its own)."""
    heads = texts.select("h", "n", "sketch", "prefix").join(roots.withColumnRenamed("u", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rooted = materialize(heads, "shingles-rooted")
    heads = rooted.select("h", "n", "root", F.posexplode("prefix").alias("i", "key"))
    mixed = heads.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n_rows")).where("a < b").select("key", "n_rows")
    mixed = materialize(mixed, "shingles-mixed")
    live = materialize(join_by_key(heads, mixed, "key", "n_rows").select("key", "h", "i"), "shingles-live", mixed)
    live = materialize(live.join(rooted.select("h", "n", "root", "sketch"), "h"), "shingles-live", live, rooted)
    one, two = (live.select("key", *[F.col(c).alias(c + k) for c in ("h", "n", "i", "root", "sketch")]) for k in ("1", "2"))
    need = similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-9
    # What may follow the first shared shingle bounds what two sets share.
    room = F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2")) >= need
    fits = (F.col("root1") != F.col("root2")) & (F.col("h1") > F.col("h2")) & room & (apart("sketch1", "sketch2", BITS) <= most_apart("n1", "n2", similarity))
    return materialize(one.join(two, "key").where(fits).select(F.col("h1").alias("u"), F.col("h2").alias("v")).distinct(), "shingles-across", live)


def similar_components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, h (hash of the text) of every document; and h, root of every
    text that is linked to another, root being the least h of its component."""
    wide = materialize(keyed(docs, common_shingles(docs, width), width, similarity), "shingles-wide")
    parts = ("n", "fp", "prefix", "least", "sketch", "wide")
    texts = materialize(wide.groupBy("h").agg(*[F.first(c).alias(c) for c in parts], F.count(F.lit(1)).alias("n_rows")), "shingles-texts")
    rows = materialize(wide.select("doc_id", "h"), "shingles-rows", wide)
    near = hub_links(docs, texts, width, similarity)
    roots = star_components(near)
    across = across_pairs(texts, roots, similarity)
    more = verified(materialize(likely(across, texts, similarity), "shingles-likely", across), docs, texts, width, similarity)
    edges = materialize(near.unionByName(more).distinct(), "shingles-edges", near, more, texts, roots)
    return rows, star_components(edges).withColumnRenamed("u", "h")


def drop_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """*docs*, all columns, with one row of each component: that of the least id
    (then of the least text hash; of equal rows one)."""
    rows, roots = similar_components(docs, width, similarity)
    firsts = materialize(rows.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("best")), "shingles-best", rows)
    best = firsts.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("best").alias("best"))
    return only(docs, materialize(best.select(*row_key(F.col("best.doc_id"), F.col("best.h"))), "shingles-keep", firsts))
