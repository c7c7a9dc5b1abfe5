"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints at 3 or fewer differing bits are linked. Every bit position i gets a
vector a(i) of four bits; each of the 15 non-zero vectors v gives a mask that keeps the
positions with an odd product of a(i) and v. Three vectors in four dimensions always have a
common v at right angles, so any pair within the radius agrees under one of the 15
masks: no pair is missed. The masks are applied to distinct fingerprints (copies meet
there first). A bucket with more than MAX_BUCKET of them is split by a second covering
of the bits outside its mask, which keeps the guarantee, and a third time if need be;
then at most 128 fingerprints can share a bucket. A bucket gives a spanning forest of
its links, not its pairs. Components are found by alternating large-star and
small-star steps over the links, each step written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are linked as
any other; very long texts are hashed in blocks; rows that repeat share their
component; null ids never name a component unless all its ids are null; an empty table
gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, materialize, only, read_table, row_key

SEED = 42
RADIUS = 3
MAX_BUCKET = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of *text*, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
        n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    out = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
    return pd.Series(out.view(np.int64))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions *bits* such that any *radius* of them escape at least one."""
    top = (1 << (radius + 1)) - 1
    vectors = {bit: i % top + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, a in vectors.items() if (a & v).bit_count() % 2) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def refined_masks(masks: list[int]) -> list[list[int]]:
    """For each mask, the masks that extend it by a covering of the bits outside it."""
    return [[m | more for more in covering_masks([b for b in range(64) if not m >> b & 1])] for m in masks]


def bucket_links(batches):
    """A spanning forest of the links within each bucket of fingerprints."""
    for batch in batches:
        left, right = [], []
        for bucket in batch.column(0):
            fps = np.sort(bucket.values.to_numpy(zero_copy_only=False).view(np.uint64))
            if len(fps) == 2:
                if int(fps[0] ^ fps[1]).bit_count() <= RADIUS:
                    left.append(fps[:1])
                    right.append(fps[1:])
                continue
            linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
            waiting = np.ones(len(fps), bool)
            for start in range(len(fps)):
                stack = [start] if waiting[start] else []
                waiting[start] = False
                while stack:
                    at = stack.pop()
                    new = np.flatnonzero(linked[at] & waiting)
                    if len(new):
                        waiting[new] = False
                        left.append(np.full(len(new), fps[at]))
                        right.append(fps[new])
                        stack.extend(new.tolist())
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["u", "v"])


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct *fingerprints* (column fp) as all pairs
    within the radius do."""
    masks = covering_masks(list(range(64)))
    rows = fingerprints.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask_id", "mask"))
    rows = rows.select("fp", F.col("mask_id").cast("int").alias("mask_id"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    found, spent = None, []
    for level in range(3):
        sizes = materialize(rows.groupBy("mask_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
        spent.append(sizes)
        last = level == 2
        small = sizes if last else sizes.where(F.col("n") <= MAX_BUCKET)
        buckets = rows.join(small, ["mask_id", "key"]).groupBy("mask_id", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        more = buckets.mapInArrow(bucket_links, "u long, v long")
        found = more if found is None else found.unionByName(more)
        hot = sizes.where(F.col("n") > MAX_BUCKET)
        if last or hot.isEmpty():
            break
        finer = refined_masks(masks)
        table = F.array(*[F.array(*[F.lit(signed(m)) for m in own]) for own in finer])
        rows = rows.join(hot, ["mask_id", "key"]).select("fp", "mask_id", F.posexplode(F.element_at(table, F.col("mask_id") + 1)).alias("sub", "mask"))
        rows = materialize(rows.select("fp", (F.col("mask_id") * len(finer[0]) + F.col("sub")).cast("int").alias("mask_id"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")), "simhash-finer")
        spent.append(rows)
        masks = [m for own in finer for m in own]
    return materialize(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-links", *spent)


def star_components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of *edges* (written already; u > v) but the roots, root
    being the least vertex of its component. Each step's table is removed after the next;
    a vertex with many links is joined as a hot key."""

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    now, seen = edges, mark(edges)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "simhash-least")
        large = join_by_key(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "simhash-star", least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "simhash-least")
        moved = join_by_key(large, least, "u", "n").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        spent = (large, least) if now is edges else (large, least, now)
        now = materialize(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "simhash-star", *spent)
        was, seen = seen, mark(now)
        if was == seen:
            break
    out = now.select("u", F.col("v").alias("root"))
    out.written_at = getattr(now, "written_at", None)
    return out


def cluster(rows: DataFrame) -> DataFrame:
    """*rows* (written already; columns doc_id, fp and others) with the columns root
    (least fingerprint of the component, by its signed value) and component_id."""
    vertices = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")), "simhash-vertices")
    found = links(vertices.select("fp"))
    stars = star_components(found)
    members = stars.select(F.col("u").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    members = materialize(members.join(vertices.drop("n_rows"), "fp"), "simhash-members", found)
    named = materialize(members.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "simhash-named")
    labels = join_by_key(members, named, "root", "n").select("fp", "root", "least_id")
    labelled = vertices.join(labels, "fp", "left").select(
        "fp", "n_rows", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    return join_by_key(rows, materialize(labelled, "simhash-labelled", vertices, members, named, stars), "fp", "n_rows")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = materialize(docs.select("doc_id", fingerprint_of("text").alias("fp")), "simhash-rows")
    return cluster(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """*docs*, all columns, with one row of each component: that of the least id
    (then of the least text hash; of equal rows one)."""
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("hash"), fingerprint_of("text").alias("fp")), "simhash-rows")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("best")
    keep = materialize(cluster(rows).groupBy("root").agg(best).select(*row_key(F.col("best.doc_id"), F.col("best.hash"))), "simhash-keep", rows)
    return only(docs, keep)


def op5_covering_simhash(spark, sf_dir):
    return simhash_components(read_table(spark, sf_dir, "documents"))
