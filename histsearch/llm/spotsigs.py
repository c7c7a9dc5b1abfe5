"""SpotSigs document fingerprints (native).

Anchors are common short words: of each language the ANCHORS most frequent words of at
most ANCHOR_CHARS letters, counted over all documents. A signature is an anchor
with the CHAIN content words (words that are no anchors) that follow it. Each word that lies
GAP words or more behind the last anchor with a chain starts one more, in a text without such
anchors every word, so that texts or stretches without anchors are seen whole. A fingerprint is the
sorted set of 31-bit hashes of the signatures, as hexadecimal digits.
Two fingerprints are compared by Jaccard similarity.

``near_duplicates`` joins fingerprints: equal sets meet first, sets are dealt into ranges
of their length such that a pair within the threshold is in one range or the next, and
only sets that share one of their rarest signatures (as many as the threshold
demands) are compared.

Defined results: null and blank texts have the empty fingerprint, which is like
itself (1) and unlike any other (0); very long texts are read whole; documents with one id follow each
other in descending order of their texts' hashes, rows that are wholly equal lie side by side in one range; null
ids come last; an empty table gives no rows; other columns play no part, lang only in choosing anchors
for all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, let, materialize, read_table

ANCHORS = 16
ANCHOR_CHARS = 4
CHAIN = 2
#: From so many words behind an anchor on, every word starts one.
GAP = 16
#: Rows of a range of ids in which neighbours are found, on average, and the ranges that are broadcast
#: (16 bytes each); beyond so many ranges they grow.
RANGE_ROWS = 1000
RANGES = 50_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def choose_anchors(docs: DataFrame, per_language: int = ANCHORS) -> list[str]:
    """The anchors: at most per_language words of every language."""
    short = F.filter(tokens(F.col("text")), lambda w: F.length(w) <= ANCHOR_CHARS)
    counts = docs.select("lang", F.explode(short).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "spot-words")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    return sorted(r[0] for r in top.select("word").distinct().collect())


def signatures(text: Column, anchors: list[str]) -> Column:
    """Sorted array<int> of the distinct signature hashes of the whole *text*."""

    def is_anchor(w: Column) -> Column:
        return w.isin(anchors) if anchors else F.lit(False)

    def chains(w: Column, content: Column, places: Column) -> Column:
        # Before the j-th anchor, at word i, there are i - j content words.
        def signature(i: Column, j: Column) -> Column:
            return F.xxhash64(F.get(w, i), *[F.get(content, i - j + k) for k in range(CHAIN)]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

        def opening(k: Column) -> Column:
            return F.xxhash64(F.lit(""), *[F.get(w, k + n) for n in range(CHAIN + 1)]).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

        def stretch(start: Column, end: Column) -> Column:
            return F.when(start < end, F.transform(F.sequence(start, end - 1), opening)).otherwise(F.array().cast("array<int>"))

        size = F.size(w)
        chained = F.filter(places, lambda i, j: i - j + CHAIN <= F.size(content))
        # Places with a chain come first, so their numbers among all places hold.
        whole = F.transform(chained, signature)
        head = F.when(F.size(chained) == 0, F.lit(0)).otherwise(F.lit(GAP))
        starts = F.concat(F.array(head), F.transform(chained, lambda i: i + GAP))
        gaps = F.flatten(F.zip_with(starts, F.concat(chained, F.array(size)), stretch))
        return F.array_sort(F.array_distinct(F.concat(whole, gaps)))

    def over(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull())
        return let(F.filter(w, lambda x: ~is_anchor(x)), lambda content: let(places, lambda p: chains(w, content, p)))

    return let(tokens(text), over)


def fingerprint(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def range_cuts(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row: blocks (the ranges' first (doc_id, hash), highest first, in blocks of about as many as
    there are blocks) and top (the very first); and the number of ranges.

    A cut is a document whose hash says so, one in RANGE_ROWS, so that cuts follow the ids' own
    spread and part null ids and repeated ids as well."""
    place = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    n = rows.count()
    each = max(RANGE_ROWS, -(-n // RANGES))
    hit = F.pmod(F.xxhash64(F.lit("cut"), "doc_id", F.xxhash64("text")), F.lit(each)) == 0
    top = F.max(place).alias("top")
    cuts = rows.agg(F.sort_array(F.collect_set(F.when(hit, place)), asc=False).alias("cuts"), top)
    cuts = materialize(cuts.withColumn("cuts", F.filter("cuts", lambda c: c < F.col("top"))), "spot-cuts")
    count = cuts.select(F.size("cuts")).first()[0] if n else 0
    step = max(1, int(max(0, count) ** 0.5))
    if count <= 0:
        blocks = F.array().cast(f"array<{cuts.schema['cuts'].dataType.simpleString()}>")
    else:
        blocks = F.transform(F.sequence(F.lit(0), F.lit(count - 1), F.lit(step)), lambda i: F.slice("cuts", i + 1, step))
    return cuts.select(blocks.alias("blocks"), "top", F.lit(step).alias("step")), max(0, count) + 1


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """*rows* (doc_id, text, ...) with next_<c> of the row that follows in descending
    order of doc_id; after the last comes the first.

    Ids are cut into ranges. A range's first row is sent to the range before as well, the
    very first to the last, so each range knows what follows its own last row: one shuffle of the
    texts, no task with all rows.
    """
    cuts, ranges = range_cuts(rows.select("doc_id", "text"))
    known = rows.select("*", F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("place")).crossJoin(F.broadcast(cuts))  # one row
    # The range of a row: how many cuts are not below it; found in two short steps.
    x, blocks = F.col("place"), F.col("blocks")
    full = F.size(F.filter(blocks, lambda b: F.element_at(b, -1) >= x))
    part = let(full, lambda k: k * F.col("step") + F.when(k < F.size(blocks), F.size(F.filter(F.get(blocks, k), lambda c: c >= x))).otherwise(F.lit(0)))
    dealt = known.withColumn("part", F.least(part, F.lit(ranges - 1)))
    is_cut = let(F.floor((F.col("part") - 1) / F.col("step")).cast("int"), lambda k: F.when(F.col("part") > 0, F.exists(F.get(blocks, k), lambda c: c == x)).otherwise(F.lit(False)))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    before = F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("guest"))
    last = F.struct(F.lit(ranges - 1).alias("part"), F.lit(2).alias("guest"))
    places = F.filter(F.array(own, F.when(is_cut, before), F.when(x == F.col("top"), last)), lambda p: p.isNotNull())
    dealt = dealt.select(*rows.columns, "place", F.explode(places).alias("at")).select(*rows.columns, "place", "at.part", "at.guest")
    order = Window.partitionBy("part").orderBy("guest", F.col("place").desc(), F.col("text").desc_nulls_last())
    found = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return found.where("guest = 0").select(*rows.columns, *[F.col(f"next.{c}").alias(f"next_{c}") for c in columns])


def likeness(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how near they and the next one are."""
    anchors = choose_anchors(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), signatures(text, anchors).alias("signs"))
    paired = with_next(rows, ["text", "signs"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    changed = paired.select("doc_id", n.cast("long").alias("n_chars"), "signs", "next_signs", edited.alias("edited"))
    signed = changed.select("doc_id", "n_chars", "signs", "next_signs", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited"), anchors).alias("edited_signs"))
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        jaccard(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        jaccard(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and class_id of every document, classes being equal
    fingerprints; and (a, b, likeness) of the classes at or above *threshold*.

    A set of n signatures can only be that like one of threshold * n or more, so lengths
    are dealt into ranges in that ratio and a set meets its own range and the next.
    Two such sets share one of the n - threshold * n + 1 rarest signatures of each, so
    only these are joined; what common signatures would bring together never meets.
    """
    rows = materialize(docs.select("doc_id", signatures(F.col("text"), choose_anchors(docs)).alias("signs")), "spot-rows")
    rows = rows.withColumn("key", F.xxhash64("signs"))
    classes = materialize(rows.groupBy("key", "signs").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows")), "spot-classes")
    members = join_by_key(rows.select("doc_id", "key"), classes.select("key", "class_id", "n_rows"), "key", "n_rows").select("doc_id", "class_id")

    flat = classes.select("key", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    rarity = materialize(flat.groupBy("sign").agg(F.count(F.lit(1)).alias("df")), "spot-rarity")
    order = Window.partitionBy("key").orderBy("df", "sign")
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    rare = join_by_key(flat, rarity.withColumn("_n", F.col("df")), "sign", "_n").withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)
    span = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)))
    rare = materialize(rare.select("key", "n", "sign", span.alias("span")), "spot-rare")
    larger = rare.select(F.col("key").alias("k2"), F.col("n").alias("n2"), "sign", "span")
    smaller = rare.select(F.col("key").alias("k1"), F.col("n").alias("n1"), "sign", F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("span"))
    fits = (F.col("n1") >= F.lit(threshold) * F.col("n2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("k1") < F.col("k2"))))
    meet = smaller.join(larger, ["sign", "span"]).where(fits).select("k1", "k2").distinct()
    one, two = (classes.select(F.col("key").alias(k), F.col("signs").alias(g), F.col("class_id").alias(c)) for k, g, c in (("k1", "g1", "c1"), ("k2", "g2", "c2")))
    compared = meet.join(one, "k1").join(two, "k2").withColumn("likeness", jaccard(F.col("g1"), F.col("g2"))).where(F.col("likeness") >= threshold)
    return members, compared.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), "likeness")


def op3_spotsigs(spark, sf_dir):
    return likeness(read_table(spark, sf_dir, "documents"))
