"""WARC fixity audit with Merkle trees.

Records are laid into files by a hash of their page's id, in the order of that hash, so a
record that is added or lost moves nothing outside its own file. Equal records (same
id, same bytes) lie side by side and are one entry with its number of copies. The ids'
hashes are cut into ranges, which are the leaves of two trees: one hashes what the entries
are (id, length, digest, copies), the other also where they lie (file, offset). So damage
to a record changes one branch of the first tree, and a shift of those after it shows in the
second alone. In a range the entries' hashes are summed in four lanes (an entry's own hash
binds its place in the order), which pre-aggregates a range of any size; FANOUT ranges
that follow each other make a node of the next level, up to one root.

Two replicas are compared from the root: only children of nodes that differ are
looked at, level by level, so intact branches cost nothing below their top. In the ranges
found, entries are matched by id and digest. What is left over on both sides under one id
is ``corrupt``, on ours alone ``missing``, on theirs alone ``extra``; a matched record at
another place is ``moved``, any other ``ok``. Of a record with fewer copies on one side the last ones
are over.

Each level is written once and removed after use. Nothing but numbers of nodes reaches the driver.

Defined results: null urls and pages count as empty; null ids are one id of their own;
rows that repeat are copies of one record, and records of one id with other bytes are entries of their own, in
the order of their digests; texts of any length are hashed whole; an empty table has no tree, so all
records of the other replica are ``missing`` or ``extra``, and two of them give no rows;
columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, discard, join_by_key, materialize, read_table, running

#: Children of a node; records in a leaf's range, and in a file, on average.
FANOUT = 32
LEAF_RECORDS = 16
FILE_RECORDS = 32
HEAD = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ", "\r\nContent-Length: ", "\r\n\r\n")
#: Hex digits of an id's hash that number files and ranges, and their bits.
DIGITS, PLACE_BITS = 12, 48
LANES, LANE_DIGITS = 4, 15
SALTS = 8


def warc_records(pages: DataFrame) -> DataFrame:
    """(id_hash, page_id, sha256, length, copies) of each distinct WARC record of *pages*."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    record = F.concat(F.lit(HEAD[0]), url, F.lit(HEAD[1]), F.octet_length(body).cast("string"), F.lit(HEAD[2]), body, F.lit("\r\n\r\n"))
    named = F.concat(F.lit("id "), F.col("page_id").cast("string"))
    rows = pages.select(F.sha2(F.coalesce(named, F.lit("no id")), 256).alias("id_hash"), "page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"))
    return rows.groupBy("id_hash", "page_id", "sha256", "length").agg(F.count(F.lit(1)).alias("copies"))


def level_bits(n: int, each: int) -> int:
    """Bits that number about n / each ranges, so that all levels of a tree are full."""
    step = int(math.log2(FANOUT))
    return min(PLACE_BITS // step, max(0, math.ceil(math.log2(max(1, n / each)) / step))) * step


def at_bits(bits: int) -> Column:
    place = F.conv(F.substring("id_hash", 1, DIGITS), 16, 10).cast("long")
    return F.shiftright(place, PLACE_BITS - bits)


def laid_out(records: DataFrame, bits: int, file_bits: int, label: str) -> DataFrame:
    """*records* with file (warc), offset of the first copy, and the range of the tree."""
    placed = records.withColumns({"range": at_bits(bits), "warc": at_bits(file_bits)})
    summed = materialize(running(placed, [F.col("id_hash"), F.col("sha256")], label, (), before=F.col("length") * F.col("copies")), label, records)
    starts = summed.groupBy("warc").agg(F.min("before").alias("start"), F.count(F.lit(1)).alias("n"))
    starts = materialize(starts, "fixity-files")
    filed = join_by_key(summed, starts, "warc", "n").withColumn("offset", F.col("before") - F.col("start")).drop("before", "start")
    return materialize(filed, label, summed, starts)


def _lanes(entry: Column) -> list[Column]:
    """Sums that no number of rows overflows, of the parts of the entries' hashes."""
    digits = [F.conv(F.substring(entry, 1 + LANE_DIGITS * k, LANE_DIGITS), 16, 10).cast("decimal(20,0)") for k in range(LANES)]
    return [F.coalesce(F.sum(d), F.lit(0)).cast("string") for d in digits]


def _listed(parts: str, name: str) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["node"], p[name])), "|")


def merkle_tree(records: DataFrame, bits: int) -> list[DataFrame]:
    """Levels of (node, what, where), ranges first (with n, their entries), the root last;
    an empty list without records."""
    entry = F.sha2(F.concat_ws(":", "id_hash", "length", "sha256", "copies"), 256)
    place = F.sha2(F.concat_ws(":", "warc", "offset", "id_hash", "length", "sha256", "copies"), 256)
    hashed = records.select(F.col("range").alias("node"), entry.alias("entry"), place.alias("place"))
    n = F.count(F.lit(1))
    leaves = hashed.groupBy("node").agg(n.alias("n"), *[F.sha2(F.concat_ws(":", n, *_lanes(F.col(c))), 256).alias(to) for c, to in (("entry", "what"), ("place", "where"))])
    levels = [materialize(leaves, "fixity-level")]
    if levels[0].isEmpty():
        return []
    for _ in range(bits // int(math.log2(FANOUT))):
        parts = F.array_sort(F.collect_list(F.struct("node", "what", "where")))  # FANOUT at most
        grouped = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(parts.alias("parts"))
        both = [F.sha2(_listed("parts", c), 256).alias(c) for c in ("what", "where")]
        levels.append(materialize(grouped.select("node", *both), "fixity-level"))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(node, n) of the ranges that differ in what or where, by descent from the roots."""
    suspects = None
    for k in range(len(ours) - 1, -1, -1):
        sides = []
        for level, suffix in ((ours[k], ""), (theirs[k], "_")):
            if suspects is not None:
                above = F.floor(F.col("node") / FANOUT)
                level = level.withColumn("above", above).join(bounded(suspects.select(F.col("node").alias("above"))), "above", "left_semi").drop("above")
            sides.append(level.select("node", *[F.col(c).alias(c + suffix) for c in level.columns if c != "node"]))
        joined = sides[0].join(sides[1], "node", "full")
        same = F.col("what").eqNullSafe(F.col("what_")) & F.col("where").eqNullSafe(F.col("where_"))
        entries = [(F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n")] if k == 0 else []
        found = materialize(joined.where(~same).select("node", *entries), "fixity-differing")
        discard(*([suspects] if suspects is not None else []))
        if k == 0 or found.isEmpty():
            return found
        suspects = found
    raise ValueError("trees have a level at least")


def _marked(records: DataFrame, bad: DataFrame) -> DataFrame:
    """*records* with suspect: whether their range is one of *bad*. Beyond a table that
    can be broadcast, ranges are salted, so that a large one is spread."""
    marks = bad.select(F.col("node").alias("range"), F.lit(True).alias("suspect"))
    if bad.count() <= BROADCAST_ROWS:
        joined = records.join(F.broadcast(marks), "range", "left")
    else:
        salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = records.withColumn("salt", F.pmod(F.hash("sha256"), F.lit(SALTS))).join(salted, ["range", "salt"], "left").drop("salt")
    return joined.withColumn("suspect", F.coalesce("suspect", F.lit(False)))


RECORD = ("id_hash", "page_id", "sha256", "length", "warc", "offset")


def _units(records: DataFrame, first: Column, copies: Column) -> DataFrame:
    """A row for each copy from number *first* on, at its own offset."""
    spread = records.where(copies > first).withColumn("copy", F.explode(F.sequence(first, copies - 1)))
    return spread.withColumn("offset", F.col("offset") + F.col("copy") * F.col("length"))


def judged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The records of the ranges that differ, each copy with its status."""
    side = {s: df.select("id_hash", "sha256", *[F.col(c).alias(c + s) for c in ("page_id", "length", "warc", "offset", "copies")]) for s, df in (("", ours), ("_", theirs))}
    both = materialize(side[""].join(side["_"], ["id_hash", "sha256"], "full"), "fixity-both")
    n, m = F.coalesce("copies", F.lit(0)).cast("long"), F.coalesce("copies_", F.lit(0)).cast("long")
    there = both.select("id_hash", "sha256", *[F.col(c + "_").alias(c) for c in ("page_id", "length", "warc", "offset")], n.alias("n"), m.alias("m"))
    same = (F.col("warc") == F.col("warc_")) & (F.col("offset") == F.col("offset_"))
    here = both.select("id_hash", "sha256", "page_id", "length", "warc", "offset", F.when(same, "ok").otherwise("moved").alias("status"), n.alias("n"), m.alias("m"))
    matched = _units(here, F.lit(0), F.least("n", "m")).select(*RECORD, "status")
    # What is over on either side, numbered under its id.
    over = _units(here, F.col("m"), F.col("n")).select(*RECORD, "copy", F.lit(0).alias("side"))
    over = over.unionByName(_units(there, F.col("n"), F.col("m")).select(*RECORD, "copy", F.lit(1).alias("side")))
    placed = materialize(running(over, [F.col(c) for c in ("id_hash", "side", "sha256", "copy")], "fixity-over", (), at=F.lit(1)), "fixity-over")
    one, two = F.col("side") == 0, F.col("side") == 1
    counts = placed.groupBy("id_hash").agg(
        F.count(F.when(one, 1)).alias("n_ours"), F.count(F.when(two, 1)).alias("n_theirs"), F.min(F.when(one, F.col("at"))).alias("first_ours"), F.min(F.when(two, F.col("at"))).alias("first_theirs"), F.count(F.lit(1)).alias("n")
    )
    counted = join_by_key(placed, materialize(counts, "fixity-counts"), "id_hash", "n")
    paired = F.when(one, F.col("at") - F.col("first_ours") < F.col("n_theirs")).otherwise(F.col("at") - F.col("first_theirs") < F.col("n_ours"))
    status = F.when(paired, F.when(one, "corrupt")).otherwise(F.when(one, "missing").otherwise("extra"))
    return matched.unionByName(counted.select(*RECORD, status.alias("status")).where("status IS NOT NULL"))


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of *pages*, and those that only *replica* has, with place, digest and status."""
    found = [materialize(warc_records(p), "fixity-records") for p in (pages, replica)]
    n = max(f.count() for f in found)
    bits, file_bits = level_bits(n, LEAF_RECORDS), max(0, min(PLACE_BITS, math.ceil(math.log2(max(1, n / FILE_RECORDS)))))
    ours, theirs = (laid_out(f, bits, file_bits, "fixity-laid") for f in found)
    trees = [merkle_tree(r, bits) for r in (ours, theirs)]
    if all(trees):
        bad = differing(*trees)
    else:
        bad = materialize((trees[0] or trees[1])[0].select("node", "n"), "fixity-differing") if any(trees) else None
    discard(*trees[0], *trees[1])
    if bad is None:
        intact, rest = ours.where(F.lit(False)), None
    else:
        mine, other = _marked(ours, bad), _marked(theirs, bad)
        intact = mine.where(~F.col("suspect"))
        rest = judged(mine.where("suspect"), other.where("suspect"))
    rows = _units(intact, F.lit(0), F.col("copies")).select(*RECORD, F.lit("ok").alias("status"))
    rows = rows if rest is None else rows.unionByName(rest)
    return rows.select("page_id", "warc", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("sha256").alias("record_sha256"), "status")


#: The query's replica: of each DAMAGE_EVERY pages by id, one has its first character
#: replaced, one is lost, one is longer, and one stands there a second time under an id of its own.
DAMAGE_EVERY = 97
REPLACED, LOST, LONGER, ADDED = 5, 17, 29, 41


def damaged(pages: DataFrame) -> DataFrame:
    at = F.pmod("page_id", F.lit(DAMAGE_EVERY))
    html = F.when((at == REPLACED) & (F.length("html") > 0), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(at == LONGER, F.concat(F.coalesce("html", F.lit("")), F.lit("!!"))).otherwise(F.col("html"))
    changed = pages.where(F.coalesce(at != LOST, F.lit(True))).withColumn("html", html)
    added = pages.where(at == ADDED).withColumn("page_id", (-F.col("page_id") - 1).cast(pages.schema["page_id"].dataType))
    return changed.unionByName(added)


def op6_merkle_fixity(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


_RECORD_SQL = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

#: States the result without trees: layouts by window functions, statuses by a join on the id.
OP6_SQL = rf"""
WITH theirs AS (
  SELECT page_id, url, CASE WHEN page_id % {DAMAGE_EVERY} = {REPLACED} AND length(html) > 0 THEN '?' || substr(html, 2)
                            WHEN page_id % {DAMAGE_EVERY} = {LONGER} THEN coalesce(html, '') || '!!' ELSE html END AS html
  FROM pages WHERE page_id % {DAMAGE_EVERY} <> {LOST}
  UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % {DAMAGE_EVERY} = {ADDED}),
x AS (SELECT 0 AS side, page_id, {_RECORD_SQL} AS record FROM pages UNION ALL SELECT 1, page_id, {_RECORD_SQL} FROM theirs),
k AS (SELECT greatest(0, ceil(log2(greatest(1, max(c) / {FILE_RECORDS}.0))))::INT AS bits FROM (SELECT count(*) AS c FROM x GROUP BY side)),
p AS (SELECT side, page_id, strlen(record) AS length, sha256(record) AS digest, sha256('id ' || page_id) AS id_hash,
             ('0x' || substr(sha256('id ' || page_id), 1, {DIGITS}))::BIGINT >> ({PLACE_BITS} - k.bits) AS warc FROM x, k),
l AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY side, warc ORDER BY id_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM p)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.warc, b.warc) AS warc, coalesce(a.place, b.place) AS record_offset,
       coalesce(a.length, b.length)::BIGINT AS record_length, coalesce(a.digest, b.digest) AS record_sha256,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt'
            WHEN a.place <> b.place THEN 'moved' ELSE 'ok' END AS status
FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.page_id = b.page_id
"""
