"""Sharding by a consistent-hash ring with bounded loads (native).

Each shard has VNODES places on a ring of 2^63 positions; a document belongs to the
first place at or after the hash of its id, that is to an arc. Bounds on the
shards' counts add up to all rows and differ by one at most, so counts are exact
(law ``rows``). Every shard first takes the documents of its own arcs, in
ring order, up to its bound; the others go on clockwise, arc by arc, to the next
shard with room. Since arcs are ranges of positions, this is settled on the arcs'
counts alone (VNODES for each shard, on the driver) and gives segments: ranks of an arc,
shard, first slot. Documents look up their segment by their rank on the ring, which
is found by ranges (``global_rank``), without a task that sees them all.

Only documents beyond a full shard's bound leave their home, so a change of the
shards or rows moves few others; ``home_shard`` shows where the plain ring has them.

Defined results: null text has size 1 and the checksum of no bytes; a null id hashes
as any value; rows that repeat, also thousands with one id, are ranked by their
content and then dealt by their place in the written table; an empty table gives no rows;
columns other than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, read_table

VNODES = 128
SHARDS = 8


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; shards * vnodes rows."""
    nodes = spark.range(shards * vnodes).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), 1).alias("position"), (F.col("id") % shards).cast("int").alias("shard")
    )
    return sorted((r[0], r[1]) for r in nodes.collect())


def assign(nodes: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank in the arc, count, shard, first slot) for the arcs'
    *counts*; together they hold every shard to its bound."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def give(arc: int, start: int, n: int, shard: int) -> None:
        out.append((arc, start, n, shard, used[shard]))
        used[shard] += n

    beyond = []  # (arc, first rank, count) without room at home
    for arc, n in enumerate(counts):
        shard = nodes[arc][1]
        own = min(n, room[shard] - used[shard])
        if own:
            give(arc, 0, own, shard)
        if n > own:
            beyond.append([arc, own, n - own])
    for arc, start, n in beyond:
        at = arc
        while n:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            more = min(n, room[shard] - used[shard])
            if more:
                give(arc, start, more, shard)
                start, n = start + more, n - more
    return out


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, as SQL values."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(doc_id, size, text_crc32, home_shard, shard, slot) for every row of *docs*.

    What is broadcast is bounded by the ring: a segment for each virtual node and two
    for each shard at most, whatever the number of rows.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, vnodes)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col("doc_id")), 1).alias("position"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col(c) for c in ("position", "doc_id", "text_crc32", "size", "place")]
    ranked = global_rank(rows, order, "rank", "shard-rows")
    # Positions past the last node belong to the first one: they are the ring's arc 0
    # as well, counted apart as arc len(nodes).
    bounds = [p for p, _ in nodes]
    steps = [bounds[i : i + vnodes] for i in range(0, len(bounds), vnodes)]
    tops = F.array(*[F.lit(s[-1]) for s in steps])
    block = F.size(F.filter(tops, lambda t: t < F.col("position")))
    table = F.array(*[F.array(*[F.lit(p) for p in s]) for s in steps])
    inner = F.size(F.filter(F.get(table, F.col("block")), lambda t: t < F.col("position")))
    arced = ranked.withColumn("block", block).withColumn("arc", F.when(F.col("block") >= len(steps), F.lit(len(nodes))).otherwise(F.col("block") * vnodes + inner))
    counts = {r[0]: r[1] for r in arced.groupBy("arc").count().collect()}
    arcs = [*nodes, nodes[0]]
    of_arc = [counts.get(a, 0) for a in range(len(arcs))]
    if not sum(of_arc):
        segments = []
    else:
        segments = assign(arcs, of_arc, shards)
    before, total = [], 0
    for n in of_arc:
        before.append(total)
        total += n
    table_rows = [(arc, before[arc] + start, before[arc] + start + n, shard, slot, arcs[arc][1]) for arc, start, n, shard, slot in segments] or [(-1, 0, 0, 0, 0, 0)]
    placed = literal_table(spark, ["seg_arc", "lo", "hi", "to_shard", "first", "home"], table_rows)
    here = (F.col("arc") == F.col("seg_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return arced.join(F.broadcast(placed), here).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("home").cast("int").alias("home_shard"),
        F.col("to_shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
    )


def op2_bounded_ring(spark, sf_dir):
    placed = shard_rows(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
