"""Mixing sources to target weights by hash-threshold histograms (native).

Every document has a fixed place in [0, 2^120): 60 bits of a hash of its id and
text, then 60 bits that only part rows which are equal in both. A source's budget
becomes a threshold on that place. Words are summed by source and by the first ten
bits; the bucket in which the running sum passes the budget is the boundary, and
only its rows are summed again by the next ten bits, until one row is left. The mix
is then a filter on the place: no rows are sorted, and only histograms
(at most 1024 rows for each source) are shuffled.

Defined results: null text and texts without words have size 0 and are kept once
where a full pass of their source is taken; a null source is a source of its own,
ordered last; rows that repeat are separate rows, and rows at one place are parted by the
second 60 bits; very long texts are counted whole; an empty table gives no rows;
columns other than doc_id, text and source play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, join_by_key, materialize, n_words, read_table

BITS = 10
LEVELS = 6


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), budget: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """*sizes* (source, source_size, n) with each source's target.

    Sources in code-point order, null last, weigh *weights*, repeating. They share
    *budget* times all words by weight; a target stops at *epochs* times its source,
    and the excess is shared again by weight until no target is above. The shares
    are ``least(weight * level, epochs * size)`` for one level, found in a few
    rounds of one-row aggregates; no source is collected.
    """
    ranked = global_rank(sizes.select("source", "source_size", "n"), [F.col("source").asc_nulls_last()], "place", "mix-places")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialize(ranked.select("source", "source_size", "n", weight.alias("weight")), "mix-sources")
    limit = F.col("source_size") * F.lit(float(epochs))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        rest, weight = weighed.agg(
            F.lit(budget * total) - F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        reached = rest / weight if weight > 0 else level
        if weight <= 0 or reached <= level:
            break
        level = reached
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def _digit(level: int):
    column = F.col("pos") if level < LEVELS else F.col("tie")
    return F.shiftright(column, (LEVELS - 1 - level % LEVELS) * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def mix_sources(docs: DataFrame, weights=(3.0, 1.0, 2.0), budget: float = 1.5, epochs: float = 2.0, columns: list[str] | None = None, aliases: list[str] | None = None) -> DataFrame:
    """Rows of *docs* as (doc_id, *columns* under their *aliases*, size, source_size,
    target, copies): how often the mix takes each document, 0 included."""
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns or [])]
    placed = docs.select(
        F.col("doc_id"),
        F.col("source"),
        n_words(F.col("text")).alias("size"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 4).alias("pos"),
        *kept,
    ).withColumn("tie", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4))
    base = materialize(placed, "mix-rows")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, weights, budget, epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = materialize(
        targets.select(
            "source",
            "n",
            "source_size",
            "target",
            passes.cast("int").alias("passes"),
            (F.col("target") - passes * F.col("source_size")).alias("need"),
            F.lit(0).cast("long").alias("cut_pos"),
            F.lit(0).cast("long").alias("cut_tie"),
            F.lit(0).alias("depth"),
            F.lit(False).alias("inclusive"),
            (F.col("target") - passes * F.col("source_size") <= 0).alias("done"),
        ),
        "mix-state",
    )
    for level in range(2 * LEVELS):
        if state.where(~F.col("done")).isEmpty():
            break
        state = materialize(_refine(base, state, level), "mix-state", state)

    p = F.expr(f"shiftright(pos, {BITS} * greatest({LEVELS} - depth, 0))")
    t = F.expr(f"shiftright(tie, {BITS} * greatest({2 * LEVELS} - depth, 0))")
    at_tie = F.when(F.col("depth") <= LEVELS, F.col("inclusive")).otherwise((t < F.col("cut_tie")) | ((t == F.col("cut_tie")) & F.col("inclusive")))
    taken = F.when(F.col("depth") == 0, F.lit(False)).otherwise((p < F.col("cut_pos")) | ((p == F.col("cut_pos")) & at_tie))
    known = state.select("source", "n", "source_size", "target", "passes", "depth", "inclusive", "cut_pos", "cut_tie")
    return join_by_key(base, known, "source", "n").select(
        "doc_id",
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(aliases or columns or [])],
        "size",
        "source_size",
        "target",
        (F.col("passes") + taken.cast("int")).alias("copies"),
    )


def _refine(base: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One level: histograms of the rows still at the boundary, and the new boundary."""
    open_ = state.where(~F.col("done")).select("source", "n", "need", "cut_pos", "cut_tie")
    at = join_by_key(base.select("source", "size", "pos", "tie"), open_, "source", "n")
    if 0 < level < LEVELS:
        at = at.where(F.shiftright("pos", BITS * (LEVELS - level)) == F.col("cut_pos"))
    elif level >= LEVELS:
        at = at.where((F.col("pos") == F.col("cut_pos")) & (F.shiftright("tie", BITS * (2 * LEVELS - level)) == F.col("cut_tie")))
    hist = at.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("digit")
    summed = hist.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    # The first bucket whose end passes the budget; the very last one if rounding hides it.
    edge = summed.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min(F.struct("digit", "before", "words", "rows")).alias("edge"))
    left = F.col("need") - F.col("edge.before")
    alone = (F.col("edge.rows") <= 1) | F.lit(level == 2 * LEVELS - 1)
    step = edge.select(F.col("source").alias("of"), "edge")
    joined = state.join(step, F.col("source").eqNullSafe(F.col("of")), "left")  # a row for each source on either side
    moved = F.col("edge").isNotNull() & ~F.col("done")
    cut = "cut_pos" if level < LEVELS else "cut_tie"
    grown = F.when(moved, F.col(cut) * (1 << BITS) + F.col("edge.digit")).otherwise(F.when(F.col("done"), F.col(cut)).otherwise((F.col(cut) + 1) * (1 << BITS)))
    columns = {cut: grown, "depth": F.when(F.col("done"), F.col("depth")).otherwise(F.lit(level + 1))}
    return joined.select(
        "source",
        "n",
        "source_size",
        "target",
        "passes",
        F.when(moved, left).otherwise(F.lit(0.0)).alias("need"),
        *[columns.get(c, F.col(c)).alias(c) for c in ("cut_pos", "cut_tie", "depth")],
        F.when(F.col("done"), F.col("inclusive")).otherwise(F.coalesce(moved & alone & (F.col("edge.words") <= 2 * left), F.lit(False))).alias("inclusive"),
        (F.col("done") | ~moved | alone | (left <= 0)).alias("done"),
    )


def op10_hash_threshold_mix(spark, sf_dir):
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
