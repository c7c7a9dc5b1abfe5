"""What the training-data operators share: reading, cutting lineage, hot keys, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.written import discard, materialize

__all__ = ["discard", "materialize"]  # for the operators, which take them from here

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: A table is broadcast only up to this many (narrow) rows, after they are counted.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """*df* with a broadcast hint if it has at most BROADCAST_ROWS rows (*rows*,
    if the caller has counted them), else as it is, to be joined by a shuffle."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: A key with so many rows is hot, or with a BROADCAST_ROWS-th of all rows if that is more.
HOT_ROWS = 1000


def fresh(columns: list[str], *names: str) -> list[str]:
    """*names*, lengthened until they clash with none of *columns* (without regard to case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def join_by_key(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """*rows* with what *table* (written already, one row for each key, *n* rows of each)
    knows of their key, null keys included. A small table is broadcast. Beyond that, hot
    keys' rows stay where they are: fewer than BROADCAST_ROWS keys can be hot, by their
    definition, so these are broadcast; the others meet by a shuffle in which no key is large."""
    count, total = table.agg(F.count(F.lit(1)), F.sum(n)).first()
    (own,) = fresh([*rows.columns, *table.columns], "own_key")
    named = table.drop(n).withColumnRenamed(key, own)

    def near(part: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(part), rows[key].eqNullSafe(part[own])).drop(own)

    if count <= BROADCAST_ROWS:
        return near(named)
    most = max(HOT_ROWS, -(-(total or 0) // BROADCAST_ROWS))
    is_hot = (F.col(n) > most) | F.col(key).isNull()
    hot, cold = table.where(is_hot), table.where(~is_hot).drop(n)
    known = rows.where(F.col(key).isNotNull())
    if hot.isEmpty():
        return known.join(cold, key).select(*rows.columns, *[c for c in cold.columns if c != key])
    meet = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near(hot.drop(n).withColumnRenamed(key, own)).unionByName(meet)


def n_words(text: Column) -> Column:
    """Words of the whole text (null: 0)."""
    blanked = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    trimmed = F.trim(blanked)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def words(text: Column) -> Column:
    """Array of the words of the whole text (null: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind *value* once for *body*: inside a lambda an outer expression would be
    evaluated again for every element, a lambda variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of *docs* in one struct, so that no name of ours meets one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """Two numbers, never null, that tell documents apart by id and text."""
    return [F.xxhash64(doc_id).alias("id_key"), text_hash.alias("text_key")]


def only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One of the rows of *docs*, all columns, for each (id_key, text_key) of *keep*.
    Texts are shuffled once: the join and the choice among equal rows need the same partitions."""
    keyed = docs.select(whole_row(docs), *row_key(docs["doc_id"], F.xxhash64(docs["text"])))
    kept = keyed.join(keep, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def running(df: DataFrame, order: list[Column], label: str, spent: tuple = (), **sums: Column) -> DataFrame:
    """*df* with, for each name in *sums*, the sum of its values over the rows before each
    row in *order* (of ones: the row's number from 0), without a single task that sees them all.

    The rows are written once, dealt out by ranges of *order*; each range is summed on
    its own and starts where the ranges before it end. *order* should tell rows apart,
    so that no range grows with one key. The table of ranges that is broadcast has one row
    for each shuffle partition."""
    part, *marks = fresh([*df.columns, *sums], "range_", *[f"{s}_before_" for s in sums])
    values = fresh([*df.columns, *sums, part, *marks], *[f"{s}_value_" for s in sums])
    valued = df.select("*", *[c.cast("long").alias(v) for v, c in zip(values, sums.values())])
    dealt = materialize(valued.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), label, *spent)
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(m) for v, m in zip(values, marks)])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(starts), part)
    return found.select(*df.columns, *[(F.col(m) + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(s) for s, v, m in zip(sums, values, marks)])


def global_rank(df: DataFrame, order: list[Column], rank: str, label: str) -> DataFrame:
    """The rows of *df*, numbered from 0 in *order*, gapless (see :func:`running`)."""
    return running(df, order, label, (), **{rank: F.lit(1)})
