"""Substring dedup by hashing of lines and the sentences in them.

A unit is a line, or a part of it that ends at a sentence's end or before a
capital letter and has at least UNIT_WORDS words. So a passage that is set into the
middle of a line of another text still yields its own units. Units are
normalised (lower case, single spaces), their 128-bit digests are grouped globally,
and the earliest occurrence by (doc_id, unit) stays. Later ones go where a run of
adjacent repeated units has at least MIN_WORDS words; a lone shorter unit, such as a heading
of one word, stays. Kept parts carry their offsets in the original text.

Defined results: a null text stays null with no units; null ids rank last; rows equal
in id and text count as one occurrence and have one result; texts of any length are
read whole; an empty table gives no rows; other columns are passed on by
``drop_repeated_lines`` and play no part.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, materialize, read_table, row_key, whole_row

UNIT_WORDS = 4
MIN_WORDS = 5
CAPITALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Lu")
BORDER = re.compile(r"\n|[.!?…][ \t]+(?=\S)|[ \t](?=[%s])" % re.escape(CAPITALS))


def units(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the units, which together are the whole text."""
    out, start, words, upto = [], 0, [], 0
    for at in [m.end() for m in BORDER.finditer(text)] + [len(text)]:
        words += text[upto:at].split()
        upto = at
        if at > start and (len(words) >= unit_words or at == len(text) or text[at - 1] == "\n"):
            out.append((start, at, words))
            start, words = at, []
    return out


def digest(words: list[str]) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(" ".join(words).lower().encode("utf-8"))


#: So many texts are cut into units at a time, which bounds a worker's memory.
SLICE = 256


def unit_digests(batches, unit_words: int = UNIT_WORDS):
    """A row for each unit that has words, numbered within its text."""
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        row, index, starts, ends, sizes, digests = [], [], [], [], [], []
        for at, text in enumerate(batch.column(2)):
            found = [u for u in units(text.as_py() or "", unit_words) if u[2]]
            row += [at] * len(found)
            index += range(len(found))
            for start, end, words in found:
                starts.append(start)
                ends.append(end)
                sizes.append(len(words))
                digests.append(digest(words))
        if row:
            at = pa.array(row, pa.int64())
            numbers = [pa.array(x, pa.int32()) for x in (index, starts, ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array(digests, pa.binary())], names=["doc_id", "hash", "unit", "start", "end", "size", "digest"])


def kept_spans(length: int, repeated: list[tuple[int, int, int, int]], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans of a text of *length* that stay, given (unit, start, end, words) of the
    units that occurred earlier: runs of neighbours with *min_words* words or more go."""
    runs: list[list[int]] = []
    for unit, start, end, n in sorted(repeated):
        if runs and runs[-1][0] == unit - 1:
            runs[-1] = [unit, runs[-1][1], end, runs[-1][3] + n]
        else:
            runs.append([unit, start, end, n])
    spans, at = [], 0
    for _, start, end, n in runs:
        if n >= min_words:
            if start > at:
                spans.append((at, start))
            at = end
    return spans + [(at, length)] if at < length else spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kept", SPANS)])


@F.pandas_udf(RESULT)
def clean(texts: pd.Series, repeated: pd.Series, min_words: pd.Series) -> pd.DataFrame:
    rows = []
    for text, again, least in zip(texts, repeated, min_words):
        if again is None or text is None:
            spans = [(0, len(text))] if text else []
        else:
            spans = kept_spans(len(text), [(u["unit"], u["start"], u["end"], u["size"]) for u in again], least)
            text = "".join(text[s:e] for s, e in spans)
        rows.append((text, [{"start": s, "end": e} for s, e in spans]))
    return pd.DataFrame(rows, columns=["text", "kept"])


def repeated_units(docs: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(id_key, text_key, units): for each document the units that occurred earlier."""
    int_, id_type = T.IntegerType(), docs.schema["doc_id"].dataType
    kinds = {"doc_id": id_type, "hash": T.LongType(), "unit": int_, "start": int_, "end": int_, "size": int_, "digest": T.BinaryType()}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    cut = partial(unit_digests, unit_words=unit_words)
    found = materialize(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(cut, schema), "lines-units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "unit")
    first = materialize(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "lines-first")
    later = join_by_key(found, first, "digest", "n").where(~F.col("first").eqNullSafe(place))
    keyed = later.groupBy(*row_key(F.col("doc_id"), F.col("hash"))).agg(F.collect_set(F.struct("unit", "start", "end", "size")).alias("units"))
    return materialize(keyed, "lines-repeated", found, first)


def drop_repeated_lines(docs: DataFrame, details: bool = False, min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """*docs* with the repeated units taken out of the text; with *details* also
    kept (spans of the original text, in code points) and n_repeated (units that
    occurred earlier). With *min_words* and *unit_words* of 1 every repeated unit goes, however short."""
    again = repeated_units(docs, unit_words)
    rows = docs.select(whole_row(docs), *row_key(docs["doc_id"], F.xxhash64(docs["text"])))
    joined = rows.join(again, ["id_key", "text_key"], "left").withColumn("clean", clean("row.text", "units", F.lit(min_words)))
    more = [F.col("clean.kept").alias("kept"), F.coalesce(F.size("units"), F.lit(0)).alias("n_repeated")] if details else []
    own = [F.col("clean.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*own, *more)


def op9_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, details=True).withColumn("n_kept_chars", F.length("text").cast("long"))
