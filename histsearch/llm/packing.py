"""Best-fit packing by length patterns and non-negative least squares.

Documents become token pieces of at most *capacity*; only the histogram of piece
lengths (at most *capacity* rows) reaches the driver. There, patterns of one, two or
three lengths that fill a sequence exactly are fitted to the histogram by
non-negative least squares, their repeat counts are rounded down, and what is left of
the histogram is packed by best fit, in bulk. The plan is a list of segments (length,
first rank, count, first sequence, offset). Pieces are numbered within their length
and look up their segment, so sequences are assigned without moving any text.

Ids are those of ``byte_bpe_50k.json``. They are made with the same vocabulary in its
rank form, which is about five times as fast; a text that holds the special token's
string goes to the first library. Tests hold the two against each other.

Defined results: null and empty texts are one piece with the end id alone; a text of
any length is cut into whole pieces; rows that repeat are packed each by itself, and pieces of
one length are ranked by a hash of their content; an empty table gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_rank, materialize, read_table

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"

_encoders: dict = {}


def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids; loaded once for each Python worker."""
    key = (json_path, ranks_path)
    if key not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole: list = []

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                return fast(text)
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(json_path))
            return whole[0].encode(text, add_special_tokens=False).ids

        _encoders[key] = encode
    return _encoders[key]


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's tokens, end id included."""
    paths = paths or tokenizer_paths()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())]
    )

    def cut(batches):
        encode = encoder(*paths)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            ids_of = batch.column(0)
            for at, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                raw = np.array(ids, dtype="<u4").tobytes()
                first = len(ids) % capacity or capacity
                begin, end, k = 0, first, 0
                while begin < len(ids):
                    doc.append(at)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(raw[4 * begin : 4 * end]))
                    begin, end, k = end, end + capacity, k + 1
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def exact_patterns(lengths: np.ndarray, capacity: int, step: int) -> np.ndarray:
    """Triples of lengths (0: none) that sum to *capacity*: all pairs, and all
    triples in which one length is a multiple of *step*."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    found = []
    a = np.arange(1, capacity // 2 + 1)
    a = a[has[a] & has[capacity - a]]
    found.append(np.stack([np.zeros_like(a), a, capacity - a], 1))
    for b in range(step, capacity, step):
        if has[b]:
            a = np.arange(1, (capacity - b) // 2 + 1)
            a = a[has[a] & has[capacity - b - a]]
            found.append(np.sort(np.stack([np.full_like(a, b), a, capacity - b - a], 1), 1))
    return np.unique(np.concatenate(found), axis=0)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, by accelerated projected
    gradient; A has a 1 for each place of a length in a pattern."""
    if not len(patterns):
        return np.zeros(0)
    size = len(hist)
    target = hist.astype(float).copy()
    target[0] = 0.0

    def forward(x):
        out = np.zeros(size)
        for k in range(patterns.shape[1]):
            out += np.bincount(patterns[:, k], weights=x, minlength=size)
        out[0] = 0.0
        return out

    def backward(r):
        return r[patterns].sum(1)

    probe = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue of A'A, which bounds the step
        probe = backward(forward(probe))
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    pace = 1.0 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - pace * backward(forward(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY, step: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every length of *hist* as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in hist.items():
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity, step)
    repeats = np.floor(fit_counts(patterns, left) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] <= 0:
            break
        items = [int(v) for v in patterns[i] if v]
        n = min(int(repeats[i]), *(int(left[v]) // items.count(v) for v in items))
        if n > 0:
            plan.append((tuple(items), n))
            for v in items:
                left[v] -= n
    # Best fit, longest first. free[r]: groups of open sequences with room r.
    free: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                items, n = free[room].pop()
                used = min(n, todo)
                if n > used:
                    free[room].append([items, n - used])
                rooms[room] = bool(free[room])
                grown = [[items + (length,), used, room - length]]
                todo -= used
            else:
                each = capacity // length
                grown = [[(length,) * each, todo // each, capacity - each * length]]
                if todo % each:
                    grown.append([(length,) * (todo % each), 1, capacity - todo % each * length])
                todo = 0
            for items, n, room in grown:
                if n and room:
                    free[room].append([items, n])
                    rooms[room] = True
                elif n:
                    plan.append((items, n))
    plan += [(items, n) for groups in free.values() for items, n in groups]
    return plan


def segments(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for each place of each pattern."""
    rank: dict[int, int] = defaultdict(int)
    sequence, out = 0, []
    for items, n in plan:
        offset = 0
        for length in items:
            out.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all *docs* with sequence_id and offset.

    The segments come from a histogram of at most *capacity* lengths. Up to SEGMENTS of them
    are broadcast; more would meet the pieces by a shuffle on blocks of ranks.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, capacity, paths), "pack-pieces")
    hist = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most capacity rows
    table = segments(plan_packing(hist, capacity))
    starts, total = {}, 0
    for length in sorted(hist):
        starts[length], total = total, total + hist[length]
    # Ranks over all pieces in order of length; a length's own ranks begin at its start.
    rows = [(length, starts[length] + lo, starts[length] + hi, seq, off) for length, lo, hi, seq, off in table]
    placed = spark.createDataFrame(rows, "seg_length int, lo long, hi long, first long, offset long")
    order = [F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece")]
    ranked = global_rank(made, order, "rank", "pack-ranked")
    at = (F.col("length") == F.col("seg_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    if len(rows) <= SEGMENTS:
        met = ranked.join(F.broadcast(placed), at)
    else:
        blocks = F.explode(F.sequence(F.floor(F.col("lo") / RANK_BLOCK), F.floor((F.col("hi") - 1) / RANK_BLOCK)))
        met = ranked.withColumn("block", F.floor(F.col("rank") / RANK_BLOCK)).join(placed.withColumn("block", blocks), "block").where(at)
    return met.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )


#: Segments grow with the number of distinct lengths and patterns, not with documents.
SEGMENTS = 500_000
#: Pieces that follow each other in rank and meet their segments together, where these aren't broadcast.
RANK_BLOCK = 1024


def op8_pattern_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
