"""Best-fit packing after Martello-Toth dominance reduction.

Documents are token ids and an end id. Those longer than a sequence are cut into full
pieces, whatever is left over being the first piece. How the other pieces are packed
depends on their lengths alone, and there are at most `capacity` different lengths, so
a plan is made on the histogram of lengths (on the driver, of fixed size however many
documents there are) and lists patterns: the lengths in a sequence, and how many
sequences have them.

Reduction, from the longest length down: pieces are fixed for good while a set with them
dominates every alternative: alone, if nothing fits beside it; with the longest one that
fits, if the two fill the sequence, or if no three others fit and no two that fit are
longer together. Those sequences are fixed for good. What remains is
packed by best fit, longest first, into the fullest sequence that has room.

Each piece finds its place by its rank among pieces of its length: ranks are counted in
salted groups, so that a length that many documents have is not one task's work.

Null and empty texts are one piece of length 1 (the end id). Rows with the same or no
doc_id are packed each for itself; of sequences with equal room the one opened or filled last is taken. Empty tables give no rows. Columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import blocks, staged, whole_texts
from .encoding import encoder

CAPACITY, END, SALTS = 2048, 0, 64

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, and in how many


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and the lengths that remain."""
    left = {w: n for w, n in counts.items() if n}
    widths = sorted(left)  # those left, ascending
    fixed: list[Pattern] = []

    def take(pattern: tuple[int, ...], n: int) -> None:
        fixed.append((pattern, n))
        for w in pattern:
            left[w] -= n
        for w in set(pattern):
            if not left[w]:
                del left[w]
                widths.pop(bisect_left(widths, w))

    for w in widths[::-1]:
        while left.get(w):
            room = capacity - w
            at = bisect_left(widths, room + 1) - 1
            if at >= 0 and widths[at] == w and left[w] == 1:
                at -= 1
            if at < 0:  # nothing fits beside it
                take((w,), left[w])
                continue
            other = widths[at]
            # pieces only become fewer, so what holds for one sequence holds until one of the lengths is used up
            if other < room and (_three(widths, left, w) <= room or _two(widths, left, w, room) > other):
                break
            take((w, other), left[w] // 2 if other == w else min(left[w], left[other]))
    return fixed, left


def _two(widths: list[int], left: dict[int, int], w: int, room: int) -> int:
    """The highest total of two pieces that fit in `room` beside one of length w; 0 if none do."""
    best, lo, hi = 0, 0, bisect_left(widths, room + 1) - 1
    free = lambda x: left[x] - (x == w)
    while lo <= hi:
        a, b = widths[lo], widths[hi]
        if not free(b):
            hi -= 1
        elif not free(a):
            lo += 1
        elif a + b > room:
            hi -= 1
        else:
            if lo < hi or free(a) >= 2:
                best = max(best, a + b)
            if free(a) >= 2:
                best = max(best, 2 * a)
            lo += 1
    return best


def _three(widths: list[int], left: dict[int, int], w: int) -> float:
    """The total of the three shortest pieces beside one of length w."""
    total, need = 0, 3
    for x in widths[:4]:
        n = min(need, left[x] - (x == w))
        total, need = total + n * x, need - n
    return total if not need else float("inf")


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each into the fullest sequence with room; equal sequences are handled together."""
    done: list[Pattern] = []
    rooms: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room <= 0:
            done.append((pattern, n))
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((pattern, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):  # no room anywhere: new sequences, each filled with as many as fit
                each = capacity // w
                full, rest = divmod(n, each)
                if full:
                    put((w,) * each, full, capacity - each * w)
                if rest:
                    put((w,) * rest, 1, capacity - rest * w)
                n = 0
                break
            room = rooms[at]
            pattern, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // w, n)
            used = min(many, n // each)
            put(pattern + (w,) * each, used, room - each * w)
            if many > used:
                put(pattern, many - used, room)
            n -= used * each
    return done + [p for x in open_.values() for p in x]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's lower bound L2."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = sum(n for w, n in counts.items() if w > capacity - k)
        mid = {w: n for w, n in counts.items() if capacity / 2 < w <= capacity - k}
        low = sum(w * n for w, n in counts.items() if k <= w <= capacity / 2)
        n = sum(mid.values())
        best = max(best, big + n + max(0, -(-(low - (n * capacity - sum(w * m for w, m in mid.items()))) // capacity)))
    return best


PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's pieces of at most `capacity` ids, in order; path: a tokenizers file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, texts in blocks(batch):
                out = {f.name: [] for f in PIECES}
                for i, tokens in zip(ids, encoder(path).many(texts)):
                    tokens = np.append(tokens, np.uint32(end)).astype("<u4")
                    first = (len(tokens) - 1) % capacity + 1
                    cuts = [0, *range(first, len(tokens) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for name, value in zip(out, (row, i, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()))):
                            out[name].append(value)
                    row += 1
                yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(PIECES))


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`found` (row, piece, length, ...) with sequence_id and offset."""
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counted = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(plan(counted, capacity))
    before = groups.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row", "piece")) - 1
    ranked = salted.withColumn("_in", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        length, rank = length.to_numpy(), rank.to_numpy()
        for w in np.unique(length):
            mine = length == w
            last, first, many, at = slots[int(w)]
            k = np.searchsorted(last, rank[mine], "right")
            sequence[mine] = first[k] + (rank[mine] - (last[k] - many[k]))
            offset[mine] = at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = ranked.withColumn("_at", place("length", "_rank"))
    return at.select(*found.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: up to which rank (exclusive) each slot reaches, its first sequence, how many sequences, the offset in them."""
    lists: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, many in patterns:
        at = 0
        for w in pattern:
            lists.setdefault(w, []).append((sequence, many, at))
            at += w
        sequence += many
    return {w: (np.cumsum([m for _, m, _ in x]), np.array([s for s, _, _ in x]), np.array([m for _, m, _ in x]), np.array([a for _, _, a in x])) for w, x in lists.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = staged(pieces(docs, path, capacity, end))
    return placed(found, capacity).drop("row")
