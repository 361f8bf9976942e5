"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases' names into longer phrases
and so on. Where a phrase begins is decided by deterministic coin tossing: each symbol
is compared with its left neighbour and reduced to (lowest differing bit, its value),
four times over, after which a symbol is one of six labels, differs from its neighbour
and depends on few symbols to its left; phrases begin at local maxima. Runs of one
symbol are made one symbol first. So equal substrings are parsed alike but for a
bounded stretch at either end, at any offset.

A fingerprint holds the `KEPT` lowest names of phrases from level `LEVEL` on, with the
name of the whole text; likeness is the Dice coefficient 2J / (1 + J) of the Jaccard
index J that two fingerprints' lowest common names estimate.

Null texts count as empty. The next document is the one before it by doc_id; rows with
equal doc_id follow each other by text, those without one come last. Empty tables give
no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import words as W
from .common import blocks, whole_texts
from .spans import sha256

LEVEL, KEPT, TOSSES, HIGHEST = 2, 64, 4, 40
#: Code points in one range of documents, and in what is parsed at once, about.
RANGE_CHARS, BLOCK = 8_000_000, 400_000
#: Ranges at most, however many documents there are: all that the driver holds. Ranges are sorted with spilling and parsed in blocks.
RANGES = 20_000


def _coin_tosses(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols none of which equals its left neighbour; fresh: begins a text."""
    for _ in range(TOSSES):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[fresh] = ~x[fresh]  # as if the neighbour differed in the lowest bit
        differ = x ^ left
        lowest = differ & (~differ + x.dtype.type(1))
        bit = np.bitwise_count(lowest - x.dtype.type(1))
        x = (2 * bit + ((x & lowest) != 0)).astype(np.uint8)
    return x


def _parse(x: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases that symbols x are parsed into, and their texts."""
    new_doc = np.empty(len(x), bool)
    new_doc[0] = True
    np.not_equal(doc[1:], doc[:-1], out=new_doc[1:])
    begins = new_doc.copy()
    begins[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(begins)
    if len(first) < len(x):  # runs of one symbol
        n = np.diff(first, append=len(x))
        x, doc, new_doc = x[first], doc[first], new_doc[first]
        runs = np.flatnonzero(n > 1)
        x = x.astype(np.uint64)
        x[runs] = W.mixed(x[runs] ^ W.mixed(n[runs].astype(np.uint64)))
        again = np.flatnonzero((x[1:] == x[:-1]) & ~new_doc[1:]) + 1
        x[again] += np.uint64(1)
    label = _coin_tosses(x, new_doc)
    landmark = new_doc.copy()
    if len(x) > 2:
        peak = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        landmark[1:-1] |= peak & ~new_doc[1:-1] & ~new_doc[2:]
    at = np.flatnonzero(landmark)
    names = W.slice_hashes(x, at, np.append(at[1:], len(x)))
    return names ^ W.mixed(np.full(1, level, np.uint64)), doc[at]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The KEPT lowest names of each text, ascending, as unsigned 32-bit numbers."""
    points, starts = W.code_points(texts)
    inside = points != W.BREAK_POINT
    doc = np.repeat(np.arange(len(texts)), np.diff(starts, append=len(points)) - 1) if len(texts) else starts
    x = points[inside]
    names, of = [], []
    for level in range(1, HIGHEST):
        if not len(x):
            break
        x, doc = _parse(x, doc, level)
        alone = np.bincount(doc, minlength=len(texts))[doc] == 1  # the name of a whole text
        if level >= LEVEL:
            names.append(x)
            of.append(doc)
        else:
            names.append(x[alone])
            of.append(doc[alone])
        x, doc = x[~alone], doc[~alone]
    if not names:
        return [np.zeros(0, np.uint32) for _ in texts]
    name, of_ = (W.mixed(np.concatenate(names)) >> np.uint64(32)), np.concatenate(of).astype(np.uint64)
    both = np.sort(of_ << np.uint64(32) | name)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    cut = np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(a + KEPT, b)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two fingerprints, 0 to 1; 1 for equal ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    one, two = set(a.tolist()), set(b.tolist())
    # a fingerprint of fewer than KEPT names has them all; of others nothing is known above the highest
    end = min((int(x[-1]) for x in (a, b) if len(x) == KEPT), default=1 << 32)
    lowest = sorted(x for x in one | two if x <= end)[: KEPT if len(a) == len(b) == KEPT else None]
    shared = one & two
    j = sum(x in shared for x in lowest) / len(lowest)
    return 2 * j / (1 + j)


def written(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    """Rows of consecutive documents; following: the text after the last."""
    edited = []
    for text, after in zip(texts, [*texts[1:], following]):
        third = len(text) // 3
        edited.append(text[: len(text) - third] + after[:third])
    prints = fingerprints([*texts, following])
    changed = fingerprints(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [sha256(t) for t in edited], "fingerprint": [written(x) for x in prints[:-1]], "edited_fingerprint": [written(x) for x in changed],
            "near_edited": [likeness(a, b) for a, b in zip(prints, changed)], "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:])],
        }, schema=SCHEMA)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range and place in it; the last row of a range is the first document of the next one."""
    held_ids, held_texts, held_range, chars = [], [], None, 0
    for batch in batches:
        ranges = batch.column("range").to_pylist()
        at = 0
        for ids, texts in blocks(batch.select(["doc_id", "text"]), BLOCK):
            for i, t in zip(ids, texts):
                if ranges[at] != held_range:  # what is held is the one row that shows what follows
                    held_ids, held_texts, held_range, chars = [], [], ranges[at], 0
                held_ids.append(i)
                held_texts.append(t)
                chars += len(t)
                at += 1
                last = at == len(ranges) or ranges[at] != held_range
                if len(held_texts) > 1 and (last or chars > BLOCK):
                    yield _rows(held_ids[:-1], held_texts[:-1], held_texts[-1])
                    held_ids, held_texts, chars = held_ids[-1:], held_texts[-1:], len(held_texts[-1])


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike they and the next document's are.

    The documents are dealt into ranges of doc_id (bounds: approximate quantiles, one for
    about RANGE_CHARS code points, RANGES at most); the first document of each range is sent to
    the range before as well. Only bounds and the ranges' highest doc_id come to the driver.
    """
    rows = whole_texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(RANGES, max(1, round(chars / RANGE_CHARS)))
    bounds = np.array(sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.1 / n)}), np.int64) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key.to_numpy(), "left")).astype(np.int32))

    tops = rows.select("key").withColumn("range", range_of("key")).groupBy("range").agg(F.max("key").alias("top")).orderBy("range").collect()
    order = [r["range"] for r in tops]
    before = {r["top"]: order[i - 1] for i, r in enumerate(tops)}

    @F.pandas_udf("int")
    def shown_in(key: pd.Series) -> pd.Series:
        return key.map(before).astype("Int32")

    placed = rows.withColumn("range", range_of("key")).withColumn("shown", shown_in("key"))
    pairs = F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("last")), F.struct(F.col("shown").alias("range"), F.lit(True).alias("last"))), lambda x: x["range"].isNotNull())
    dealt = placed.select("doc_id", "text", "key", F.inline(pairs))
    # of several rows with the highest doc_id of a range, those after the first stay out of the way behind it
    return (
        dealt.repartition(max(1, len(order)), "range").sortWithinPartitions("range", "last", F.desc("key"), "text")
        .select("doc_id", "text", F.expr("cast(range as int)").alias("range"), "last").mapInArrow(_shown_once, from_arrow_schema(SCHEMA))
    )


def _shown_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = [None]

    def kept(source):
        for b in source:
            keep = []
            for r, last in zip(b.column("range").to_pylist(), b.column("last").to_pylist()):
                keep.append(not last or seen[0] != r)
                if last:
                    seen[0] = r
            yield b.filter(pa.array(keep))

    return _in_order(kept(batches))
