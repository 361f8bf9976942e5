"""Personal data, and the terms around it that give it away (information-theoretic sanitisation).

Patterns find e-mail and IP addresses, payment cards and telephone numbers. Each
distinct value is an entity to protect. A term in a document with an entity, however far
from it, discloses it to the degree PMI(term; entity) / IC(entity), where the probabilities
are shares of documents, over the whole corpus (n(t, e): documents that hold both):

    PMI = log2(n(t, e) * N / (n(t) * n(e)))     IC = log2(N / n(e))

Terms from `GENERALISE` on are to be replaced by their kind, from `REMOVE` on to be
taken out, at every occurrence in documents that hold the entity; both only where at least
`SUPPORT` different contexts show the pair, so that copies of one text are no evidence. A context
is the `WINDOW` words on either side of the entity; a term that is in none of a document's is
shown by the first. Plain spans are never dropped.

Only entities with SUPPORT contexts can be disclosed, so the texts are read again for those
alone, then for the counts of candidate terms, then for the places of disclosing terms. What is
looked for goes to the executors as bitmaps of fixed size (BITS), which let some others pass;
the joins afterwards are exact.

Null and empty texts have no spans; a doc_id may be null or repeated, each row gets
its own result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import words as W
from .common import blocks, staged, whole_texts
from .spans import Span, joined, sha256

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE = 12, 3, 0.8, 0.95
BITS = 1 << 22
#: Terms whose counts a task holds.
AT_ONCE = 1 << 18
PLACE = {"removed": "", "generalised": "[term]"} | {k: f"[{k}]" for k in KINDS}

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards and forwards, which is linear where a search for the whole pattern is quadratic in a long word."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time along each chain of numbers joined by dots."""
    for m in NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts = [*re.finditer("[0-9]+", m[0])]
            for k in range(0, len(parts) - 3, 4):
                if all(len(v := p[0].lstrip("0")) <= 3 and int(v or 0) <= 255 for p in parts[k : k + 4]):
                    yield m.start() + parts[k].start(), m.start() + parts[k + 3].end()


def _luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    out += (("ip", *s) for s in _ips(text))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += (("phone", *m.span()) for m in DIALLED.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15)
    return out


def folded(points: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and Latin-1 as small letters; places stay as they are."""
    big = (points >= 65) & (points <= 90) | (points >= 192) & (points <= 222) & (points != 215)
    return points + np.uint32(32) * big


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of three letters or more: hash, text they belong to, start in that text, end."""
    r = W.runs(texts)
    keep = (r.kinds == W.LETTER) & (r.ends - r.starts >= 3)
    starts, ends, doc = r.starts[keep], r.ends[keep], r.doc[keep]
    begin = np.concatenate([[0], np.flatnonzero(r.points == W.BREAK_POINT) + 1])[doc] if len(doc) else doc
    return W.slice_hashes(folded(r.points), starts, ends).view(np.int64), doc, starts - begin, ends - begin


def _value(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind == 'email' else re.sub('[^0-9.]', '', text)}"


def _entity(kind: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(_value(kind, text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _set(marked: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whose bits are set in a bitmap?"""
    bit = h.view(np.uint64) % np.uint64(BITS)
    return (marked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


Place = tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # entity, context, words near it; hash, start and end of all words


def _scanned(batch: pa.RecordBatch, entities: np.ndarray | None) -> Iterator[tuple[list, list[list[Span]], dict[int, list[Place]]]]:
    """Blocks of doc ids, plain spans, and for texts with an entity that is marked (None: any), by its place in the block:
    entity and context of each, and all words outside personal data (hash, start, end)."""
    for ids, texts in blocks(batch):
        spans = [base_spans(t) for t in texts]
        held = [[(_entity(k, t[s:e]), s) for k, s, e in x] for t, x in zip(texts, spans)]
        if entities is not None:
            held = [[h for h in x if _set(entities, np.array([h[0]], np.int64))[0]] for x in held]
        some, out = [i for i, x in enumerate(held) if x], {}
        if some:
            hashes, doc, starts, ends = terms([texts[i] for i in some])
            cut = np.searchsorted(doc, np.arange(len(some) + 1))
            for k, i in enumerate(some):
                mine = slice(cut[k], cut[k + 1])
                out[i] = _places(spans[i], held[i], hashes[mine], starts[mine], ends[mine])
        yield ids, spans, out


def _places(spans: list[Span], held: list[tuple[int, int]], hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[Place]:
    inside = np.zeros(len(starts), bool)  # words that are part of personal data themselves
    for _, s, e in spans:
        inside[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = True
    hashes, starts, ends = hashes[~inside], starts[~inside], ends[~inside]
    out = []
    for entity, s in held:
        at = int(np.searchsorted(starts, s))
        near = hashes[max(0, at - WINDOW) : at + WINDOW]
        context = int(W.mixed(np.cumsum(W.mixed(near.view(np.uint64)))[-1:]).view(np.int64)[0]) if len(near) else 0
        out.append((entity, context, near, hashes, starts, ends))
    return out


ENTITIES = pa.schema([("entity", pa.int64()), ("context", pa.int64()), ("once", pa.int64())])


def _entities(docs: DataFrame) -> DataFrame:
    """(entity, context, once: 1 in one row of each document that holds the entity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, places in _scanned(batch, None):
                for x in places.values():
                    seen = set()
                    for entity, context in dict.fromkeys(p[:2] for p in x):
                        rows.append((entity, context, int(entity not in seen)))
                        seen.add(entity)
            yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(ENTITIES)}, schema=ENTITIES)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(ENTITIES))


EVIDENCE = pa.schema([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("once", pa.int64())])


def _evidence(docs: DataFrame, entities: np.ndarray) -> DataFrame:
    """(entity, term, context, once: 1 in one row of each document that holds both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, places in _scanned(batch, entities):
                for x in places.values():
                    yield from map(_shown, _by_entity(x).items())

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(EVIDENCE))


def _by_entity(places: list[Place]) -> dict[int, list[Place]]:
    out: dict[int, list[Place]] = {}
    for p in places:
        out.setdefault(p[0], []).append(p)
    return out


def _shown(item: tuple[int, list[Place]]) -> pa.RecordBatch:
    entity, places = item
    near: dict[int, np.ndarray] = {}
    for _, context, close, *_ in places:
        near.setdefault(context, np.unique(close))
    far = np.setdiff1d(places[0][3], np.concatenate([*near.values()]))
    term = np.concatenate([*near.values(), far])
    context = np.repeat(np.array([*near, places[0][1]], np.int64), [*map(len, near.values()), len(far)])
    once = np.zeros(len(term), np.int64)
    once[np.unique(term, return_index=True)[1]] = 1
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(term), entity, np.int64)), pa.array(term), pa.array(context), pa.array(once)], schema=EVIDENCE)


AROUND = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("around", pa.list_(AROUND))])


def _found(docs: DataFrame, entities: np.ndarray, marked: np.ndarray) -> DataFrame:
    """Plain spans of each document, and every place of terms that may disclose an entity it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, spans, places in _scanned(batch, entities):
                around: list[list[dict]] = [[] for _ in ids]
                for i, x in places.items():
                    _, _, _, hashes, starts, ends = x[0]
                    told = _set(marked, hashes)
                    words = [*zip(hashes[told].tolist(), starts[told].tolist(), ends[told].tolist())]
                    around[i] = [{"entity": e, "term": h, "start": a, "end": b} for e in dict.fromkeys(p[0] for p in x) for h, a, b in words]
                yield pa.RecordBatch.from_pydict(
                    {"row": range(row, row + len(ids)), "doc_id": ids, "base": [joined(s) for s in spans], "around": around}
                    | {f"n_{k}": [sum(x[0] == k for x in s) for s in spans] for k in KINDS},
                    schema=FOUND,
                )
                row += len(ids)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(FOUND))


def _document_counts(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """(term, in how many documents) of every term whose bit is set."""
    return _task_counts(docs, marked).groupBy("term").agg(F.sum("docs").alias("n_term"))


def _task_counts(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """The same as counted by each task (term, docs)."""
    schema = pa.schema([("term", pa.int64()), ("docs", pa.int64())])

    def told(counts: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], schema=schema)

    def run(batches):
        # counts of a task are summed before they are told, as often as AT_ONCE terms are held
        counts: dict[int, int] = {}
        for batch in batches:
            for _, texts in blocks(batch):
                h, doc, _, _ = terms(texts)
                pass_ = _set(marked, h)
                once = np.unique(np.stack([doc[pass_], h[pass_]]), axis=1)[1] if pass_.any() else h[:0]
                for term, n in zip(*(x.tolist() for x in np.unique(once, return_counts=True))):
                    counts[term] = counts.get(term, 0) + n
                if len(counts) >= AT_ONCE:
                    yield told(counts)
                    counts = {}
        yield told(counts)

    return whole_texts(docs).mapInArrow(run, from_arrow_schema(schema))


def _bitmap(candidates: DataFrame, column: str) -> np.ndarray:
    """BITS bits, one set for each candidate's hash (in `column`); what comes to the driver has that size whatever the corpus."""
    rows = candidates.select(F.expr(f"{column} & {BITS - 1}L").alias("bit")).groupBy(F.expr("bit div 63").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("bits")).collect()
    out = np.zeros(BITS // 8 + 1, np.uint8)
    for r in rows:
        for k in range(63):
            if r["bits"] >> k & 1:
                b = r["at"] * 63 + k
                out[b >> 3] |= 1 << (b & 7)
    return out


def disclosures(docs: DataFrame) -> DataFrame:
    """(entity, term, degree, treatment) of the pairs from GENERALISE on."""
    n = docs.count()
    held = _entities(docs).groupBy("entity", "context").agg(F.sum("once").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("contexts"))
    entities = staged(held.where(f"contexts >= {SUPPORT}").drop("contexts"))
    evidence = _evidence(docs, _bitmap(entities, "entity")).groupBy("entity", "term", "context").agg(F.sum("once").alias("n"))
    pairs = staged(evidence.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts")).where(f"contexts >= {SUPPORT}"))
    counts = _document_counts(docs, _bitmap(pairs.select("term").distinct(), "term"))
    degree = F.expr(f"log2(least(n_pair, n_entity, n_term) * {n}.0 / (n_term * n_entity)) / nullif(log2({n}.0 / n_entity), 0)")
    return (
        pairs.join(entities, "entity").join(counts, "term").withColumn("degree", degree).where(f"degree >= {GENERALISE}")
        .select("entity", "term", "degree", F.when(F.col("degree") >= REMOVE, "removed").otherwise("generalised").alias("treatment"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts by kind, a digest of the plain spans, and all spans by kind, then start."""
    told = staged(disclosures(docs))
    found = staged(_found(docs, _bitmap(told, "entity"), _bitmap(told, "term")))
    extra = (
        found.select("row", F.inline("around")).join(told, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("treatment").alias("treatment"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("treatment", "start", "end"))).alias("extra"))
    )
    more = F.concat_ws(",", F.transform(F.coalesce("extra", F.array().cast("array<struct<treatment:string,start:bigint,end:bigint>>")), lambda x: F.concat_ws(":", x["treatment"], x["start"], x["end"])))
    return (
        found.drop("around").join(extra, "row", "left")
        .select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"),
                F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(more, F.lit(""))).alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_terms"))
    )


def sanitised_text(text: str, spans: str) -> str:
    """`text` with each span replaced: personal data and generalised terms by their kind, removed terms by nothing."""
    out, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += (text[at:start], PLACE[kind])
            at = end
    return "".join([*out, text[at:]])
